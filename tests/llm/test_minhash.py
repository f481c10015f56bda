import math
import random
from fractions import Fraction

import numpy as np
import pytest

from gradus.llm import families, minhash
from tests.llm.test_parity_join import brute, edited


def got(frame, **options):
    return sorted((tuple(r) for r in minhash.near_copies(frame, **options).collect()), key=repr)


def want(rows, k, t):
    return sorted(((key, n, c, key == c) for key, n, c in brute(rows, k, t)), key=repr)


@pytest.mark.parametrize(("k", "t"), [(5, Fraction(85, 100)), (1, Fraction(1, 2))])
def test_against_brute_force(spark, k, t):
    rng, rows = random.Random(k), []
    for _ in range(12):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 6, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((len(rows), " ".join(edited(rng, words, rng.randrange(4)))))
    # Sets of six and seven shingles that differ by one, at 6/7 just above 0.85, and at 5/6 below.
    rows += [(len(rows) + i, " ".join(f"t{j}" for j in range(n))) for i, n in enumerate((10, 11, 9, 4, 5))]
    rows += [(len(rows), rows[3][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, " \t\n"), (5, rows[5][1]), (None, "only one of its kind"), (None, None), (7, "same key another text")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, node string").repartition(3)
    assert got(frame, k=k, t=t) == want(rows, k, t)


@pytest.mark.parametrize("limits", [{"GATHERED": 3, "BLOCK": 4}, {"DENSE": 1, "BLOCK": 4}, {"GATHERED": 12, "DENSE": 1, "BLOCK_BYTES": 4000}])
def test_families_in_several_blocks(spark, monkeypatch, limits):
    """Small limits, so buckets make families by size or by density, and families take a hub and a second round of blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(families if name.startswith("BLOCK") else minhash, name, value)
    rng = random.Random(9)
    words, shared = [f"v{rng.randrange(400)}" for _ in range(160)], [f"s{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, words, rng.randrange(1, 5)))) for i in range(60)]
    # A passage that is most of many texts which are no copies of each other.
    rows += [(i, " ".join([*shared, *(f"u{i}x{n}" for n in range(30))])) for i in range(60, 100)]
    # A chain, each like the next and no others.
    rows += [(i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 120))) for i in range(100, 130)]
    rows += [(i, rows[i - 70][1]) for i in range(130, 150)] + [(i, rows[i - 70][1] + " tail") for i in range(150, 160)] + [(160, "word " * 40_000 + "end"), (161, "word " * 50_000 + "end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(frame)
    assert found == want(rows, 5, Fraction(85, 100))
    assert 1 < len({c for _, _, c, _ in found}) < 150


def test_plan():
    """Bands miss a pair at the bound by MISS at most, and thresholds are where the posterior passes it."""
    for t in (Fraction(1, 2), Fraction(8, 10), Fraction(85, 100), Fraction(95, 100)):
        plan = minhash.Plan(t)
        assert (1 - float(t) ** plan.rows) ** plan.bands <= minhash.MISS
        for end, least in zip(plan.ends, plan.least, strict=True):
            assert minhash.posterior(least, end, t) >= minhash.MISS
            assert not least or minhash.posterior(least - 1, end, t) < minhash.MISS
    # The posterior is the integral of the likelihood over similarities above the bound.
    for agree, of in ((0, 4), (3, 4), (20, 24), (10, 24)):
        s = (np.arange(200_000) + 0.5) / 200_000
        like = s**agree * (1 - s) ** (of - agree)
        assert math.isclose(minhash.posterior(agree, of, Fraction(8, 10)), like[s > 0.8].sum() / like.sum(), rel_tol=1e-3)


def test_signatures_agree_as_often_as_sets_are_alike():
    plan, rng = minhash.Plan(Fraction(85, 100)), np.random.default_rng(4)
    for n, both in ((2000, 1000), (400, 360), (30, 10)):
        rate, pruned = [], 0
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64))
            a, b = (plan.signature(s)[0] for s in (x[:n], x[n - both :]))
            rate.append((a == b).mean())
            pruned += not len(minhash.survivors(a[None], b[None], plan))
        s = both / (2 * n - both)
        assert abs(np.mean(rate) - s) < 4 * math.sqrt(s * (1 - s) / (60 * plan.hashes)) + 1 / 256
        assert pruned == (60 if s < 0.4 else 0)


def test_a_long_set_takes_steps(monkeypatch):
    plan, own = minhash.Plan(Fraction(85, 100)), np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = plan.signature(own)
    monkeypatch.setattr(minhash, "STEP", 1000)
    assert all((x == y).all() for x, y in zip(whole, plan.signature(own), strict=True))


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
