import random
from fractions import Fraction
from itertools import combinations

import pytest

from gradus.llm import families, parity_join


def brute(rows, k, t):
    """{position: (size, component)} of (id, text) rows."""
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[root(i)] = min(names.get(root(i), key), key)
    return sorted(((key, len(sets[i]), names.get(root(i))) for i, (key, _) in enumerate(rows)), key=repr)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (1, Fraction(1, 2))])
def test_against_brute_force(spark, k, t):
    rng, rows = random.Random(k), []
    for base in range(12):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 6, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((len(rows), " ".join(edited(rng, words, rng.randrange(4)))))
    rows += [(len(rows), rows[3][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, " \t\n"), (5, rows[5][1]), (None, "only one of its kind"), (None, None), (7, "same key another text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    got = sorted((tuple(r) for r in parity_join.join(frame, k=k, t=t).collect()), key=repr)
    assert got == brute(rows, k, t)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (3, None, 3), (4, "", 4), (0, "x y z x y z w", 5), (9, "x y z x y z w", 6), (2, "quite another text here now", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    kept = sorted(tuple(r) for r in parity_join.one_of_each(frame).select("doc_id", "_id").collect())
    assert kept == [(0, 5), (1, 1), (2, 7), (3, 3), (4, 4)]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.join(frame).count() == 0
    assert parity_join.one_of_each(frame).count() == 0


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(8, 10), Fraction(1, 2)])
def test_linked_sets_have_common_keys_with_near_marks(t):
    """1 + R in the band of the smaller set, of those whose marks allow a link; and sketches are as near as they must be."""
    import numpy as np

    rng = np.random.default_rng(0)
    keys = parity_join.Keys(t)
    for n in (1, 2, 5, 9, 10, 13, 19, 40, 100, 333, 1000, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(rng.integers(0, int(n * (1 - t)) + 1))
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 1)) // 2).astype(np.uint64))))
            if not len(b) or not families.linked(a, b, t):
                continue
            band = int(np.searchsorted(keys.starts, min(len(a), len(b)), "right")) - 1
            one, two = (dict(zip(*(x.tolist() for x in keys.of(own)), strict=True)) for own in (a, b))
            common = [x for x in one.keys() & two.keys() if x & 511 == band and (one[x] ^ two[x]).bit_count() <= keys.apart[band]]
            assert len(common) >= 1 + keys.layout[band][2], (n, gone)
            far = families.far(*(families.sketch(x, families.sketch_bits(len(x))) for x in (a, b)))
            assert far <= len(np.setxor1d(a, b)) <= parity_join.differ(len(a), len(b), t)


@pytest.mark.parametrize("limits", [{"GATHERED": 3, "BLOCK": 4}, {"DENSE": 1, "BLOCK": 4}, {"GATHERED": 12, "DENSE": 1, "BLOCK_BYTES": 4000}])
def test_families_in_several_blocks(spark, monkeypatch, limits):
    """Small limits, so buckets are left out, make families by size or by density, and families take several blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(families if name.startswith("BLOCK") else parity_join, name, value)
    rng = random.Random(9)
    words, shared = [f"v{rng.randrange(400)}" for _ in range(120)], [f"s{i}" for i in range(70)]
    rows = [(i, " ".join(edited(rng, words, rng.randrange(1, 9)))) for i in range(60)]
    # A passage that is most of many texts which are no copies of each other.
    rows += [(i, " ".join([*shared, *(f"u{i}x{n}" for n in range(50))])) for i in range(60, 100)]
    rows += [(i, rows[i - 40][1]) for i in range(100, 120)] + [(i, rows[i - 40][1] + " tail") for i in range(120, 130)]
    got = sorted((tuple(r) for r in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, t=Fraction(9, 10)).collect()), key=repr)
    assert got == brute(rows, 3, Fraction(9, 10))
    assert 1 < len({c for _, _, c in got}) < 130
