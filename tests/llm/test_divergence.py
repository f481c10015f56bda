import random
import re
from collections import Counter, defaultdict

import pytest

from gradus.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """Term by term over whole vocabularies, in Python's integers."""
    docs = defaultdict(lambda: defaultdict(list))
    for lang, source, text in rows:
        docs[lang or ""][source or ""].append(Counter(TERM.findall((text or "").translate(LOWER))))
    out = []
    for lang, sources in docs.items():
        seen = Counter(t for found in sources.values() for c in found for t in c)
        kept = [t for t, d in seen.items() if d >= least]
        counts = {s: {t: sum(c[t] for c in found) for t in kept} for s, found in sources.items()}
        counts[None] = {t: sum(c[t] for c in counts.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()} for s, c in counts.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            telling = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", telling, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def made(seed, many):
    rng, rows = random.Random(seed), []
    words = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{'xyz' * (i % 3)}" for i in range(40)] + ["é", "É", "漢字", "ß", "\U0001f600", "￮", "The", "the", "THE"]
    for _ in range(many):
        source = rng.choice(["hot", "hot", "a", "b", "", None, "zé", "￮", "\U0001f600"])
        rows.append((rng.choice(["en", "en", "de", None, ""]), source, " ".join(rng.choice(words[: 10 + 4 * len(source or "")]) + rng.choice(["", "7", ".", "-x", "[y", " "]) for _ in range(rng.randrange(60)))))
    return [*rows, ("en", "only null", None), ("fr", "lone", "le mot"), ("it", "x", ""), ("it", "y", None), *[("en", "hot", "the same row")] * 20]


def got(frame, **options):
    return sorted(tuple(r) for r in divergence.audit(frame, **options).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = made(seed, 400)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n long, term string").repartition(4)
    assert got(frame) == brute(rows)


def test_small_steps_and_flushes(spark, monkeypatch):
    """A task that hands on often, pairs in many steps, and other bounds."""
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "STEP", 3)
    rows = made(2, 150)
    assert got(spark.createDataFrame(rows, "lang string, source string, text string").repartition(2), least=3, top=2) == brute(rows, 3, 2)


def test_long_text_and_large_counts(spark):
    rows = [("en", s, "aa " * n + "bb " * m) for s, n, m in (("x", 300_000, 1), ("y", 1, 200_000), ("z", 0, 1))] + [("en", "y", "aa bb")] * 10
    assert got(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 1), (7, 10**18, 10**6), (9 * 10**18, 9 * 10**18, 3), (123_456_789_012, 987_654_321_098_765, 31_337)]
    found = spark.createDataFrame(rows, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    assert [r["p"] for r in found.collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "lang string, source string, text string")) == []
