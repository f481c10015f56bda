import random

import pytest
from pyspark.sql import functions as F

from gradus.llm import decontam
from gradus.llm.shared import plain_words


def brute_tiles(item, text, k):
    """The longest common run of unmarked words, again and again."""
    in_item, in_text, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        out.append((i, j, n))
        in_item[i : i + n] = in_text[j : j + n] = [True] * n


@pytest.mark.parametrize("seed", range(40))
def test_coverage_against_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    item = [f"w{rng.randrange(6 if seed % 2 else 40)}" for _ in range(rng.randrange(1, 40))]
    pieces = [item[a : a + rng.randrange(1, 14)] for a in (rng.randrange(len(item)) for _ in range(5))]
    text = [w for p in pieces for w in [*p, f"x{rng.randrange(9)}"]]
    from gradus.llm.shared import Numbers

    want, k = brute_tiles(item, text, min(5, len(item))), min(5, len(item))
    for most in (decontam.MOST_PAIRS, 3, 0):  # all places listed at once, item by item, or none
        monkeypatch.setattr(decontam, "MOST_PAIRS", most)
        seeds = decontam.Seeds([(["q", "again"], " ".join(item)), (["other"], "not in any text of these")], 5)
        found = decontam._leaks(seeds, Numbers(seeds.vocabulary), " ".join(text).encode(), 0.0)
        counts = (len(item), sum(n for _, _, n in want), len(want), max((n for _, _, n in want), default=0))
        assert found == ([("q", *counts), ("again", *counts)] if want else [])
    seeds = decontam.Seeds([(["q"], " ".join(item))], 5)
    own = Numbers(seeds.vocabulary).of([w.encode() for w in text])
    assert decontam.repeating_tiles(seeds.items[0], own, k) == want


def test_a_periodic_text_takes_no_product_of_memory():
    import tracemalloc

    from gradus.llm.shared import Numbers

    period = [f"p{i}" for i in range(6)]
    seeds = decontam.Seeds([([n], " ".join(period * 160 + [f"end{n}"])) for n in range(5)], 5)
    tracemalloc.start()
    found = decontam._leaks(seeds, Numbers(seeds.vocabulary), " ".join(period * 5000).encode(), 0.5)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert [(f[0], f[2]) for f in found] == [(n, 960) for n in range(5)]


def rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    docs = [
        (1, f"before {item} after"), (2, " ".join(words[10:] + ["--", "and"] + words[:10])), (3, " ".join(words[:9])), (4, None), (5, ""), (6, "Alpha, BETA gamma; delta: " + "epsilon zeta eta theta iota kappa lambda"),
        (1, f"before {item} after"), (None, item), (8, "filler " * 30_000 + item), (9, "tiny item"), (10, " ".join(reversed(words))),
    ]
    bench = [(100, item), (101, item), (102, "Tiny item!"), (103, None), (104, ""), (105, "...")]
    return spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, item string"), spark.createDataFrame(bench, "item_id long, text string")


def test_leaks(spark):
    docs, bench = rows(spark)
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()), key=repr)
    both = [(d, i) for d in (1, 1, 2, 6, 8, None) for i in (100, 101)]
    assert got == sorted([*both, (9, 102)], key=repr)


def test_blocks_find_the_same(spark, monkeypatch):
    docs, bench = rows(spark)
    whole = sorted(map(repr, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam.blocks, "__defaults__", (10,))
    assert len(list(decontam.blocks(bench, "item_id", "text"))) > 1
    assert sorted(map(repr, decontam.leaks(docs, bench).collect())) == whole


def test_clean(spark):
    docs, bench = rows(spark)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [3, 4, 5, 10]
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontam.leaks(docs.limit(0), bench).count() == decontam.leaks(docs, bench.where(F.lit(False))).count() == 0


def test_plain_words():
    assert plain_words('Alpha, "BETA" -- é.') == [b"alpha", b"beta", "é".encode()]
