import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gradus.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """By rounds: share what is left by weight, hold those above their cap, share their excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left, by = total - sum(held.values()), sum(weight[s] for s in free)
        share = {s: Fraction(left * weight[s], by) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: Fraction(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 5, "c": 40, "d": 7, None: 100}, {"a": 10}, {"b": 0, "a": 10, "c": 1}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]), abs=1e-6)


def rows(spark):
    out = [(i, "w " * (i % 17), ["a", "b", "B", None, "é"][min(i % 11, 4)]) for i in range(900)]
    out += [(None, "no key", "a"), (3, "again and again", "b"), (3, "again and again", "b"), (5000, None, "b"), (5001, "", None), (5002, "x " * 3000, "b"), (5003, "one word", "only")]
    return out, spark.createDataFrame(out, "doc_id long, text string, source string").withColumn("_copy", F.lit("mine")).repartition(3)


def test_plan_against_contract(spark):
    plain, frame = rows(spark)
    got = mixing.plan_mix(frame).collect()
    assert len(got) == len(plain)
    sizes = {}
    for _, text, source in plain:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, largest = brute_targets(sizes), {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2)
    again = mixing.plan_mix(frame.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_rows_are_those_planned(spark):
    _, frame = rows(spark)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = {(r["doc_id"], r["source"]): r["n"] for r in mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    want = {}
    for r in mixing.plan_mix(frame).collect():
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["copies"]
    assert got == {k: v for k, v in want.items() if v}


def test_larger_budgets_keep_what_smaller_take(spark):
    sized = spark.range(500).select(F.lit("s").alias("source"), mixing.hash_key("id").alias("hash"), F.lit(10).cast("long").alias("size"))
    low, high = (mixing.thresholds(sized, spark.createDataFrame([("s", need)], "source string, need double")).first()["threshold"] for need in (1000.0, 3000.0))
    assert low < high
    assert sized.where(F.col("hash") < low).count() == 100


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(frame).count() == 0
    assert mixing.mix(frame).count() == 0
