import time

from pyspark.sql import functions as F

from gradus.functions import rollouts
from gradus.operators import splits as S


def test_spans(spark):
    rows = [(["ab", "", "é漢"], "abé漢"), ([], ""), (["a"], "b"), (None, "x"), (["a", None, "b"], "ab"), (["x"] * 5, "xxxxx"), (["\U0001f600", "z"], "\U0001f600z")]
    frame = spark.createDataFrame(rows, "pieces array<string>, text string").coalesce(1)
    for some in (frame, frame.where("text <> ''")):
        got = [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in some.select("text", rollouts.spans_of(F.col("pieces"), F.col("text")).alias("s")).collect()]
        want = [[(0, 2), (2, 2), (2, 4)], [], None, None, None, [(i, i + 1) for i in range(5)], [(0, 1), (1, 2)]]
        assert got == (want if some is frame else want[:1] + want[2:])


def test_many_tokens_take_time_in_proportion(spark):
    """Eight rows of 8,000 tokens each, in a few seconds with all that starts Spark."""
    frame = spark.range(8).select(F.array_repeat(F.lit("token "), 8000).alias("pieces"), F.repeat(F.lit("token "), F.lit(8000)).alias("text"))
    spans = frame.select(rollouts.spans_of(F.col("pieces"), F.col("text")).alias("s"))
    spans.agg(F.sum(F.size("s"))).first()
    began = time.perf_counter()
    assert spans.agg(F.sum(F.element_at("s", -1)["end"])).first()[0] == 8 * 48_000
    assert time.perf_counter() - began < 8


def test_an_epoch_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 16, 17, 1000):
        rows = spark.range(n).select(F.col("id").alias("item"))
        found = S.in_keyed_epochs(rows, "item", 2 * n + n // 2, 7).collect()
        assert sorted(r["step"] for r in found) == list(range(1, 2 * n + n // 2 + 1))
        orders = [[r["item"] for r in sorted(found, key=lambda r: r["step"]) if r["epoch"] == e] for e in (1, 2)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        assert n < 16 or orders[0] != orders[1] and orders[0] != list(range(n))
    assert S.in_keyed_epochs(spark.range(0).select(F.col("id").alias("item")), "item", 5, 7).collect() == []


def test_other_seeds_give_other_orders(spark):
    rows = spark.range(50).select(F.col("id").alias("item"))
    one, two, again = ([r["item"] for r in S.in_keyed_epochs(rows, "item", 50, s).orderBy("step").collect()] for s in (1, 2, 1))
    assert one == again != two


def test_the_exact_order_is_bounded(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(S, "MOST_SHUFFLED", 10)
    with pytest.raises(ValueError, match="most"):
        S.in_epochs(spark.range(11).select(F.col("id").alias("item")), "item", 5, 1)


def test_plans_of_splits(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 319, 320, 639, 640, 10**6)], "n long")
    got = [tuple(r) for r in rows.select(S.sizes_for(F.col("n"))["train"].alias("t"), S.sizes_for(F.col("n"))["validation"].alias("v")).collect()]
    assert got == [(None, None), (None, None), (256, 64), (256, 64), (512, 128), (512, 128)]
    assert [S.split_sizes(n) for n in (320, 640)] == [(256, 64), (512, 128)]
