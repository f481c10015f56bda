import random

import pytest
from pyspark.sql import functions as F

from gradus.functions import kernels as K
from gradus.operators import paired as P
from gradus.operators import splits as S


def test_joint_loss(spark):
    rows = [(1, [-1.0, -2.0, -0.5], [1, 1, 0], [0, 0, 1], [0.25, 0.75]), (2, [-1.0], [0], [0], []), (3, [-1.0], [1, 0], [0], [0.1])]
    frame = spark.createDataFrame(rows, "id int, p array<double>, c array<int>, r array<int>, kl array<double>")
    out = K.joint_loss(*[F.col(n) for n in ("p", "c", "r", "kl")], F.lit(2.0), F.lit(4.0), 0.5, 0.1)
    got = {r["id"]: tuple(r)[1:] for r in frame.select("id", *[x.alias(n) for n, x in out.items()]).collect()}
    assert got[1] == pytest.approx((0.5 * 8.0 + 0.1 * 0.5, 8.0, 0.5, 8.0 / 3, 1.5, 0.5, 2, 1))
    assert got[2] == (0.0, 0.0, 0.0, 0.0, None, None, 0, 0)
    assert got[3] == (None,) * 8


def test_batch_loss(spark):
    frame = spark.createDataFrame([(1.5, 0.5, [-1.0, -2.0], [-4.0]), (-1.0, 2.0, [-3.0], [])], "a double, b double, c array<double>, r array<double>")
    assert frame.select(K.batch_loss(*[F.col(n) for n in "abcr"])).first()[0] == pytest.approx(((4.5 + 2.0) + (-3.0 + 0.0)) / 2)


def test_rescore_ids(spark):
    frame = spark.createDataFrame([([11, 12], [7]), ([], [7]), ([11], []), ([11], [7, -1])], "p array<int>, r array<int>")
    assert [tuple(r) for r in frame.select(*K.rescore_ids(F.col("p"), F.col("r"))).collect()] == [([11, 12, 7], 2), (None, None), (None, None), (None, None)]


def test_epoch_order(spark):
    rng, order, want = random.Random(5), [], []
    for _ in range(17):
        if not order:
            order = list(range(7))
            rng.shuffle(order)
        want.append(order.pop())
    got = S.in_epochs(spark.range(7).select((F.col("id") * 5000).alias("id")), "id", 17, 5).orderBy("step").collect()
    assert [r["id"] // 5000 for r in got] == want and [r["epoch"] for r in got] == [1 + i // 7 for i in range(17)]
    assert not list(S.epoch_order(0, 3, 1))


def test_coverage(spark):
    rows = [("a", "n"), ("b", "n"), ("c", "n"), ("a", "x"), ("z", "x"), ("q", "y")]
    frame = spark.createDataFrame(rows, "example_id string, condition string")
    assert sorted(tuple(r) for r in P.coverage(frame, "n").collect()) == [("x", 3, 2, 1, 2, 1), ("y", 3, 1, 0, 3, 1)]
