import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gradus.functions import kernels as K
from gradus.operators import groups as G
from gradus.operators import paired as P
from gradus.operators import splits as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_kernels(spark):
    assert one(spark, K.js_divergence(arr(1, 0), arr(0, 1))) == pytest.approx(1)
    assert one(spark, K.js_divergence(arr(0.5, 0.5), arr(0.5, 0.5))) == pytest.approx(0)
    assert one(spark, K.entropy(arr(0.25, 0.25, 0.25, 0.25))) == pytest.approx(1)
    assert one(spark, K.entropy(arr(1, 0))) == 0
    assert one(spark, K.log_softmax(arr(1000, 1000))) == pytest.approx([-math.log(2)] * 2)
    assert one(spark, K.log_softmax(arr(0, 2), 2.0)) == pytest.approx([-math.log(1 + math.e), 1 - math.log(1 + math.e)])
    teacher, student = arr(math.log(0.9), math.log(0.1)), arr(math.log(0.1), math.log(0.9))
    assert one(spark, K.content_divergence(student, teacher, clip=0.05)) == pytest.approx(0.05 + 0.1 * math.log(1 / 9))
    assert one(spark, K.content_divergence(student, teacher)) == pytest.approx(0.8 * math.log(9))
    assert one(spark, K.content_divergence(student, teacher, 1.0)) == pytest.approx(0.8 * math.log(9))
    assert one(spark, K.argmax(arr(1, 3, 3))) == 1
    assert one(spark, K.top_k(arr(1, 3, 3, 2), 3)) == [1, 2, 3]
    assert one(spark, K.gather(arr(5, 6, 7), F.array(F.lit(2), F.lit(0)))) == [7, 5]
    assert one(spark, K.even_places(F.lit(10), 4)) == [0, 3, 6, 9] and one(spark, K.even_places(F.lit(10), 1)) == [0]
    assert one(spark, K.ema(arr(1, 1), F.lit(0.0), 0.5)) == 0.75
    assert one(spark, K.padded(arr(1), 3, F.lit(0.0))) == [1, 0, 0]
    assert one(spark, K.l2(arr(3, 4))) == 5


def test_rewards(spark):
    s = K.legacy_score(F.lit(0), F.lit(1), F.lit(0.8), F.lit(0.123))
    assert (one(spark, s["total"]), one(spark, s["calibration"])) == pytest.approx((0.36, -0.64))
    s = K.legacy_score(F.lit(1), F.lit(0), F.lit(0.6), F.lit(0.9))
    assert (one(spark, s["total"]), one(spark, s["calibration"])) == pytest.approx((1.03, -0.97))
    assert one(spark, K.proxy_score(F.lit(1.0), F.lit(0.5), F.lit(0.3), F.lit(0.5))["total"]) == pytest.approx(0.71)
    block = K.reward_block(F.lit(0.0), F.lit(0.5), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True))
    assert one(spark, block["content"]) == pytest.approx(-2.5)
    with pytest.raises(ValueError):
        K.proxy_score(F.lit(1), F.lit(1), F.lit(1), F.lit(1), a=0.5)
    ratio = K.log_ratio(arr(-1.0, -2.0), arr(-0.9, -2.0))
    assert one(spark, ratio) == pytest.approx(-0.1)
    assert one(spark, K.log_ratio(arr(-1), arr(-1, -2))) is None and one(spark, K.log_ratio(arr(0.5), arr(-1))) is None


def test_groups(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0), (1, 5.0)], "g int, r double")
    assert [r["advantage"] for r in G.centred(rows, "g", "r").orderBy("g", "r").collect()] == [-0.5, 0.5, 0, 0]
    scaled = [r["advantage"] for r in G.centred(rows, "g", "r", "group").orderBy("g", "r").collect()]
    assert scaled == pytest.approx([-0.5 / (math.sqrt(0.5) + 1e-4), 0.5 / (math.sqrt(0.5) + 1e-4), 0, 0])
    assert G.centred(rows.limit(1), "g", "r", "batch").first()["advantage"] == 0
    assert G.zero_groups(G.centred(rows, "g", "r"), "g", "advantage").first()["zero_fraction"] == 0.5
    assert one(spark, G.segment(F.array(F.lit(1), F.lit(0), F.lit(0)), F.lit(0.5), F.lit(-0.5), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [0.5, -0.5, 0]
    ranks = spark.createDataFrame([(0, "loss", 1.0), (1, "loss", 2.0), (0, "rank_local/x", 2.0)], "rank int, key string, value double")
    assert sorted(tuple(r) for r in G.merged_ranks(ranks, 2).collect()) == [("global/x", 1, 2.0, False), ("loss", 2, 1.5, True)]
    assert G.incomplete(rows, "g", 2).count() == 0 and G.incomplete(rows, "g", 3).count() == 2
    with pytest.raises(ValueError):
        G.centred(rows, "g", "r", "other")


def test_splits(spark):
    rows = spark.createDataFrame([(i % 20, i) for i in range(100)], "scene long, idx long")

    def rank(s, i):
        return hashlib.sha256(f"7\0{s}\0{i}".encode()).hexdigest()

    best = {s: min((rank(s, i), i) for i in range(100) if i % 20 == s) for s in range(20)}
    order = sorted(best, key=lambda s: best[s])
    got = {(r["scene"], r["idx"], r["split"]) for r in S.split(rows, "scene", "idx", 5, 3, 7).collect()}
    assert got == {(s, best[s][1], "train" if n < 5 else "validation") for n, s in enumerate(order[:8])}
    with pytest.raises(ValueError):
        S.split(rows, "scene", "idx", 15, 6, 7)
    k = [r["idx"] for r in S.subset(rows, "idx", 4, "s").orderBy("rank_sha256").collect()]
    assert k == sorted(range(100), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())[:4]
    assert int(one(spark, S.seed_of(F.lit("x")))) == int.from_bytes(hashlib.sha256(b"x").digest()[:8], "big")
    assert sorted(r["value"] for r in S.overlap(rows.where("idx < 30"), rows.where("idx >= 90"), ["scene"]).collect()) == sorted(map(str, range(10, 20)))
    assert [r["shard"] for r in S.stride(rows.withColumn("idx", F.col("idx") * 1000), "idx", 3).orderBy("idx").collect()] == [i % 3 for i in range(100)]
    assert sorted(tuple(r) for r in S.uncovered(spark.range(3), spark.createDataFrame([(1,), (1,), (5,)], "id long"), "id").collect()) == [(0, "missing"), (1, "extra"), (2, "missing"), (5, "extra")]


def test_successors(spark):
    scenes = [0, 0, 1, 1, 0]
    ids = spark.createDataFrame([(i, f"i{i}", s) for i, s in enumerate(scenes)], "pos int, id string, scene int")
    got = {r["id"]: r["next_id"] for r in S.successors(ids).collect()}
    assert got == {"i0": "i2", "i1": "i2", "i2": "i4", "i3": "i4", "i4": "i2"}


def samples(spark):
    rows = [("a", "n", 0.5, False), ("a", "c", 0.75, False), ("b", "n", 0.25, False), ("b", "c", 0.25, True), ("z", "c", 0.1, False)]
    return spark.createDataFrame(rows, "example_id string, condition string, raw_js double, proxy_fallback boolean")


def test_paired(spark):
    d = P.deltas(samples(spark), "n", ["raw_js"])
    got = {r["scope"]: (r["n"], r["mean_delta"], r["positive"], r["zero"]) for r in P.delta_summary(d).collect()}
    assert got == {"all_available": (2, 0.125, 1, 1), "valid_to_valid": (1, 0.25, 1, 0)}
    assert sorted(tuple(r) for r in P.transitions(samples(spark), "n").collect()) == [("c", "valid_to_fallback", 1), ("c", "valid_to_valid", 1)]
    exact = {r["scope"]: (r["low"], r["high"]) for r in P.exact_bootstrap(d, 50, 9).collect()}
    seed = int.from_bytes(hashlib.sha256(b"9|c|raw_js|all_available").digest()[:8], "big")
    rng = random.Random(seed)
    means = sorted(sum([0.25, 0.0][rng.randrange(2)] for _ in range(2)) / 2 for _ in range(50))
    at = 0.025 * 49
    assert exact["all_available"][0] == pytest.approx(means[int(at)] + (at - int(at)) * (means[int(at) + 1] - means[int(at)]))
    assert exact["valid_to_valid"] == (0.25, 0.25)
    low, high = P.hashed_bootstrap(d.where("scope = 'valid_to_valid'"), 20, 1).select("low", "high").first()
    assert (low, high) == (0.25, 0.25)


def test_token_checks(spark):
    tokens = spark.createDataFrame([("a", "n", 0, 7, 0.5, 0.1, 0.4, 0.2, 0.3), ("a", "c", 0, 8, 0.5, 0.1, 0.5, 0.2, 0.3), ("q", "n", 0, 7, 0.5, 0.1, 0.4, 0.2, 0.3)], "example_id string, condition string, token_index int, token_id int, raw_js double, baseline_js double, corrected_gap double, teacher_entropy double, uncertainty double")
    assert [r["example_id"] for r in P.orphans(tokens, samples(spark)).collect()] == ["q"]
    assert [r["condition"] for r in P.off_formula(tokens, 1.0, 0.5).collect()] == ["c"]
    assert [r["example_id"] for r in P.unequal_sequences(tokens).collect()] == ["a"]
    assert P.off_mean(tokens, samples(spark), "raw_js").count() == 1


def test_exact_means_by_any_order(spark):
    values = [0.09698, 0.07084, 0.0645, 0.1048, 0.1409, 0.10686]
    sample = statistics.mean(values)
    assert abs(sample - statistics.mean(values[1:])) > 1e-4  # by its rounding alone: as decimals the two are 0.0001 apart
    recorded = spark.createDataFrame([("a", "n", sample)], "example_id string, condition string, raw_js double")
    for order in (values[1:], values[:0:-1]):
        tokens = spark.createDataFrame([("a", "n", v) for v in order], "example_id string, condition string, raw_js double").coalesce(1)
        assert [r["token_mean"] for r in P.off_mean(tokens, recorded, "raw_js").collect()] == [statistics.mean(values[1:])]
    nan, inf = math.nan, math.inf
    cases = {"a": ([0.1] * 3, 0.1), "b": ([0.1, None, 0.3], 0.2), "c": ([None], None), "d": ([1.0, nan], nan), "e": ([1.0, inf], inf), "f": ([3e8, 0.5, 0.5], 1e8 + 1 / 3), "g": ([-0.25, 1e-7], -0.12499995), "h": ([1e-300], 0.0)}
    rows = spark.createDataFrame([(k, v) for k, (given, _) in cases.items() for v in given], "k string, v double")
    got = {r["k"]: r["m"] for r in rows.groupBy("k").agg(P.exact_mean(F.col("v")).alias("m")).collect()}
    assert math.isnan(got.pop("d")) and got == {k: want for k, (_, want) in cases.items() if k != "d"}
