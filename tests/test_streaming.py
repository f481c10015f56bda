from pyspark.sql import functions as F

from gradus.streaming import telemetry as T


def rows(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "id long, step int, v double")
    path = str(tmp_path / "in")
    frame.repartition(3).write.parquet(path)
    return frame, path


def test_stream_equals_batch(spark, tmp_path):
    frame, path = rows(spark, tmp_path)
    measures = {"n": F.count("*"), "total": F.sum("v")}
    query = T.to_table(T.windows(T.stream(spark, path, frame.schema), "step", measures), "windows_out", str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows_out").collect())) == sorted(map(tuple, T.windows(frame, "step", measures).collect()))


def test_publish(spark, tmp_path):
    frame, path = rows(spark, tmp_path)
    seen = {}
    query = T.publish(T.stream(spark, path, frame.schema), seen.__setitem__, str(tmp_path / "ck"), lambda b: b.agg(F.count("*").alias("n")))
    query.awaitTermination(120)
    assert len(seen) == 3 and sum(x[0]["n"] for x in seen.values()) == 30


def test_counters(spark, tmp_path):
    frame = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(6)] + [("b", 0, False)], "run string, step long, success boolean")
    path = str(tmp_path / "in")
    frame.coalesce(1).write.parquet(path)
    query = T.to_table(T.running_counters(T.stream(spark, path, frame.schema)), "counters_out", str(tmp_path / "ck"), "append")
    query.awaitTermination(180)
    got = sorted(map(tuple, spark.table("counters_out").collect()))
    assert got[-1] == ("b", 0, 1, 0, 1) and got[:6] == [("a", i, i + 1, i // 2 + 1, (i + 1) // 2) for i in range(6)]


def test_allowed(spark):
    frame = spark.createDataFrame([("a/b", 1.0), ("optimizer_x", 1.0), ("c", 1.0)], "key string, value double")
    assert [r["key"] for r in T.allowed(frame, ["a/b", "optimizer_x"]).collect()] == ["a_b"]
