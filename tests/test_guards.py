import json
import time

import pytest
from pyspark.errors import StreamingQueryException

from gradus.streaming import guards as G
from gradus.streaming.published import publish_once, published
from gradus.streaming.telemetry import stream, to_table


def run(spark, tmp_path, batches, schema, process, stop_after=None):
    """What a stream gives whose batches arrive one after another, started anew for each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with G.only_with_data(spark):
            query = process(stream(spark, str(tmp_path / "in"), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) and query.exception() is None
        if stop_after == i:
            time.sleep(2)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_a_falling_counter_is_refused_after_a_restart(spark, tmp_path):
    schema = "run string, step long, value double"
    found = run(spark, tmp_path, [[("a", 1, 5.0), ("a", 0, 3.0), ("b", 0, 9.0)], [("a", 2, 4.0), ("a", 3, 6.0), ("b", 1, None), ("b", 2, 9.0)], [("a", 4, 5.5), ("a", 5, 6.0)]], schema, G.rising)
    assert found == [("a", 0, 3.0, None, False), ("a", 1, 5.0, 3.0, False), ("a", 2, 4.0, 5.0, True), ("a", 3, 6.0, 5.0, False), ("a", 4, 5.5, 6.0, True), ("a", 5, 6.0, 6.0, False), ("b", 0, 9.0, None, False), ("b", 2, 9.0, 9.0, False)]


def test_windows_wait_across_a_restart(spark, tmp_path):
    schema = "run string, step long, event string, value double"
    first = [("a", 0, "rollout", 1.0), ("a", 1, "rollout", None), ("b", 0, "log", None), ("b", 1, "end", None)]
    second = [("a", 2, "rollout", 2.0), ("a", 3, "log", None), ("a", 4, "rollout", 8.0), ("a", 5, "finish", None), ("a", 6, "end", None), ("a", 7, "finish", None), ("a", 8, "other", 1.0), ("b", 2, "finish", None)]
    found = run(spark, tmp_path, [first, second], schema, G.flushed)
    assert found == [("a", 3, "log", 3, 3.0, False), ("a", 5, "finish", 1, 8.0, True), ("a", 6, "end", 1, 8.0, False), ("a", 7, "finish", 0, 0.0, False), ("b", 0, "log", 0, 0.0, False), ("b", 2, "finish", 0, 0.0, False)]


KINDS = "nonce string, step long, event string, model_version long, prompt_sha256 string, example_sha256 string, completion_sha256 string"


def test_replays(spark, tmp_path):
    made = lambda n, step, *more: (n, step, "generated", *more)
    scored = lambda n, step, *more: (n, step, "scored", *more)
    first = [made("a", 0, 2, "p", "e", "c"), scored("b", 0, 2, "p", "e", "c"), made("c", 0, 1, "p", "e", "c"), made("d", 0, 2, "p", None, "c")]
    second = [scored("a", 1, 2, "p", "x", "y"), scored("a", 2, 2, "p", "e", "c"), scored("a", 3, 2, "p", "e", "c"), scored("c", 1, 1, "q", "e", "c"), scored("d", 1, None, "p", None, "c"), scored("d", 2, 2, "p", None, "c")]
    found = run(spark, tmp_path, [first, second], KINDS, lambda rows: G.replays(rows, 2))
    assert found == [("a", 1, ["example_sha256", "completion_sha256"]), ("a", 2, []), ("a", 3, ["nonce"]), ("b", 0, ["nonce"]), ("c", 1, ["model_version", "prompt_sha256"]), ("d", 1, ["model_version"]), ("d", 2, [])]


def test_what_is_never_used_is_forgotten(spark, tmp_path):
    """After its time a nonce's state is gone, so state is bounded by what comes in that time."""
    first, second = [("a", 0, "generated", 2, "p", "e", "c")], [("a", 1, "scored", 2, "p", "e", "c")]
    assert run(spark, tmp_path, [first, second], KINDS, lambda rows: G.replays(rows, 2, expires=500), stop_after=0) == [("a", 1, ["nonce"])]


def test_a_batch_that_comes_again_is_published_once(spark, tmp_path):
    """The sink fails after it has published the second batch; started again, Spark runs that batch once more."""
    schema, path = "id long, text string", str(tmp_path / "published")
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, None if j == 2 else f"é{j}") for j in range(4)], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda **more: publish_once(stream(spark, str(tmp_path / "in"), schema, 2), path, str(tmp_path / "ck"), **more)
    with pytest.raises(StreamingQueryException):
        start(fail_after=1).awaitTermination(180)
    start().awaitTermination(180)
    manifests = sorted((tmp_path / "published").glob("batch-*.json"))
    assert [json.loads(m.read_text())["batch"] for m in manifests] == list(range(len(manifests))) and len(manifests) == 3
    named = {p for m in manifests for p in json.loads(m.read_text())["parts"]}
    assert {str(p) for p in (tmp_path / "published" / "parts").glob("*.json")} == named
    rows = published(spark, path, schema).collect()
    assert sorted((r["id"], r["text"]) for r in rows) == sorted((i * 10 + j, None if j == 2 else f"é{j}") for i in range(3) for j in range(4))


def test_unused_table(spark, tmp_path):
    """No rows, no state, no output."""
    schema = "run string, step long, value double"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = to_table(G.rising(stream(spark, str(tmp_path / "in"), schema)), "nothing_out", str(tmp_path / "ck"), "append")
    query.awaitTermination(120)
    assert spark.table("nothing_out").collect() == []
