import math

import pytest
from pyspark.sql import functions as F

from gradus.operators import audit as A
from gradus.operators import calibration as C
from gradus.operators import groups as G
from gradus.plans import reports as R
from gradus.sources import manifests as M
from gradus.streaming import telemetry as T

ROLLOUT = "id string, step int, answer_label_available boolean, answer_correct boolean, answer_confidence double, visual_confidence double, vision_tokens int, proxy_fallback boolean, visual_proxy double, reason_text string, format_errors array<string>, reward map<string,double>"


def rollouts(spark):
    return spark.createDataFrame(
        [("a", 0, True, True, 0.9, 0.5, 4, False, 0.5, "so", [], {"utility": 1.0}), ("b", 0, True, False, 0.9, None, 0, True, 0.0, " ", ["empty_reason", "odd name"], {"utility": None}), ("c", 1, False, False, None, 0.25, 2, False, 0.75, None, [], None)],
        ROLLOUT,
    )


def test_full_report(spark):
    got = {r["measure"]: r["value"] for r in C.full_report(rollouts(spark), bins=4).collect()}
    assert got["answer_label_unavailable_count"] == 1 and got["visual_proxy_fallback_count"] == 1 and got["high_confidence_error_rate"] == 0.5
    assert got["answer_ece_bins/3/sample_count"] == 2 and got["answer_ece_bins/3/report_mean"] == pytest.approx(0.9) and got["answer_ece_bins/0/report_mean"] is None
    assert got["answer_ece10"] == pytest.approx(0.4) and got["reward_components/utility/sample_count"] == 1 and got["output_coverage/answer_report/n"] == 2
    assert not any(m.startswith("opsd_components/") for m in got)


def test_full_report_of_nothing(spark):
    got = {r["measure"]: r["value"] for r in C.full_report(spark.createDataFrame([], ROLLOUT)).collect()}
    assert got["sample_count"] == 0 and got["answer_ece"] is None and got["answer_ece_bins/9/sample_count"] == 0 and got["answer_accuracy"] is None


def test_trainer_logs(spark):
    rows = [(0, "rank_local/policy_loss", 1.0), (0, "rank_local/other", 2.0), (0, "optimizer_steps", 3.0), (0, "optimizer_state_max_step", 4.0), (0, "teacher_x", 5.0), (0, "a/b", 6.0), (0, "a_b", 7.0), (0, "a_b", 6.5), (0, None, 1.0), (0, "n", None), (0, "i", math.inf), (0, "x", math.nan), (1, "a/b", 8.0)]
    got = sorted(map(tuple, T.trainer_logs(spark.createDataFrame(rows, "step int, key string, value double"), "step").collect()))
    assert got == [(0, "trainer/a_b", 7.0), (0, "trainer/optimizer_state_max_step", 4.0), (0, "trainer/rank_local_policy_loss", 1.0), (1, "trainer/a_b", 8.0)]


def test_step_payloads(spark):
    logs = spark.createDataFrame([(1, "loss", 0.5), (2, "loss", 0.25)], "step int, key string, value double")
    got = {(r["step"], r["key"]): r["value"] for r in T.step_payloads(rollouts(spark), logs, "step", positions="vision_tokens").collect()}
    assert got[0, "train/attempt_count"] == 2 and got[0, "train/format_error_empty_reason_count"] == 1 and got[0, "train/opsd_diagnostic_coverage"] == 0.5
    assert (0, "train/format_error_odd name_count") not in got and (1, "train/answer_ece10") not in got and (1, "train/answer_brier") not in got
    assert got[1, "trainer/loss"] == 0.5 and [k for k in got if k[0] == 2] == [(2, "trainer/loss")]


def test_tracker(spark):
    sent = []
    tracker = T.Tracker(sent.append, lambda rows: rows.agg(F.count("*").alias("attempts")))
    logs = spark.createDataFrame([("loss/a", 0.5), ("optimizer_steps", 9.0)], "key string, value double")
    tracker.record(rollouts(spark))
    with pytest.raises(RuntimeError):
        tracker.finish()
    tracker.log_training({"optimizer_successful_updates": 3, "optimizer_skipped_updates": None}, 4, logs)
    tracker.log_validation(spark.range(1).select(F.lit(0.5).alias("accuracy"), F.lit(1).alias("secret"), F.lit(None).cast("double").alias("brier")), ["accuracy", "brier", "absent"], {"optimizer_successful_updates": 3}, 4)
    tracker.log_counters({"optimizer_successful_updates": 5}, 6)
    for bad in ({"optimizer_successful_updates": 4}, {"optimizer_successful_updates": -1}, {}, {"optimizer_successful_updates": True}):
        with pytest.raises(ValueError):
            tracker.log_counters(bad, 7)
    tracker.finish()
    with pytest.raises(RuntimeError):
        tracker.log_counters({"optimizer_successful_updates": 6}, 7)
    counters = {"optimizer/successful_updates": 3, "trainer/state_global_step": 4}
    assert sent == [counters | {"trainer/loss_a": 0.5, "train/attempts": 3}, counters | {"validation/accuracy": 0.5}, {"optimizer/successful_updates": 5, "trainer/state_global_step": 6}]


def test_strict_evaluation(spark):
    examples = spark.createDataFrame([("a", {"color": ["red"]}, ["yes"]), ("b", {"color": ["red"]}, ["no"])], "id string, facts map<string,array<string>>, answers array<string>")
    attempt = "id string, parsed boolean, visual_facts map<string,string>, answer string, visual_confidence int, answer_confidence int"
    attempts = [("a", True, {"color": "RED"}, "yes", 90, 80), ("b", False, {}, "no", 0, 0)]
    got = A.evaluate(examples, spark.createDataFrame(attempts, attempt)).first()
    assert (got["sample_count"], got["parsed"], got["format_failure_count"], got["v1_y1"], got["v0_y0"]) == (2, 1, 1, 1, 1)
    for rows in (attempts[:1], [*attempts, ("c", True, {}, "x", 1, 1)]):
        with pytest.raises(A.IdsDiffer):
            A.evaluate(examples, spark.createDataFrame(rows, attempt))


def pair(i, **more):
    row = {"images": [f"images/{i}.png"], "teacher_images": [f"teacher_images/{i}.png"], "original_images": ["original_images/o.png"], "bbox": [0, 0, 2, 1], "answer": "A", "problem": "<image>Which?\nA. a\nB. b\nC. c\nD. d Answer with the option's letter", "extra_info": {"answer": "A", "question": "Which?\nA. a\nB. b\nC. c\nD. d"}}
    return row | more


def test_source_pairs(spark):
    import json

    texts = [json.dumps(r) for r in (pair(0), pair(1), pair(2, images=["images/0.png"]), pair(3, bbox=[0, 0, 2.0, 1]), pair(4, bbox=[2, 0, 1, 1]), pair(5, images=[]), pair(6, answer="E"))] + ["[]", "{", json.dumps(pair(0))]
    rows = spark.createDataFrame(list(enumerate(texts)), "index long, raw string").withColumn("doc", F.try_parse_json("raw"))
    found = {}
    for r in M.pair_problems(rows).collect():
        found.setdefault(r["index"], []).append(r["rule"])
    box, new = "box is of whole numbers with an area", "images is new"
    assert {k: sorted(v) for k, v in found.items() if k not in (7, 8)} == {2: [new], 3: [box], 4: [box], 5: ["images has one name in its folder"], 6: ["answer is a letter of the options"], 9: [new, "teacher_images is new"]}
    assert len(found[7]) == len(found[8]) == 8


def test_sections(spark):
    one = spark.createDataFrame([("x|y", 0.5, None)], "name string, share double, n int")
    got = R.as_sections("All", [("First", "Some text.", one), ("Second", "", one.limit(0))])
    assert got.split("\n")[:7] == ["# All", "", "## First", "", "Some text.", "", "| name | share | n |"] and got.endswith("## Second\n\n| name | share | n |\n| --- | --- | --- |\n")
    assert " 0.5000 | NA |" in got


def test_finite_updates(spark):
    rows = [(0, [3.0]), (0, [4.0, 0.0]), (1, [math.nan]), (1, [1.0]), (2, [-math.inf]), (3, []), (3, None), (4, [1e200])]
    got = sorted(map(tuple, G.finite_updates(spark.createDataFrame(rows, "step int, g array<double>"), "step", "g").collect()))
    assert got == [(0, 2, 5.0, True), (1, 2, None, False), (2, 1, None, False), (3, 2, 0.0, True), (4, 1, None, False)]
