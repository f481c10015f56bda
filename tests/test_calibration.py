import math

import pytest
from pyspark.sql import functions as F

from gradus.operators import audit as A
from gradus.operators import calibration as C
from gradus.sources.contracts import rollout_rules, rules_table

RECORDS = "id string, answer_correct boolean, answer_label_available boolean, answer_confidence double, visual_confidence double, visual_proxy double, proxy_fallback boolean, vision_tokens int, format_errors array<string>, reason_text string, proxy_components map<string,double>, reward map<string,double>"


def records(spark):
    rows = [
        ("a", True, True, 0.9, 0.8, 0.75, False, 10, [], "x", {"gap": 1.0, "other": None}, {}), ("b", False, True, 0.1, 0.2, 0.25, False, 5, ["empty_reason"], "x", {"gap": 3.0}, {}),
        ("c", True, True, None, None, 0.0, True, 0, [], " ", {}, {}), ("d", False, True, 0.8, 0.6, 0.5, False, 8, [], None, {}, {}),
    ]
    return spark.createDataFrame(rows, RECORDS)


def test_report_of_four_records(spark):
    r = C.evaluate_rollouts(records(spark)).first()
    want = {"answer_accuracy": 0.5, "answer_brier": 0.22, "answer_ece": 1 / 3, "high_confidence_count": 2, "high_confidence_error_count": 1, "visual_proxy_mse": 0.005, "visual_proxy_binned_mean_error": 1 / 15, "proxy_variance": 1 / 24, "proxy_mean_difference": 0.375, "reason_present_count": 1, "format_clean_count": 3, "visual_proxy_eligible_count": 3, "answer_confidence_coverage": 0.75}
    for name, value in want.items():
        assert r[name] == pytest.approx(value), name


def test_risk_coverage(spark):
    rows = C.risk_coverage(records(spark), "id", "answer_confidence", "answer_correct").orderBy("retained_count").collect()
    assert [r["id"] for r in rows] == ["a", "d", "b"]
    assert [r["risk"] for r in rows] == pytest.approx([0, 1 / 2, 2 / 3])
    assert [r["coverage_of_all"] for r in rows] == pytest.approx([0.25, 0.5, 0.75])


def test_risk_coverage_of_ties_and_close_reports(spark):
    rows = [(f"{i:04d}", [0.5, 0.5004, 0.5001, 1.0, 0.0][i % 5], i % 3 == 0) for i in range(300)]
    got = [r["id"] for r in C.risk_coverage(spark.createDataFrame(rows, "id string, c double, y boolean"), "id", "c", "y").orderBy("retained_count").collect()]
    assert got == [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_nothing_is_null_not_zero(spark):
    none = records(spark).where("id = 'c'")
    r = C.evaluate_rollouts(none).first()
    assert r["answer_brier"] is None and r["answer_ece"] is None and r["visual_proxy_mse"] is None and r["answer_confidence_coverage"] == 0
    assert C.reliability(none.withColumn("y", F.lit(1.0)), "answer_confidence", "y").where("sample_count = 0 AND report_mean IS NULL").count() == 10


def test_bins_close_at_one(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (0.999,), (1.0,)], "c double")
    assert [r[0] for r in rows.select(C.bin_of(F.col("c"), 10)).collect()] == [0, 1, 9, 9]


def test_pearson(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 1.0)], "a double, b double, c double")
    r = rows.agg(C.pearson(F.col("a"), F.col("b")).alias("ab"), C.pearson(F.col("a"), F.col("c")).alias("ac")).first()
    assert r["ab"] == pytest.approx(1) and r["ac"] is None
    assert rows.limit(1).agg(C.pearson(F.col("a"), F.col("b"))).first()[0] is None


def test_component_means_skip_nulls(spark):
    assert [tuple(r) for r in C.map_means(records(spark), "proxy_components").collect()] == [("gap", 2, 2.0)]


def test_contract_of_records(spark):
    good = records(spark)
    assert rules_table(good, "id", rollout_rules()).count() == 0
    bad = good.withColumn("visual_proxy", F.when(F.col("id") == "a", 1.5).when(F.col("id") == "c", 0.2).when(F.col("id") == "b", math.nan).otherwise(F.col("visual_proxy"))).withColumn("vision_tokens", F.when(F.col("id") == "d", 0).otherwise(F.col("vision_tokens")))
    assert sorted(tuple(r) for r in rules_table(bad, "id", rollout_rules()).collect()) == [("a", "visual_proxy is a probability"), ("b", "visual_proxy is a probability"), ("c", "fallback means proxy 0"), ("d", "no tokens means fallback")]


def cases(spark):
    examples = spark.createDataFrame([(k, {"color": ["red"]}, ["yes"]) for k in "abcd"], "id string, facts map<string,array<string>>, answers array<string>")
    attempts = spark.createDataFrame(
        [("a", True, {"color": "red"}, "yes", 90, 80), ("b", True, {"color": "red"}, "no", 70, 30), ("c", True, {"color": "blue"}, "yes", 20, 95), ("d", True, {}, "no", 10, 90)],
        "id string, parsed boolean, visual_facts map<string,string>, answer string, visual_confidence int, answer_confidence int",
    )
    return examples, attempts


def test_audit_of_four_cells(spark):
    r = A.audit(A.verified(*cases(spark))).first()
    assert [r[c] for c in ("v0_y0", "v0_y1", "v1_y0", "v1_y1")] == [1, 1, 1, 1]
    assert r["answer_given_not_visual"] == 0.5
    assert (r["utility_mean"], r["calibration_mean"], r["reward_mean"]) == pytest.approx((1.5, -0.07, 1.43))


def test_audit_of_missing_and_malformed(spark):
    examples, attempts = cases(spark)
    some = attempts.where("id <> 'a'").withColumn("parsed", F.col("id") != "b")
    r = A.audit(A.verified(examples, some)).first()
    assert (r["missing_attempt_count"], r["format_failure_count"], r["parsed"], r["v0_y0"]) == (1, 1, 2, 3)
    assert r["conditional_brier"] is None and r["conditional_ece10"] is None
    assert [tuple(x) for x in A.mismatches(examples, some).collect()] == [("a", "missing")]
    assert A.slot_accuracy(A.verified(examples, some)).first()["total"] == 4
