"""Audit of labelled examples against attempts: a missing or malformed attempt fails, and is counted as what it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import legacy_score
from ..functions.legacy import verify
from .calibration import calibration_error


def unknown_attempts(examples: DataFrame, attempts: DataFrame, key: str = "id") -> DataFrame:
    return attempts.join(examples, key, "left_anti")


def mismatches(examples: DataFrame, attempts: DataFrame, key: str = "id") -> DataFrame:
    """(key, problem): ids on one side only."""
    left, right = examples.select(key, F.lit(1).alias("_e")), attempts.select(key, F.lit(1).alias("_a"))
    both = left.join(right, key, "full_outer")
    return both.where("_e IS NULL OR _a IS NULL").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("unknown").alias("problem"))


def verified(examples: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each example with per_fact, visual and answer (0 or 1), and the scores of parsed attempts.

    examples: id, facts map<string, array<string>> of accepted values, answers array<string>. attempts: id, parsed
    (boolean), visual_facts map<string, string>, answer, visual_confidence and answer_confidence in percent. Values are
    compared in their folded form.
    """
    rows = examples.join(attempts.withColumn("received", F.lit(True)), "id", "left")
    rows = verify(rows)
    parsed = F.coalesce(F.col("parsed"), F.lit(False))
    rows = rows.withColumns({"parsed": parsed, "received": F.coalesce("received", F.lit(False)), "per_fact": F.transform_values("per_fact_correct", lambda k, ok: parsed & ok)})
    rows = rows.withColumns({"visual": F.forall(F.map_values("per_fact"), lambda x: x).cast("int"), "answer_ok": (F.col("parsed") & F.col("answer_correct")).cast("int")})
    v, r = F.col("visual_confidence") / 100, F.col("answer_confidence") / 100
    scores = legacy_score(F.col("visual"), F.col("answer_ok"), v, r)
    return rows.select("id", "facts", "received", "parsed", "per_fact", "visual", "answer_ok", F.when(parsed, v).alias("v"), F.when(parsed, r).alias("r"), *[F.when(parsed, c).alias(name) for name, c in scores.items()])


class IdsDiffer(ValueError):
    """Examples and attempts don't have the same ids."""


def evaluate(examples: DataFrame, attempts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``audit`` of attempts that have exactly the examples' ids; else IdsDiffer with the first few of each kind."""
    if found := mismatches(examples, attempts).orderBy("problem", "id").limit(5).collect():
        raise IdsDiffer("; ".join(f"{r['problem']}: {r['id']}" for r in found))
    return audit(verified(examples, attempts), threshold)


def audit(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of measures of ``verified``. Rewards and visual reports count parsed attempts, conditional ones those with V."""
    n, v, r = F.count("*"), F.col("v"), F.col("r")
    parsed, visual, answer = F.col("parsed"), F.col("visual"), F.col("answer_ok")
    given = parsed & (visual == 1)
    measures = {
        "sample_count": n, "facts_min": F.min(F.size("facts")), "facts_max": F.max(F.size("facts")), "facts_mean": F.avg(F.size("facts")),
        "received": F.count_if("received"), "parsed": F.count_if(parsed), "missing_attempt_count": F.count_if(~F.col("received")), "format_failure_count": F.count_if(F.col("received") & ~parsed),
        "visual_correct_count": F.count_if(visual == 1), "answer_correct_count": F.count_if(answer == 1), "v0_y0": F.count_if((visual == 0) & (answer == 0)), "v0_y1": F.count_if((visual == 0) & (answer == 1)), "v1_y0": F.count_if((visual == 1) & (answer == 0)), "v1_y1": F.count_if((visual == 1) & (answer == 1)),
        "answer_given_not_visual": F.try_divide(F.count_if((visual == 0) & (answer == 1)), F.count_if(visual == 0)),
        "utility_mean": F.avg("utility"), "calibration_mean": F.avg("calibration"), "reward_mean": F.avg("total"),
        "visual_confidence_mean": F.avg(v), "visual_observed_rate": F.avg(F.when(parsed, visual)), "visual_brier": F.avg(F.pow(v - visual, 2)),
        "conditional_count": F.count_if(given), "conditional_confidence_mean": F.avg(F.when(given, r)), "conditional_observed_rate": F.avg(F.when(given, answer)), "conditional_brier": F.avg(F.when(given, F.pow(r - answer, 2))),
        "high_visual_errors": F.count_if(parsed & (v >= threshold) & (visual == 0)), "high_conditional_errors": F.count_if(given & (r >= threshold) & (answer == 0)),
    }
    out = rows.agg(*[c.alias(name) for name, c in measures.items()])
    out = out.crossJoin(F.broadcast(calibration_error(rows.where(parsed), "v", "visual", 10, "visual_ece10")))
    return out.crossJoin(F.broadcast(calibration_error(rows.where(given), "r", "answer_ok", 10, "conditional_ece10")))


def slot_accuracy(rows: DataFrame) -> DataFrame:
    """(slot, correct, total, rate) over all examples."""
    return rows.select(F.explode("per_fact").alias("slot", "ok")).groupBy("slot").agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"), F.avg(F.col("ok").cast("int")).alias("rate"))
