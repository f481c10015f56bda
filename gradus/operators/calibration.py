"""Calibration of reported confidences against outcomes, with the denominator of each measure stated.

Measures of nothing are null, never 0. Means and sums are partial aggregates; quantiles come from nested histograms, and
the ranks of the risk-coverage curve from bucket totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.scratch import stored
from .quantiles import beside, quantiles

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def bin_of(value: Column, bins: int) -> Column:
    """Equal bins of [0, 1]; the last is closed."""
    return F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")


def binned(pairs: DataFrame, report: str, target: str, bins: int) -> DataFrame:
    """(bin, n, report_mean, target_mean, error) of bins that have pairs; pairs with a null are left out."""
    known = pairs.where(F.col(report).isNotNull() & F.col(target).isNotNull())
    out = known.groupBy(bin_of(F.col(report), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(report).alias("report_mean"), F.avg(F.col(target).cast("double")).alias("target_mean"))
    return out.withColumn("error", F.abs(F.col("report_mean") - F.col("target_mean")))


def reliability(pairs: DataFrame, report: str, target: str, bins: int = 10) -> DataFrame:
    """All bins, with their bounds; those without pairs have null means."""
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(binned(pairs, report, target, bins), "bin", "left")
    return out.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("sample_count"), "report_mean", "target_mean", F.col("error").alias("absolute_mean_error"))


def calibration_error(pairs: DataFrame, report: str, target: str, bins: int = 10, name: str = "ece") -> DataFrame:
    """One row: the bins' errors, weighted by their pairs; null without pairs."""
    return binned(pairs, report, target, bins).agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias(name))


def pearson(a: Column, b: Column, *, clamp: bool = True) -> Column:
    """Correlation of pairs in [-1, 1]; null below two pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    out = F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))
    # least and greatest pass over nulls, so a null is kept by hand.
    out = F.when(out.isNotNull(), F.least(F.greatest(out, F.lit(-1.0)), F.lit(1.0))) if clamp else out
    return F.when(F.count(x) >= 2, out)


def brier(report: Column, target: Column) -> Column:
    return F.avg(F.pow(report - target.cast("double"), 2))


def described(rows: DataFrame, keys: list[str], value: Column, prefix: str = "", ends: bool = True) -> DataFrame:
    """(keys, count, mean, population variance and deviation, interpolated quantiles, and least and greatest with ends)."""
    rows = rows.select(*keys, value.cast("double").alias("_value"))
    v = F.col("_value")
    out = [F.count(v).alias(f"{prefix}sample_count"), F.avg(v).alias(f"{prefix}mean"), F.var_pop(v).alias(f"{prefix}variance"), F.stddev_pop(v).alias(f"{prefix}std")]
    out += [F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max")] if ends else []
    return beside(rows.groupBy(*keys).agg(*out), quantiles(rows, keys, "_value", {f"{prefix}{n}": q for n, q in QUANTILES.items()}), keys)


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) for all bins of [0, 1]; values are clamped."""
    clamped = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(bin_of(clamped, bins).alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def out_of_range(rows: DataFrame, value: str, slack: float = 1e-4) -> DataFrame:
    """Rows that a histogram of [0, 1] must refuse."""
    return rows.where((F.col(value) < -slack) | (F.col(value) > 1 + slack) | F.isnan(value))


def map_means(rows: DataFrame, column: str, keys: str = "name") -> DataFrame:
    """(name, sample_count, mean) over the entries of a map; null values don't count."""
    return rows.select(F.explode(column).alias(keys, "value")).where("value IS NOT NULL").groupBy(keys).agg(F.count("*").alias("sample_count"), F.avg("value").alias("mean"))


def risk_coverage(rows: DataFrame, key: str, report: str, correct: str, labelled: Column | None = None) -> DataFrame:
    """The curve: with the n most confident answers kept, the share of answers kept and of those wrong.

    Rows are ranked by falling report, then key, without a global sort in one task: they are dealt by ranges, so whatever
    keys and reports look like, a rank is the rows of earlier ranges, and a rank within one. Only ranges' totals meet.
    """
    labelled = F.lit(True) if labelled is None else labelled
    totals = rows.agg(F.count("*").alias("total_count"), F.count_if(labelled).alias("labelled_count"))
    used = rows.where(labelled & F.col(report).isNotNull()).select(F.col(key).alias("id"), F.col(report).alias("report"), (1 - F.col(correct).cast("int")).alias("wrong"))
    dealt = stored(used.repartitionByRange(F.col("report").desc(), "id").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.sum("n").over(Window.partitionBy()).alias("reported_count"))
    within = Window.partitionBy("part").orderBy(F.col("report").desc(), "id")
    ranked = dealt.join(F.broadcast(parts), "part").crossJoin(F.broadcast(totals))
    ranked = ranked.withColumn("retained_count", F.col("n0") + F.row_number().over(within)).withColumn("error_count", F.col("w0") + F.sum("wrong").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("retained_count")
    return ranked.select("id", n, "reported_count", "total_count", (n / F.col("reported_count")).alias("coverage_of_reported"), F.try_divide(n, F.col("labelled_count")).alias("coverage_of_labeled"), (n / F.col("total_count")).alias("coverage_of_all"), "error_count", (F.col("error_count") / n).alias("risk"))


def confident_errors(rows: DataFrame, report: str, target: str, threshold: float) -> DataFrame:
    """One row: pairs with a report of at least the threshold, and those of them whose target is 0."""
    sure = F.col(report) >= threshold
    return rows.agg(F.count_if(sure).alias("confident"), F.count_if(sure & (F.col(target) == 0)).alias("errors"))


def by_outcome(rows: DataFrame, outcome: str, value: str) -> DataFrame:
    """(outcome, n, mean of the value)."""
    return rows.groupBy(outcome).agg(F.count("*").alias("n"), F.avg(value).alias(f"{value}_mean"))


def kinds() -> tuple[Column, Column, Column, Column]:
    """Whether an answer is correct, and rows with a proxy, with a scored answer, and with a visual report beside a proxy."""
    eligible = ~F.col("proxy_fallback")
    return F.col("answer_correct").cast("int"), eligible, F.col("answer_label_available") & F.col("answer_confidence").isNotNull(), eligible & F.col("visual_confidence").isNotNull()


def plain_measures(threshold: float = 0.8) -> dict[str, Column]:
    """The measures of rollout records that one aggregation gives, over all rows or by a key."""
    answer, visual, proxy = F.col("answer_confidence"), F.col("visual_confidence"), F.col("visual_proxy")
    label, (correct, eligible, scored, paired) = F.col("answer_label_available"), kinds()
    clean, both = F.size("format_errors") == 0, visual.isNotNull() & answer.isNotNull()
    confident = scored & (answer >= threshold)
    reason = (strip(F.col("reason_text")) != "") & ~F.arrays_overlap("format_errors", F.array(F.lit("missing_or_invalid_reason"), F.lit("empty_reason"), F.lit("misordered_reason")))
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    n = F.count("*")
    return {
        "sample_count": n, "answer_correct_count": F.sum(correct).cast("long"), "answer_accuracy": F.avg(correct), "answer_label_available_count": count(label),
        "answer_confidence_count": count(scored), "answer_confidence_coverage": F.try_divide(count(scored), count(label)), "answer_brier": F.avg(F.when(scored, F.pow(answer - correct, 2))),
        "high_confidence_count": count(confident), "high_confidence_error_count": count(confident & (correct == 0)), "high_confidence_error_rate": F.try_divide(count(confident & (correct == 0)), count(confident)),
        "visual_proxy_eligible_count": count(eligible), "visual_proxy_pair_count": count(paired), "visual_proxy_report_coverage": F.try_divide(count(paired), count(eligible)), "visual_proxy_mse": F.avg(F.when(paired, F.pow(visual - proxy, 2))),
        "visual_proxy_report_correlation": pearson(F.when(paired, visual), F.when(paired, proxy)),
        "answer_relation_correlation": pearson(F.when(eligible & label, proxy), F.when(eligible & label, correct)), "proxy_mean_correct": F.avg(F.when(eligible & label & (correct == 1), proxy)), "proxy_mean_incorrect": F.avg(F.when(eligible & label & (correct == 0), proxy)),
        "reason_present_count": count(reason), "format_clean_count": count(clean), "format_clean_rate": F.try_divide(count(clean), n), "visual_report_count": count(visual.isNotNull()), "answer_report_count": count(answer.isNotNull()),
        "both_reports_count": count(both), "both_reports_rate": F.try_divide(count(both), n), "proxy_nonfallback_rate": F.try_divide(count(eligible), n),
    }


def evaluate_rollouts(rows: DataFrame, threshold: float = 0.8, bins: int = 10) -> DataFrame:
    """One row of all scalar measures of rollout records: one pass for what is plain, one more for each binned error."""
    correct, eligible, scored, paired = kinds()
    measures = plain_measures(threshold)
    out = rows.agg(*[c.alias(name) for name, c in measures.items()])
    # Single rows of aggregates are put side by side.
    for frame in (described(rows, [], F.when(eligible, F.col("visual_proxy")), "proxy_", False), described(rows, [], F.col("vision_tokens"), "vision_tokens_", False)):
        out = out.crossJoin(F.broadcast(frame))
    out = out.withColumn("proxy_mean_difference", F.col("proxy_mean_correct") - F.col("proxy_mean_incorrect"))
    scored_rows, paired_rows = rows.where(scored).withColumn("y", correct), rows.where(paired)
    for name, frame, report, target in (("answer_ece", scored_rows, "answer_confidence", "y"), ("visual_proxy_binned_mean_error", paired_rows, "visual_confidence", "visual_proxy")):
        out = out.crossJoin(F.broadcast(calibration_error(frame, report, target, bins, name)))
    return out


def paths(frame: DataFrame, keys: list[str], at: Column, names: list[str]) -> DataFrame:
    """(keys, measure, value) of a frame's numeric columns, each told by a path: where it is, and its name."""
    rows = frame.select(*keys, at.alias("_at"), *[F.col(n).cast("double").alias(n) for n in names])
    return rows.unpivot([*keys, "_at"], names, "_name", "value").select(*keys, F.concat("_at", "_name").alias("measure"), "value")


def full_report(rows: DataFrame, threshold: float = 0.8, bins: int = 10) -> DataFrame:
    """(measure, value): ``evaluate_rollouts`` with its bins, components and coverage, under paths as answer_ece_bins/3/report_mean.

    Errors of ten bins are told beside those of the bins asked for. Maps of components that the rows don't have are left
    out. A measure of nothing is null. The risk-coverage curve has a row for each rollout, so it stays its own table.
    """
    correct, eligible, scored, paired = kinds()
    whole = evaluate_rollouts(rows, threshold, bins)
    more = rows.agg(F.count_if(~F.col("answer_label_available")).alias("answer_label_unavailable_count"), F.count_if(~eligible).alias("visual_proxy_fallback_count"), F.lit(threshold).alias("high_confidence_threshold"))
    top = F.lit("")
    out = [paths(whole, [], top, whole.columns), paths(more, [], top, more.columns)]
    for error, table, frame, report, target in (
        ("answer_ece10", "answer_ece_bins", rows.where(scored).withColumn("y", correct), "answer_confidence", "y"),
        ("visual_proxy_binned_mean_error10", "visual_proxy_bins", rows.where(paired), "visual_confidence", "visual_proxy"),
    ):
        each = reliability(frame, report, target, bins)
        out += [paths(calibration_error(frame, report, target, 10, error), [], top, [error]), paths(each, [], F.concat(F.lit(f"{table}/"), F.col("bin"), F.lit("/")), each.columns[1:])]
    for name, frame, column in (("proxy_components", rows.where(eligible), "proxy_components"), ("reward_components", rows, "reward"), ("opsd_components", rows, "opsd")):
        if column in rows.columns:
            out.append(paths(map_means(frame, column), [], F.concat(F.lit(f"{name}/"), F.col("name"), F.lit("/")), ["sample_count", "mean"]))
    out.append(paths(output_coverage(rows), [], F.concat(F.lit("output_coverage/"), F.col("measure"), F.lit("/")), ["n", "rate"]))
    return reduce(DataFrame.unionAll, out)


def output_coverage(rows: DataFrame) -> DataFrame:
    """(measure, n, rate) over all rows."""
    answer, visual = F.col("answer_confidence").isNotNull(), F.col("visual_confidence").isNotNull()
    flags = {"answer_label_available": F.col("answer_label_available"), "answer_report": answer, "both_reports": answer & visual, "format_clean": F.size("format_errors") == 0, "proxy_nonfallback": ~F.col("proxy_fallback"), "visual_report": visual}
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in flags.items()])
    long = counts.unpivot(["total"], list(flags), "measure", "n")
    return long.select("measure", "n", F.try_divide("n", "total").alias("rate"))


def score_counts(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(score, n) for each whole score from 0 to the top, and all rows' coverage and mean beside."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("score")).agg(F.count("*").alias("n"))
    whole = rows.agg(F.count(column).alias("valid_count"), F.try_divide(F.count(column), F.count("*")).alias("coverage"), F.avg(column).alias("mean"))
    every = rows.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("score"))
    return every.join(counts, "score", "left").crossJoin(F.broadcast(whole)).select("score", F.coalesce("n", F.lit(0)).alias("n"), "valid_count", "coverage", "mean")


def error_frequency(rows: DataFrame, column: str = "format_errors") -> DataFrame:
    """(name, n) of error codes; names of other than letters, digits and underscores are left out."""
    return rows.select(F.explode(column).alias("name")).where(F.col("name").rlike("^[A-Za-z0-9_]+$")).groupBy("name").agg(F.count("*").alias("n"))


def weighted_means(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, n, positions, mean): means by position; without positions the mean is the placeholder 0, not null."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(weight).cast("long").alias("positions"), F.sum(F.col(value) * F.col(weight)).alias("total"))
    return out.select(group, "n", "positions", F.coalesce(F.try_divide("total", F.col("positions").cast("double")), F.lit(0.0)).alias("mean"))


def diagnostic_coverage(rows: DataFrame, step: str, positions: str) -> DataFrame:
    """(step, attempts, rows with sampled positions, positions, their share of the attempts); null counts as none."""
    n = F.coalesce(F.col(positions), F.lit(0))
    return rows.groupBy(step).agg(F.count("*").alias("attempts"), F.count_if(n > 0).alias("diagnostic_rows"), F.sum(n.cast("double")).alias("diagnostic_positions"), F.avg((n > 0).cast("int")).alias("diagnostic_coverage"))
