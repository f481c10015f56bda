"""Rewards centred within groups, agreement between ranks, and running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import l2

#: Keeps a scale above 0.
EPSILON = 1e-4


def centred(rows: DataFrame, group: str, reward: str, scale: str = "none", name: str = "advantage") -> DataFrame:
    """Adds each reward less its group's mean; over the sample deviation of the group, or of the table, if asked."""
    within = Window.partitionBy(group)
    value = F.col(reward) - F.avg(reward).over(within)
    if scale == "group":
        value = F.when(F.count(reward).over(within) < 2, value).otherwise(value / (F.stddev_samp(reward).over(within) + EPSILON))
    elif scale == "batch":
        # One row of the whole table's deviation is put beside each row.
        whole = rows.agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_scale"))
        return rows.crossJoin(F.broadcast(whole)).withColumn(name, value / (F.col("_scale") + EPSILON)).drop("_scale")
    elif scale != "none":
        raise ValueError("scale must be none, group or batch")
    return rows.withColumn(name, value)


def incomplete(rows: DataFrame, group: str, size: int, payload: str | None = None) -> DataFrame:
    """(group, n, payloads) of groups without exactly ``size`` rows of one payload."""
    payloads = F.count_distinct(payload) if payload else F.lit(1).cast("long")
    return rows.groupBy(group).agg(F.count("*").alias("n"), payloads.alias("payloads")).where((F.col("n") != size) | (F.col("payloads") != 1))


def zero_groups(rows: DataFrame, group: str, advantage: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: groups, and the share of them in which no advantage is over the tolerance."""
    flat = rows.groupBy(group).agg(F.bool_and(F.abs(advantage) < tolerance).alias("flat"))
    return flat.agg(F.count("*").alias("groups"), F.avg(F.col("flat").cast("int")).alias("zero_fraction"))


def segment(content: Column, content_advantage: Column, report_advantage: Column, active: Column) -> Column:
    """An advantage for each token: that of its segment, 0 where the token isn't active."""
    return F.zip_with(content, active, lambda c, a: F.when(a == 0, 0.0).when(c == 1, content_advantage).otherwise(report_advantage))


def merged_ranks(rows: DataFrame, world: int, key: str = "key", value: str = "value") -> DataFrame:
    """(key, ranks, mean, complete): unweighted means over ranks; a key that some rank lacks is incomplete."""
    renamed = F.regexp_replace(key, "^rank_local/", "global/")
    out = rows.where(F.col(value).isNotNull()).groupBy(renamed.alias(key)).agg(F.count("*").alias("ranks"), F.avg(value).alias("mean"))
    return out.withColumn("complete", F.col("ranks") == world)


def disagreeing(rows: DataFrame, step: str, counters: list[str]) -> DataFrame:
    """(step, versions) of steps whose ranks don't report equal counters."""
    return rows.groupBy(step).agg(F.count_distinct(F.struct(*counters)).alias("versions")).where("versions > 1")


def falling(rows: DataFrame, run: str, step: str, counter: str) -> DataFrame:
    """Rows whose counter is below the one before it in its run."""
    before = F.lag(counter).over(Window.partitionBy(run).orderBy(step))
    return rows.withColumn("before", before).where(F.col(counter) < F.col("before"))


def counters(rows: DataFrame, run: str, step: str, success: Column) -> DataFrame:
    """(run, step, attempted, successful, skipped) as they stand after each step of a run."""
    upto = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(run, step, F.count("*").over(upto).alias("attempted"), F.count_if(success).over(upto).alias("successful"), F.count_if(~success).over(upto).alias("skipped"))


def at_intervals(rows: DataFrame, step: str, every: int, last: int) -> DataFrame:
    """The steps at which validation runs, each once: the first, every so many, and the last."""
    return rows.where((F.col(step) == 0) | (F.col(step) % every == 0) | (F.col(step) == last)).dropDuplicates([step])


def batch_means(rows: DataFrame, batch: str, values: list[str]) -> DataFrame:
    """(batch, rollout_count, mean of each value, finite): a batch with a value that isn't finite is told."""
    holds = [F.bool_and(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) for v in values]
    finite = holds[0]
    for h in holds[1:]:
        finite = finite & h
    return rows.groupBy(batch).agg(F.count("*").alias("rollout_count"), *[F.avg(v).alias(f"mean_{v}") for v in values], finite.alias("finite"))


def update_metrics(rows: DataFrame, update: str, reward: str, tolerance: float = 1e-12) -> DataFrame:
    """(update, variance, mean, all_zero): whether all rewards of an update are nothing."""
    return rows.groupBy(update).agg(F.var_pop(reward).alias("variance"), F.avg(reward).alias("mean"), F.bool_and(F.abs(reward) < tolerance).alias("all_zero"))


def parity(rows: DataFrame, group: str, told: str, reward: str, scale: str = "none", relative: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """(group, close): whether advantages that are told are those that ``centred`` makes of the rewards, within both bounds."""
    made = centred(rows, group, reward, scale, "_made")
    near = F.abs(F.col(told) - F.col("_made")) <= F.lit(absolute) + F.lit(relative) * F.abs("_made")
    return made.groupBy(group).agg(F.bool_and(near).alias("close"))


def rank_slice(rows: DataFrame, place: str, ranks: int, rank: int, total: int) -> DataFrame:
    """The rows of one rank: a run of total / ranks places, as shards are gathered in order of ranks."""
    if total % ranks:
        raise ValueError("ranks must have equal shares")
    share = total // ranks
    return rows.where((F.col(place) >= rank * share) & (F.col(place) < (rank + 1) * share))


def finite_updates(rows: DataFrame, step: str, gradient: str) -> DataFrame:
    """(step, parts, norm, applied): the norm over the gradients of a step's parts, each an array; a step with a value that isn't finite is skipped, and has no norm.

    A part without values, or null, adds nothing. A step is applied if all its norms are finite.
    """
    part = F.coalesce(l2(F.col(gradient)), F.lit(0.0))
    good = F.bool_and(~F.isnan(part) & (part < float("inf")))
    # Only finite parts enter the sum, as one that isn't refuses the step by itself.
    square = F.sum(F.when(~F.isnan(part) & (part < float("inf")), part * part))
    return rows.groupBy(step).agg(F.count("*").alias("parts"), F.when(good, F.sqrt(square)).alias("norm"), good.alias("applied"))
