"""Exact interpolated quantiles by nested histograms: what is gathered depends on groups and bins, not on rows.

Each wanted rank lies in an interval of values, at first from its group's least to its greatest. A round counts the
values in equal bins of all open intervals, combined before the shuffle, and each rank's interval becomes the range of
the values in its bin. Intervals of one value are done; when the others hold few values, those are ranked.

The input is read once: groups and values are stored apart, and every round is one pass over those. Open intervals are a
few for each group, and go to the values by a broadcast where they are no more than MOST_SENT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bins of a round; values of an interval that are ranked by themselves.
BINS, FEW = 4096, 4096
#: Intervals that are broadcast; beyond, they are joined by a shuffle.
MOST_SENT = 500_000


def _joined(keys: list[str]) -> Column:
    """Equality of all keys with those under another name, where null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def _matched(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, v) of the values in each open interval."""
    open_ones = targets.where("low < high").select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high").distinct()
    if open_ones.limit(MOST_SENT + 1).count() <= MOST_SENT:
        open_ones = F.broadcast(open_ones)
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    return values.join(open_ones, _joined(keys) & inside).select(*keys, "low", "high", "v")


def _placed(targets: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with the bin of theirs: counts has (keys, low, high, n, least, most) in order of least."""
    upto = Window.partitionBy(*keys, "low", "high").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.withColumn("under", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    bins = bins.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high"), "under", F.col("n").alias("_n"), "least", "most")
    on = _joined(keys) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (F.col("rank") - F.col("before") >= F.col("under")) & (F.col("rank") - F.col("before") < F.col("under") + F.col("_n"))
    found = targets.where("low < high").join(bins, on).select(*keys, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("under")).alias("before"), F.col("_n").alias("n"))
    return targets.where("low = high").unionByName(found)


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, a column for each wanted quantile) of the values that aren't null; groups without any have no row."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    if not keys:  # one group, under a key of its own, so that intervals are joined by it
        return _quantiles(stored(rows.withColumn("_all", F.lit(0)), "values"), ["_all"], wanted).drop("_all")
    return _quantiles(stored(rows, "values"), keys, wanted)


def _quantiles(values: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    totals = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    places = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places.values()])))
    totals = stored(totals, "totals")
    targets = totals.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n")
    while (targets.where("low < high").agg(F.max("n")).first()[0] or 0) > FEW:
        inside = _matched(values, targets, keys)
        at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*keys, "low", "high", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        targets = stored(_placed(targets, counts, keys), "targets")
    counts = _matched(values, targets, keys).groupBy(*keys, "low", "high", "v").agg(F.count("*").alias("n"))
    done = _placed(targets, counts.withColumns({"least": F.col("v"), "most": F.col("v")}), keys).select(*keys, "rank", F.col("low").alias("v"))
    by_rank = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    both = totals.join(by_rank.select(*[F.col(k).alias(f"_{k}") for k in keys], "_at"), _joined(keys))
    at = lambda p: F.try_element_at("_at", p)
    return both.select(*keys, *[(at(F.floor(p)) + (p - F.floor(p)) * (at(F.ceil(p)) - at(F.floor(p)))).alias(name) for name, p in places.items()])


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, a row for each group; without keys both are of one row."""
    more = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *more)
    if not keys:
        return left.join(F.broadcast(renamed), F.lit(True), "left")
    return left.join(renamed, _joined(keys), "left").select(*left.columns, *more)
