"""Samples under several conditions, compared with one of them over the ids that both have."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import importable
from .calibration import described, pearson
from .quantiles import beside, quantiles
from .splits import seed_of

TOLERANCE = 1e-12


def orphans(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """Tokens of no sample."""
    return tokens.join(samples, ["example_id", "condition"], "left_anti")


def miscounted(tokens: DataFrame, samples: DataFrame, declared: str = "vision_tokens") -> DataFrame:
    """(example_id, condition, declared, found) where they differ."""
    found = tokens.groupBy("example_id", "condition").agg(F.count("*").alias("found"))
    out = samples.select("example_id", "condition", F.col(declared).alias("declared")).join(found, ["example_id", "condition"], "left")
    return out.withColumn("found", F.coalesce("found", F.lit(0))).where("declared <> found")


def off_formula(tokens: DataFrame, weight: float, alpha: float, slack: float = 1e-4) -> DataFrame:
    """Tokens whose gap or uncertainty isn't what its parts make."""
    gap = F.least(F.greatest(F.col("raw_js") - F.lit(weight) * F.col("baseline_js"), F.lit(0.0)), F.lit(1.0))
    mixed = F.lit(alpha) * F.col("corrected_gap") + F.lit(1 - alpha) * F.col("teacher_entropy")
    return tokens.where((F.abs(F.col("corrected_gap") - gap) > slack) | (F.abs(F.col("uncertainty") - mixed) > slack))


def exact_mean(value: Column) -> Column:
    """Mean of doubles by the sum of their decimals to twenty places, which no order of rows changes.

    Where a value isn't finite, or is 1e8 or more, it is the average of the doubles.
    """
    x = value.cast("double")
    decimal = x.try_cast("decimal(28,20)")
    return F.when(F.count(decimal) == F.count(x), F.avg(decimal).cast("double")).otherwise(F.avg(x))


def off_mean(tokens: DataFrame, samples: DataFrame, metric: str, slack: float = 1e-4) -> DataFrame:
    """Samples whose metric isn't the mean of their tokens', which is exact: at the slack itself, an average of doubles would tell by the order of tokens."""
    means = tokens.groupBy("example_id", "condition").agg(exact_mean(F.col(metric)).alias("token_mean"))
    return samples.join(means, ["example_id", "condition"]).where(F.abs(F.col(metric) - F.col("token_mean")) > slack)


def unequal_sequences(tokens: DataFrame) -> DataFrame:
    """(example_id, versions) of examples whose conditions don't have one sequence of token ids.

    A sequence is told by its length and a hash summed over (index, id), so no task holds one whole.
    """
    item = F.xxhash64("token_index", "token_id").cast("decimal(38,0)")
    each = tokens.groupBy("example_id", "condition").agg(F.count("*").alias("n"), F.sum(item).alias("h"))
    return each.groupBy("example_id").agg(F.count_distinct(F.struct("n", "h")).alias("versions")).where("versions > 1")


def condition_summary(samples: DataFrame, tokens: DataFrame, metrics: list[str]) -> DataFrame:
    """(condition, metric, weighting, statistics): means of examples count alike, or all tokens are pooled."""
    def long(rows: DataFrame, weighting: str) -> DataFrame:
        have = [m for m in metrics if m in rows.columns]
        values = rows.select("condition", *[F.col(m).cast("double").alias(m) for m in have]).unpivot(["condition"], have, "metric", "value")
        return described(values.where("value IS NOT NULL"), ["condition", "metric"], F.col("value")).withColumn("weighting", F.lit(weighting))

    return long(samples, "examples").unionByName(long(tokens, "tokens"))


def condition_counts(samples: DataFrame, tokens: DataFrame) -> DataFrame:
    a = samples.groupBy("condition").agg(F.count("*").alias("sample_count"), F.count_if("proxy_fallback").alias("fallback_count"), F.avg(F.col("proxy_fallback").cast("int")).alias("fallback_rate"), F.count("answer_correct").alias("labeled_sample_count"), F.count_if("answer_correct").alias("answer_correct_count"))
    b = tokens.groupBy("condition").agg(F.count("*").alias("vision_token_count"), F.avg((F.abs("corrected_gap") <= 1e-6).cast("int")).alias("zero_gap_fraction"), F.avg((F.col("raw_js") <= F.col("baseline_js") + 1e-6).cast("int")).alias("raw_le_baseline_fraction"))
    return a.join(b, "condition", "left").withColumn("vision_token_count", F.coalesce("vision_token_count", F.lit(0)))


def term_relations(samples: DataFrame, baseline: str, alpha: float) -> DataFrame:
    gap, entropy, proxy = F.col("corrected_gap"), F.col("teacher_entropy"), F.col("visual_proxy")
    valid = samples.where((F.col("condition") == baseline) & ~F.col("proxy_fallback") & gap.isNotNull() & entropy.isNotNull() & proxy.isNotNull())
    return valid.agg(F.count("*").alias("n"), pearson(gap, entropy, clamp=False).alias("gap_entropy"), pearson(gap, proxy, clamp=False).alias("gap_proxy"), pearson(entropy, proxy, clamp=False).alias("entropy_proxy"), (F.lit(alpha) * F.avg(gap)).alias("gap_part"), (F.lit(1 - alpha) * F.avg(entropy)).alias("entropy_part"))


def deltas(samples: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """(condition, example_id, metric, scope, delta) for ids that both conditions have, and the metric on both."""
    old = samples.where(F.col("condition") == baseline).select("example_id", F.col("proxy_fallback").alias("_f"), *[F.col(m).alias(f"_{m}") for m in metrics])
    both = samples.where(F.col("condition") != baseline).join(old, "example_id")
    moved = both.select("condition", "example_id", (F.col("proxy_fallback") | F.col("_f")).alias("fell"), *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in metrics])
    long = moved.unpivot(["condition", "example_id", "fell"], metrics, "metric", "delta").where("delta IS NOT NULL")
    scopes = F.when(F.col("fell"), F.array(F.lit("all_available"))).otherwise(F.array(F.lit("all_available"), F.lit("valid_to_valid")))
    return long.select("condition", "example_id", "metric", F.explode(scopes).alias("scope"), "delta")


def condition_order(conditions: DataFrame, known: list[str], column: str = "condition") -> DataFrame:
    """(condition, place): the known ones in their order, the baseline first, and all others after them by name."""
    at = F.array_position(F.array(*map(F.lit, known)), F.col(column))
    names = conditions.select(column).distinct()
    # Conditions are few: a row each.
    order = Window.orderBy(F.when(at > 0, at).otherwise(len(known) + 1), column)
    return names.select(column, (F.row_number().over(order) - 1).cast("int").alias("place"))


def transitions(samples: DataFrame, baseline: str) -> DataFrame:
    """(condition, change, n) of falling back, from the baseline to each condition."""
    old = samples.where(F.col("condition") == baseline).select("example_id", F.col("proxy_fallback").alias("_f"))
    name = lambda c: F.when(c, "fallback").otherwise("valid")
    both = samples.where(F.col("condition") != baseline).join(old, "example_id")
    return both.groupBy("condition", F.concat(name(F.col("_f")), F.lit("_to_"), name(F.col("proxy_fallback"))).alias("change")).agg(F.count("*").alias("n"))


def coverage(samples: DataFrame, baseline: str) -> DataFrame:
    """(condition, ids of the baseline, of the condition, of both, of one alone): what ``deltas`` can't compare is counted here."""
    old = samples.where(F.col("condition") == baseline).select("example_id").distinct().withColumn("_old", F.lit(1))
    new = samples.where(F.col("condition") != baseline).select("condition", "example_id").distinct()
    found = new.join(old, "example_id", "left").groupBy("condition").agg(F.count("*").alias("condition_sample_count"), F.count("_old").alias("shared_example_ids"))
    both = found.crossJoin(F.broadcast(old.agg(F.count("*").alias("baseline_sample_count"))))
    return both.select("condition", "baseline_sample_count", "condition_sample_count", "shared_example_ids", (F.col("baseline_sample_count") - F.col("shared_example_ids")).alias("baseline_only_count"), (F.col("condition_sample_count") - F.col("shared_example_ids")).alias("condition_only_count"))


def delta_summary(rows: DataFrame) -> DataFrame:
    d, keys = F.col("delta"), ["condition", "metric", "scope"]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.stddev_pop(d).alias("std_delta"),
        F.count_if(d > TOLERANCE).alias("positive"), F.count_if(d < -TOLERANCE).alias("negative"), F.count_if(F.abs(d) <= TOLERANCE).alias("zero"),
    )
    return beside(out, quantiles(rows, keys, "delta", {"median_delta": 0.5}), keys)


#: P(a Poisson number of mean 1 is at most k), from k = 0 on.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(9))
#: Resamples that one digest makes weights for.
PER_DIGEST = 4


#: Conditions whose sums a task holds at once.
MOST_HELD = 64


def _weights(seed: int, examples: list[str | None], reps: int) -> np.ndarray:
    """Poisson numbers of mean 1 by example and resample: of each four resamples, the words of one digest."""
    blocks = range(-(-reps // PER_DIGEST))
    digests = b"".join(hashlib.md5("|".join([str(seed), str(b), *([] if e is None else [e])]).encode()).digest() for e in examples for b in blocks)
    u = np.frombuffer(digests, ">u4").reshape(len(examples), -1)[:, :reps] / float(1 << 32)
    return np.searchsorted(np.array(POISSON), u, side="right").astype(float)


def hashed_bootstrap(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """(condition, metric, scope, low, high): percentile intervals of resampled means, by a Poisson bootstrap.

    A resample takes each example a Poisson number of times, which a digest of (seed, block of resamples, example) tells,
    so any engine draws the same. Examples are weighted where they stand: a task multiplies their deltas with a matrix of
    weights, and hands on a vector of ``reps`` sums for each condition, metric and scope. What is shuffled after that
    depends on tasks and resamples, not on examples.
    """
    importable(rows.sparkSession)
    keys = ["condition", "metric", "scope"]
    kinds = [(r["metric"], r["scope"]) for r in rows.select("metric", "scope").distinct().orderBy("metric", "scope").collect()]
    wide = rows.groupBy("condition", "example_id").agg(*[F.max(F.when((F.col("metric") == m) & (F.col("scope") == s), F.col("delta"))).cast("double").alias(f"d{i}") for i, (m, s) in enumerate(kinds)])
    step = max(1, (1 << 20) // reps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for condition, sums in held.items():
                flat = [pa.array(list(x.reshape(len(kinds), reps)), pa.list_(pa.float64())) for x in (sums[0], sums[1])]
                yield pa.RecordBatch.from_arrays([pa.array([condition] * len(kinds), pa.string()), pa.array(range(len(kinds)), pa.int32()), *flat], ["condition", "kind", "sums", "weights"])
            held.clear()

        for b in batches:
            condition, example = b.column("condition").to_pylist(), b.column("example_id").to_pylist()
            deltas = np.stack([b.column(f"d{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(kinds))], 1)
            for c in dict.fromkeys(condition):
                own = [i for i, x in enumerate(condition) if x == c]
                if c not in held and len(held) >= MOST_HELD:
                    yield from told()
                sums = held.setdefault(c, np.zeros((2, len(kinds), reps)))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    weights, d = _weights(seed, [example[i] for i in some], reps), deltas[some]
                    sums[0] += np.nan_to_num(d).T @ weights
                    sums[1] += (~np.isnan(d)).astype(float).T @ weights
        yield from told()

    parts = wide.mapInArrow(work, "condition string, kind int, sums array<double>, weights array<double>")
    by_rep = parts.select("condition", "kind", F.posexplode(F.arrays_zip("sums", "weights")).alias("rep", "x")).groupBy("condition", "kind", "rep").agg(F.sum("x.sums").alias("s"), F.sum("x.weights").alias("n"))
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("scope")) for m, s in kinds])
    long = by_rep.where("n > 0").select("condition", F.get(named, F.col("kind")).alias("k"), F.try_divide("s", "n").alias("mean")).select("condition", "k.*", "mean")
    # A row a resample.
    return long.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def twister_means(values: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Means of resamples by the draws of random.Random(seed).randrange(n), made in blocks: the top bits of each word, if below n."""
    n, (*key, pos) = len(values), random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    shift, means, left = np.uint64(32 - n.bit_length()), [], np.zeros(0, np.int64)
    for first in range(0, reps, size := max(1, (1 << 20) // n)):
        need = min(size, reps - first) * n
        parts, have = [left], len(left)
        while have < need:
            raw = words.random_raw(need - have + 64) >> shift
            parts.append(raw[raw < n].astype(np.int64))
            have += len(parts[-1])
        places = np.concatenate(parts)
        left = places[need:]
        means.append(values[places[:need]].reshape(-1, n).mean(1))
    return np.concatenate(means)


def metric_seed(seed: int, condition: str = "condition", metric: str = "metric", scope: str = "scope") -> Column:
    """The seed of a group's resamples, told by the group alone."""
    return seed_of(F.concat_ws("|", F.lit(str(seed)), condition, metric, scope))


def exact_bootstrap(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """The same with Mersenne Twister draws in order of ids: one group of deltas a task, as that order is the result."""
    keyed = rows.withColumn("seed", metric_seed(seed).cast("string"))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("example_id")["delta"].to_numpy(float)
        means = pd.Series(twister_means(values, reps, int(pdf["seed"].iloc[0])))
        first = pdf.iloc[0]
        return pd.DataFrame([{"condition": first["condition"], "metric": first["metric"], "scope": first["scope"], "low": means.quantile(0.025), "high": means.quantile(0.975)}])

    return keyed.groupBy("condition", "metric", "scope").applyInPandas(interval, "condition string, metric string, scope string, low double, high double")


def cohort(first: DataFrame, second: DataFrame, key: str, valid: Column) -> DataFrame:
    """Rows of ids that are valid at both ends, with the second's columns after the first's."""
    later = second.where(valid)
    renamed = later.select(key, *[F.col(c).alias(f"{c}_after") for c in later.columns if c != key])
    return first.where(valid).join(renamed, key)

