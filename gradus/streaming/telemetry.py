"""Telemetry windows over micro-batches, and counters that must not fall."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import calibration as C


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windows(rows: DataFrame, step: str, measures: dict) -> DataFrame:
    """One row of measures for each step: the flush window of a log event, in batch or stream."""
    return rows.groupBy(step).agg(*[c.alias(name) for name, c in measures.items()])


def publish(rows: DataFrame, sink: Callable[[int, list[dict]], None], checkpoint: str, report: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Send a report of each micro-batch to a sink, by its number, so a sink can drop a batch that comes again."""
    def flush(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(number, [r.asDict() for r in report(batch).collect()])

    return rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def allowed(rows: DataFrame, names: list[str], key: str = "key") -> DataFrame:
    """Rows of allowed keys, under the names that they are published by."""
    dropped = F.col(key).rlike("^(?:optimizer|teacher)_")
    return rows.where(F.col(key).isin(names) & ~dropped).withColumn(key, F.regexp_replace(key, "/", "_"))


#: The measures that a rank tells of itself alone.
RANK_LOCAL = ("policy_loss", "opsd_loss", "content_tokens", "generated_tokens")


def trainer_logs(rows: DataFrame, step: str, local: str = "rank_local/", of_rank: tuple[str, ...] = RANK_LOCAL) -> DataFrame:
    """(step, key, value) of a trainer's logs (step, key, value), under the names that they are published by.

    Measures of one rank pass if they are in of_rank. Counters of optimizer and teacher don't, as the evidence has them, but
    optimizer_state_max_step does. Slashes become underscores. Null names, and values that are null or not finite, are left
    out. Of keys that get one name, the last by code point counts, and of its values the greatest.
    """
    key, value = F.col("key"), F.col("value").cast("double")
    rest = F.substr(key, F.lit(len(local) + 1))
    name = F.when(key.startswith(local), F.when(rest.isin(*of_rank), F.concat(F.lit("rank_local_"), rest))).when((key == "optimizer_state_max_step") | ~key.rlike("^(?:optimizer|teacher)_"), F.translate(key, "/", "_"))
    known = rows.select(step, F.concat(F.lit("trainer/"), name).alias("_name"), key.alias("_key"), value.alias("value")).where(F.col("_name").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return known.groupBy(step, F.col("_name").alias("key")).agg(F.max_by("value", F.struct("_key", "value")).alias("value"))


def step_payloads(rollouts: DataFrame, logs: DataFrame, step: str, scores: tuple[str, ...] = (), positions: str | None = None, threshold: float = 0.8) -> DataFrame:
    """(step, key, value) of what the log event of each step publishes: its rollouts' measures, and the trainer's logs.

    The rollouts of a step are its window. Of each column in scores, whole numbers from 0 to 10, the valid ones, their
    share, mean and counts are told; positions names the column of sampled positions. Measures of nothing are left out.
    A step without rollouts has its logs alone, one without logs its rollouts' measures.
    """
    correct, eligible, scored, paired = C.kinds()
    measures = C.plain_measures(threshold) | {"answer_label_unavailable_count": F.count_if(~F.col("answer_label_available")), "visual_proxy_fallback_count": F.count_if(~eligible), "attempt_count": F.count("*")}
    for c in scores:
        measures |= {f"{c}/valid_count": F.count(c), f"{c}/coverage": F.count(c) / F.count("*"), f"{c}/mean": F.avg(c)} | {f"{c}/{i}_count": F.count_if(F.col(c) == i) for i in range(11)}
    at = F.lit("train/")
    frames = [(rollouts.groupBy(step).agg(*[c.alias(n) for n, c in measures.items()]), at)]
    frames += [(C.described(rollouts, [step], F.when(eligible, F.col("visual_proxy")), ends=False), F.lit("train/visual_proxy_stats/")), (C.described(rollouts, [step], F.col("vision_tokens"), ends=False), F.lit("train/vision_tokens/"))]
    for name, where, report, target in (("answer_ece10", scored, "answer_confidence", correct), ("visual_proxy_binned_mean_error10", paired, "visual_confidence", F.col("visual_proxy"))):
        bins = rollouts.where(where).groupBy(step, C.bin_of(F.col(report), 10).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(report) - F.avg(target)).alias("error"))
        frames.append((bins.groupBy(step).agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias(name)), at))
    if positions is not None:
        told = C.diagnostic_coverage(rollouts, step, positions).drop("attempts")
        frames.append((told.withColumnsRenamed({n: n.replace("diagnostic_", "opsd_diagnostic_") for n in told.columns}), at))
    out = [C.paths(f, [step], where, [n for n in f.columns if n != step]) for f, where in frames]
    errors = rollouts.select(step, F.explode("format_errors").alias("name")).where(F.col("name").rlike("^[A-Za-z0-9_]+$")).groupBy(step, "name").agg(F.count("*").cast("double").alias("value"))
    out += [errors.select(step, F.concat(F.lit("train/format_error_"), "name", F.lit("_count")).alias("measure"), "value"), trainer_logs(logs, step).withColumnRenamed("key", "measure")]
    return reduce(DataFrame.unionAll, out).where("value IS NOT NULL").withColumnRenamed("measure", "key")


class Falling(ValueError):
    """A counter of a run moved backwards."""


class Tracker:
    """Publishes the log events of one run: windows of rollouts, validations and counters, in order of its steps.

    rollouts wait until a training log flushes them; ``finish`` refuses a good end while some wait. evidence holds
    counters, of which ``successful`` may not fall.
    """

    def __init__(self, sink: Callable[[dict], None], report: Callable[[DataFrame], DataFrame], successful: str = "optimizer_successful_updates"):
        self.sink, self.report, self.successful = sink, report, successful
        self.waiting: list[DataFrame] = []
        self.last: int | None = None
        self.closed = False

    def _evidence(self, evidence: dict, step: int) -> dict:
        if self.closed:
            raise RuntimeError("the tracker has finished")
        counters = {k: v for k, v in {**evidence, "trainer/state_global_step": step}.items() if v is not None}
        if self.successful not in counters or any(type(v) is not int or v < 0 for v in counters.values()):
            raise ValueError("counters must be whole numbers from 0, and successful updates be among them")
        if self.last is not None and counters[self.successful] < self.last:
            raise Falling(f"{self.successful} fell from {self.last} to {counters[self.successful]}")
        self.last = counters[self.successful]
        return {k.replace("optimizer_", "optimizer/"): v for k, v in counters.items()}

    def record(self, rollouts: DataFrame) -> None:
        if self.closed:
            raise RuntimeError("the tracker has finished")
        self.waiting.append(rollouts)

    def log_training(self, evidence: dict, step: int, logs: DataFrame | None = None) -> None:
        """Flush what waits as one window of the report, with the counters and the trainer's logs (key, value)."""
        out = self._evidence(evidence, step)
        if logs is not None:
            out |= {r["key"]: r["value"] for r in trainer_logs(logs.withColumn("step", F.lit(step)), "step").collect()}
        if self.waiting:
            rows = self.waiting[0]
            for more in self.waiting[1:]:
                rows = rows.unionByName(more)
            found = self.report(rows).first()
            out |= {f"train/{k}": v for k, v in (found.asDict() if found else {}).items() if v is not None}
        self.sink(out)
        self.waiting.clear()

    def log_validation(self, report: DataFrame, names: list[str], evidence: dict, step: int) -> None:
        """The allowed measures of a validation report of one row, at the same counters."""
        out, found = self._evidence(evidence, step), report.first().asDict()
        self.sink(out | {f"validation/{n}": found[n] for n in names if found.get(n) is not None})

    def log_counters(self, evidence: dict, step: int) -> None:
        self.sink(self._evidence(evidence, step))

    def finish(self, good: bool = True) -> None:
        if not self.closed and good and self.waiting:
            raise RuntimeError("rollouts wait that no training log has flushed")
        self.closed = True


def falling_states(rows: DataFrame, run: str, step: str, counter: str) -> DataFrame:
    """Rows of a batch whose counter is below one of an earlier step of the run."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("highest", F.max(counter).over(before)).where(F.col(counter) < F.col("highest"))


class Counter(StatefulProcessor):
    """Keeps a run's last counters; rows that fall below it are told apart."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "successful long, attempted long")

    def handleInputRows(self, key, rows, timer_values):
        last = self.last.get() if self.last.exists() else (0, 0)
        done, tried, out = last[0], last[1], []
        # A micro-batch's steps of one run, two numbers each, are put in order together.
        steps, wins = [], []
        for frame in rows:
            steps.append(frame["step"].to_numpy(np.int64))
            wins.append(frame["success"].to_numpy(bool))
        steps, wins = np.concatenate(steps), np.concatenate(wins)
        for i in np.argsort(steps, kind="stable"):
            tried += 1
            done += int(wins[i])
            out.append((key[0], int(steps[i]), tried, done, tried - done))
        self.last.update((done, tried))
        yield pd.DataFrame(out, columns=["run", "step", "attempted", "successful", "skipped"])

    def close(self) -> None:
        pass


def running_counters(rows: DataFrame) -> DataFrame:
    """(run, step, attempted, successful, skipped) of a stream of (run, step, success), by the RocksDB state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("run").transformWithStateInPandas(Counter(), "run string, step long, attempted long, successful long, skipped long", "append", "none")
