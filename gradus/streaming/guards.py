"""Stateful checks of a run's events: counters that may not fall, windows that a log flushes, rollouts that are used once.

State is a few numbers a key, in the state store, so it outlives batches and restarts. Within a batch a key's rows are
put in order together; between batches the order is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.scratch import importable

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(rows: DataFrame) -> None:
    importable(rows.sparkSession)
    rows.sparkSession.conf.set(STORE, ROCKS)


def _sorted(frames: Iterator[pd.DataFrame], by: str) -> Iterator:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable").itertuples(index=False)


@contextmanager
def only_with_data(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here run batches with rows alone.

    State that expires by the clock, as that of ``replays``, has Spark run batches without rows for ever: a stream that
    is to end when all is read (``availableNow``) has to be started in here. The state expires all the same.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


class Rising(StatefulProcessor):
    """Keeps the highest accepted value of a run's counter; a lower one is refused and changes nothing."""

    def init(self, handle) -> None:
        self.highest = handle.getValueState("highest", "value double")

    def handleInputRows(self, key, rows, timer_values):
        before, out = self.highest.get()[0] if self.highest.exists() else None, []
        for r in _sorted(rows, "step"):
            if pd.isna(r.value):
                continue
            refused = before is not None and r.value < before
            out.append((key[0], int(r.step), float(r.value), before, refused))
            before = before if refused else float(r.value)
        if before is not None:
            self.highest.update((before,))
        yield pd.DataFrame(out, columns=["run", "step", "value", "highest", "refused"]).astype({"highest": object})

    def close(self) -> None:
        pass


def rising(rows: DataFrame) -> DataFrame:
    """(run, step, value, highest, refused) of a stream of (run, step, value): both what is accepted and what is refused.

    highest is the largest value accepted before, null at first. A null value is passed over.
    """
    _ready(rows)
    return rows.select(F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).groupBy("run").transformWithStateInPandas(Rising(), "run string, step long, value double, highest double, refused boolean", "append", "none")


class Windows(StatefulProcessor):
    """Holds a run's rollouts until a log flushes them, and tells of what is left when it ends."""

    def init(self, handle) -> None:
        self.waiting = handle.getValueState("waiting", "n long, total double")

    def handleInputRows(self, key, rows, timer_values):
        n, total = self.waiting.get() if self.waiting.exists() else (0, 0.0)
        out = []
        for r in _sorted(rows, "step"):
            if r.event == "rollout":
                n, total = n + 1, total + float(0 if pd.isna(r.value) else r.value)
            elif r.event == "log" or r.event == "end" and n:
                out.append((key[0], int(r.step), r.event, n, total, False))
                n, total = 0, 0.0
            elif r.event == "finish":
                out.append((key[0], int(r.step), r.event, n, total, n > 0))
        self.waiting.update((n, total))
        yield pd.DataFrame(out, columns=["run", "step", "event", "n", "total", "refused"])

    def close(self) -> None:
        pass


def flushed(rows: DataFrame) -> DataFrame:
    """(run, step, event, n, total, refused) of a stream of (run, step, event, value).

    Rollouts wait. A ``log`` flushes them, be they none; ``end`` flushes the last, incomplete window, if there is one;
    ``finish`` asks for a good end of the run, which is refused while rollouts wait and flushes nothing. Others pass.
    """
    _ready(rows)
    rows = rows.select(F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), "event", F.col("value").cast("double").alias("value"))
    return rows.groupBy("run").transformWithStateInPandas(Windows(), "run string, step long, event string, n long, total double, refused boolean", "append", "none")


#: What a scored rollout must share with the one that was generated, in the order in which faults are told.
EQUALITIES = ("model_version", "prompt_sha256", "example_sha256", "completion_sha256")


class Replays(StatefulProcessor):
    """Remembers what was generated under a nonce until it is used, and tells what of a scored rollout differs."""

    def __init__(self, version: int, expires: int):
        self.version, self.expires = version, expires

    def init(self, handle) -> None:
        self.pending = handle.getValueState("pending", "model_version long, prompt_sha256 string, example_sha256 string, completion_sha256 string", self.expires)

    def handleInputRows(self, key, rows, timer_values):
        pending, out = self.pending.get() if self.pending.exists() else None, []
        for r in _sorted(rows, "step"):
            own = (_whole(r.model_version), r.prompt_sha256, r.example_sha256, r.completion_sha256)
            if r.event == "generated":
                pending = own
            elif r.event == "scored":
                if pending is None:
                    faults = ["nonce"]
                else:
                    faults = [name for name, a, b in zip(EQUALITIES, own, pending, strict=True) if a != b]
                    if "model_version" not in faults and own[0] != self.version:
                        faults.insert(0, "model_version")
                if not faults:
                    pending = None
                out.append((key[0], int(r.step), faults))
        if pending is None:
            self.pending.clear()
        else:
            self.pending.update(pending)
        yield pd.DataFrame(out, columns=["nonce", "step", "faults"])

    def close(self) -> None:
        pass


def replays(rows: DataFrame, version: int, expires: int = 3_600_000) -> DataFrame:
    """(nonce, step, faults) for each ``scored`` row of a stream of (nonce, step, event, and the columns of EQUALITIES).

    A rollout is fresh, with no faults, if one was ``generated`` under its nonce and not used yet, and both have the
    current model version, and the same prompt, example and completions. A fresh one uses its nonce up: from then on
    there is the fault ``nonce``, as for one that nothing was generated for. What is never used is forgotten after so
    many milliseconds, so the state is what was generated in that time. To read what is there and end, see
    ``only_with_data``.
    """
    _ready(rows)
    rows = rows.select(F.col("nonce").cast("string").alias("nonce"), F.col("step").cast("long").alias("step"), "event", F.col("model_version").cast("long").alias("model_version"), *EQUALITIES[1:])
    return rows.groupBy("nonce").transformWithStateInPandas(Replays(version, expires), "nonce string, step long, faults array<string>", "append", "processingTime")
