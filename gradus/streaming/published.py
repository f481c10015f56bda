"""A streaming sink whose batches are published once each, whatever is run again.

Tasks write their rows aside as JSON lines. A batch is published by one file under its number, which names the parts and
is made without overwriting: a batch that comes again, as after a failure between publishing and Spark's own commit,
finds it there, and drops what it wrote. Readers see the parts that are named, and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import opened
from ..sources.scratch import importable

BATCH = "batch-{:012d}.json"


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    rows: int


class Writer(DataSourceStreamWriter):
    def __init__(self, path: str, fail_after: int | None):
        self.path, self.fail_after = path.rstrip("/"), fail_after

    def write(self, iterator: Iterator[Row]) -> Part:
        path, rows, to = f"{self.path}/parts/{uuid.uuid4().hex}.json", 0, None
        store, at = opened(path)
        for row in iterator:
            if to is None:
                store.create_dir(at.rpartition("/")[0], recursive=True)
                to = store.open_output_stream(at, compression=None)
            to.write(json.dumps(row.asDict(recursive=True), sort_keys=True, default=str).encode() + b"\n")
            rows += 1
        if to is not None:
            to.close()
        return Part(path if rows else None, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        """Called by the driver alone, one batch after another, so a look before writing suffices."""
        store, at = opened(f"{self.path}/{BATCH.format(batchId)}")
        if self._named(batchId) is not None:
            self.abort(messages, batchId)
            return
        parts = [m for m in messages if m is not None and m.path is not None]
        aside = f"{at}.{uuid.uuid4().hex}.tmp"
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(aside, compression=None) as to:
            to.write(json.dumps({"batch": batchId, "rows": sum(m.rows for m in parts), "parts": [m.path for m in parts]}).encode())
        store.move(aside, at)
        if batchId == self.fail_after:
            raise RuntimeError(f"failed after batch {batchId} was published")

    def _named(self, batch: int) -> set[str] | None:
        """The parts of a batch that is published; None for another."""
        store, at = opened(f"{self.path}/{BATCH.format(batch)}")
        if not store.get_file_info(at).is_file:
            return None
        with store.open_input_stream(at, compression=None) as raw:
            return set(json.loads(raw.read())["parts"])

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        """Drop what was written for a batch, but for the parts that it was published with: it may have failed after that."""
        named = self._named(batchId) or set()
        for m in messages:
            if m is not None and m.path is not None and m.path not in named:
                store, at = opened(m.path)
                if store.get_file_info(at).is_file:
                    store.delete_file(at)


class Published(DataSource):
    """Format ``published``: options path, and fail_after, a batch after which it fails, for tests."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def streamWriter(self, schema, overwrite: bool) -> Writer:
        fail = self.options.get("fail_after")
        return Writer(self.options["path"], None if fail is None else int(fail))


def publish_once(rows: DataFrame, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Publish what is there of a stream; started again with the same checkpoint it goes on."""
    importable(rows.sparkSession)
    rows.sparkSession.dataSource.register(Published)
    return rows.writeStream.format("published").options(path=path, **options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(batch, and the columns of schema) of all batches that are published."""
    manifests = spark.read.schema("batch long, rows long, parts array<string>").json(f"{path.rstrip('/')}/batch-*.json")
    named = manifests.selectExpr("batch", "explode(parts) AS part")
    rows = spark.read.schema(schema).json(f"{path.rstrip('/')}/parts").selectExpr("*", "_metadata.file_name AS _file")
    return rows.join(named.selectExpr("batch", "substring_index(part, '/', -1) AS _file"), "_file").drop("_file")
