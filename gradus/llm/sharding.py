"""Size-tiered compaction of document shards, in DataFrame operations only.

An arrival is appended as it comes, as one run of small immutable files: no shuffle, one file a task or more. Runs of
similar size form a tier; a tier with enough runs is merged into files of about the target size by reading them and
writing fewer, larger ones, again without a shuffle. Every change is one new version of a manifest, a table of the live
runs, which is written aside and renamed into place: a reader sees all of a version or none, and a writer who finds the
version taken starts again from the new one. The manifest has a row a run, not a file: runs are few at any size.

Renaming without overwriting is atomic on HDFS and local disks. An object store needs a file system that renames so.
"""

from __future__ import annotations

import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import drop, filesystem, folder, fresh, small

TARGET_BYTES, FAN_IN, FLOOR_BYTES = 128 << 20, 4, 1 << 20
MANIFEST = "run string, files long, bytes long, rows long, tier int"
INDEX = "file string, bytes long, rows long, number long"


def tier_of(size: int, files: int, target: int, floor: int = FLOOR_BYTES, fan_in: int = FAN_IN) -> int:
    """-1 where files have half the target on average: done. Else 0 up to the floor, and one more for each factor of fan_in."""
    if files and size * 2 >= target * files:
        return -1
    return 0 if size <= floor else math.ceil(math.log(size / floor, fan_in))


class Shards:
    """A folder of shards of one schema, and of manifest versions."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema, self.target, self.fan_in = spark, root.rstrip("/"), schema, target, fan_in

    # Versions

    def _at(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def version(self) -> int:
        """The last committed version, 0 before the first: a binary search over names that exist without a gap."""
        def there(n: int) -> bool:
            fs, p = filesystem(self.spark, self._at(n))
            return fs.exists(p)

        low, high = 0, 1
        while there(high):
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return low

    def oldest(self) -> int:
        """The first version whose files are all there; earlier ones are vacuumed."""
        fs, p = filesystem(self.spark, f"{self.root}/oldest")
        return max([int(s.getPath().getName()[1:]) for s in fs.listStatus(p)], default=1) if fs.exists(p) else 1

    def manifest(self, version: int | None = None) -> list[Row]:
        """The live runs of a version, the last one by default, in order of their names."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(self._at(version)).orderBy("run").collect() if version else []

    def _commit(self, live: list[Row], version: int) -> bool:
        """Make ``live`` the next version; False if another writer was first."""
        aside = f"{self.root}/manifest/.aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame(live, MANIFEST).coalesce(1).write.parquet(aside)
        jvm = self.spark._jvm
        fs, at = filesystem(self.spark, aside)
        _, to = filesystem(self.spark, self._at(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(at, to, options)  # without OVERWRITE it refuses a name that exists
        except Py4JJavaError as e:
            fs.delete(at, True)
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    # Runs

    def _data(self, run: str) -> str:
        return f"{self.root}/data/{run}"

    def _index(self, run: str) -> str:
        return f"{self.root}/index/{run}"

    def _written(self, rows: DataFrame, least_tier: int = 0, rows_per_file: int = 0) -> Row:
        """Write a run and its index of files, numbered by name; returns its row of the manifest. It isn't live yet."""
        run = uuid.uuid4().hex
        rows.write.option("maxRecordsPerFile", rows_per_file).parquet(self._data(run))
        found = self.spark.read.schema(self.schema).parquet(self._data(run)).select("_metadata.file_path", "_metadata.file_size")
        found = found.groupBy(F.col("file_path").alias("file")).agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))
        # A row a file of one run.
        found.withColumn("number", (F.row_number().over(Window.orderBy("file")) - 1).cast("long")).write.parquet(self._index(run))
        files, size, many = self.spark.read.schema(INDEX).parquet(self._index(run)).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        tier = tier_of(size, files, self.target, fan_in=self.fan_in)
        return Row(run=run, files=files, bytes=size, rows=many, tier=tier if tier < 0 else max(tier, least_tier))

    def _forget(self, run: str) -> None:
        drop(self.spark, self._data(run))
        drop(self.spark, self._index(run))

    def append(self, arrivals: DataFrame, rows_per_file: int = 100_000) -> int:
        """Write arrivals as they are partitioned, as one run, and commit it; returns the version that has it first."""
        new = self._written(arrivals, rows_per_file=rows_per_file)
        while True:
            version = self.version()
            if self._commit([*self.manifest(version), *([new] if new["rows"] else [])], version + 1):
                if not new["rows"]:
                    self._forget(new["run"])
                return version + 1

    def compact(self, force: bool = False) -> bool:
        """Merge one tier, the lowest with FAN_IN runs; with force all that isn't done, if it has two files. False if there is none.

        The inputs stay as files until ``vacuum``: readers of older versions aren't disturbed. If another writer merges
        one of them first, this merge is dropped.
        """
        version = self.version()
        live = self.manifest(version)
        tiers: dict[int, list[Row]] = {}
        for run in live:
            if run["tier"] >= 0:
                tiers.setdefault(0 if force else run["tier"], []).append(run)
        ready = [t for t in sorted(tiers) if (sum(r["files"] for r in tiers[t]) >= 2 if force else len(tiers[t]) >= self.fan_in)]
        if not ready:
            return False
        inputs = tiers[ready[0]]
        names = {r["run"] for r in inputs}
        # Runs of a tier are alike, so equal numbers of their files make files alike; coalesce reads without a shuffle.
        count = max(1, round(sum(r["bytes"] for r in inputs) / self.target))
        try:
            new = self._written(self.spark.read.schema(self.schema).parquet(*map(self._data, sorted(names))).coalesce(count), ready[0] + 1)
        except (AnalysisException, Py4JJavaError):
            if names <= {r["run"] for r in self.manifest()}:
                raise
            return True  # someone else merged and vacuumed them
        if force:
            new = Row(**new.asDict() | {"tier": -1})
        while not self._commit([*(r for r in live if r["run"] not in names), new], version + 1):
            version = self.version()
            live = self.manifest(version)
            if not names <= {r["run"] for r in live}:
                self._forget(new["run"])
                return True
        return True

    def vacuum(self, keep: int = 1, abandoned_after: float | None = None) -> int:
        """Delete the runs that none of the last ``keep`` versions has; returns their number. Older versions can't be read then.

        Only runs that an earlier version had are deleted, so what another writer has written and not yet committed stays.
        Runs that no version ever had, left by a writer that died, go with ``abandoned_after``: seconds since they were
        last written, which must be longer than any write takes.
        """
        last = self.version()
        first, new = self.oldest(), max(1, last - keep + 1)
        kept = {r["run"] for v in range(new, last + 1) for r in self.manifest(v)}
        gone = {r["run"] for v in range(first, new) for r in self.manifest(v)} - kept
        fs, marker = filesystem(self.spark, f"{self.root}/oldest/v{new:08d}")
        fs.mkdirs(marker)
        fs, data = filesystem(self.spark, f"{self.root}/data")
        if abandoned_after is not None and fs.exists(data):
            known = kept | {r["run"] for v in range(new, self.version() + 1) for r in self.manifest(v)}
            before = (time.time() - abandoned_after) * 1000
            gone |= {s.getPath().getName() for s in fs.listStatus(data) if s.getModificationTime() < before} - known
        for run in gone:
            self._forget(run)
        return len(gone)

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All live rows; with a name for it, also the number of each row's shard, from 0 in order of runs and files."""
        if version is not None and not self.oldest() <= version <= self.version():
            raise ValueError(f"version {version} is vacuumed or not yet there")
        live = self.manifest(version)
        if not live:
            none = self.spark.createDataFrame([], self.schema)
            return none.withColumn(shard, F.lit(0).cast("long")) if shard else none
        rows = self.spark.read.schema(self.schema).parquet(*[self._data(r["run"]) for r in live])
        if shard is None:
            return rows
        before, parts = 0, []
        for r in live:
            parts.append((r["run"], before))
            before += r["files"]
        file, number, run = fresh(rows, "_file"), fresh(rows, "_number"), F.element_at(F.split("file", "/"), -2)
        # A row a live run, and a row a live file.
        index = self.spark.read.schema(INDEX).parquet(*[self._index(r["run"]) for r in live]).withColumn("run", run)
        index = index.join(small(self.spark.createDataFrame(parts, "run string, before long")), "run")
        index = index.select(F.col("file").alias(file), (F.col("before") + F.col("number")).alias(number))
        rows = rows.withColumn(file, F.col("_metadata.file_path"))
        return rows.join(small(index), file).select(*self.schema.names, F.col(number).alias(shard))


def shard(docs: DataFrame, root: str | None = None, target: int = TARGET_BYTES, fan_in: int = FAN_IN, arrivals: int = FAN_IN) -> Shards:
    """Append a table's rows as they are partitioned, in so many arrivals by a hash, and compact what there is to compact.

    All columns and rows are kept as they are: nulls, long texts and repeated rows play no part in the layout. Of an
    empty table the manifest has no runs. In a folder of its own, runs that are merged are deleted at once; in a folder
    that is given, which others may read, they stay until ``vacuum``.
    """
    spark = docs.sparkSession
    shards = Shards(spark, root or folder(spark, "shards"), docs.schema, target, fan_in)
    for n in range(arrivals):
        shards.append(docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(arrivals)) == n) if arrivals > 1 else docs)
        while shards.compact():
            if root is None:
                shards.vacuum()
    return shards
