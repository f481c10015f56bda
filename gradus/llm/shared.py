"""Shared storage, worker set-up and tokenising used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, as in the regular expression below.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Bytes of an Arrow batch, and words whose hashes a worker remembers: they bound a worker's memory.
BATCH_BYTES, REMEMBERED = 4 << 20, 200_000
ROOT = str(Path(__file__).resolve().parents[2])
_made: list[tuple[SparkSession, str]] = []


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound an Arrow batch by bytes as well as rows."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, dropped when the driver ends.

    The folder is spark.checkpoint.dir. Where that is unset, a temporary folder is set if the master is local, as in
    tests; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gradus-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    return path


def tidy() -> None:
    """Give a Python worker's free memory back, as the worker stays when its task has ended."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it takes it. For metadata only."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session ended first; a cluster's clean-up of its checkpoint folder has to do
            return


#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it. It survives the loss of any executor.

    The shuffle files of the plan that made it are dropped at once, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = folder(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def place(df: DataFrame) -> str:
    """The folder of a stored table."""
    return df._jdf.queryExecution().analyzed().relation().location().rootPaths().head().toString()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count of rows and bytes shows that the table is small; else leave it to a shuffled join.

    The count runs the table's plan: it is meant for stored tables, and for what is quickly made.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    width = sum(wide, F.lit(16 + 8 * len(df.columns)).cast("long"))
    many, size = df.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.sum("width")).first()
    return F.broadcast(df) if many <= rows and (size or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it for as long as a column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; bytes.split cuts at exactly the six ASCII spaces."""
    return text.lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are many, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: ASCII bytes that are neither letters, digits nor white space.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Numbers(dict):
    """Numbers of words in a vocabulary without ASCII punctuation at their ends; 0 for others, -1 where nothing is left.

    It forgets when it holds many, so memory is bounded.
    """

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(PUNCTUATION)
        value = self[word] = self.vocabulary.get(bare, 0) if bare else -1
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation at their ends; those of punctuation alone go."""
    return [w for w in (x.strip(PUNCTUATION) for x in words((text or "").encode())) if w]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser (murmur3's) that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of the whole sequence if it is shorter; none of none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
        out ^= out >> np.uint64(29)
    out = mix(out + np.uint64(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def as_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one text at a time."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py()
