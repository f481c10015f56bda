"""Digests and byte-frozen copies of files of any size: streamed in chunks, so a task's memory doesn't depend on a file's.

A file's SHA-256 is one chain and so one task's work; files are dealt over tasks by their bytes. Where that is too slow
for one file, ``range_digests`` has a digest for each range of it, made by many tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import ContractError

#: Bytes that a task holds of a file at a time.
CHUNK = 4 << 20
#: Copies that one call commits, as it does so one by one.
MOST_COPIES = 100_000


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store of a path or URI, and the path as it takes it; Hadoop writes local ones with a single slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return arrow_fs.FileSystem.from_uri(path) if ":" in path else (arrow_fs.LocalFileSystem(), path)


def chunks(path: str, size: int = CHUNK, start: int = 0, most: int | None = None) -> Iterator[bytes]:
    """A file's bytes from a place on, at most so many, in pieces of at most ``size``."""
    store, at = opened(path)
    if start:
        with store.open_input_file(at) as raw:
            raw.seek(start)
            yield from _read(raw, size, most)
    else:
        with store.open_input_stream(at, compression=None, buffer_size=0) as raw:
            yield from _read(raw, size, most)


def _read(raw: pa.NativeFile, size: int, most: int | None) -> Iterator[bytes]:
    left = most
    while left is None or left > 0:
        data = raw.read(size if left is None else min(size, left))
        if not data:
            return
        if left is not None:
            left -= len(data)
        yield data


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files of a folder and those below it, but for empty ones, which Spark's listing leaves out; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def digests(files: DataFrame) -> DataFrame:
    """(columns of files, bytes_read, sha256) of whole files, by their column ``file``; of a null one both are null."""
    return _folded(files, lambda r: chunks(r["file"]) if r["file"] is not None else None)


def range_digests(files: DataFrame, size: int = 64 << 20) -> DataFrame:
    """(columns of files, range, bytes_read, sha256) for each range of ``size`` bytes of files with ``bytes``; an empty one has none."""
    ranges = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / size).cast("long") - 1)
    dealt = files.where("bytes > 0").withColumn("range", F.explode(ranges)).repartition("file", "range")
    return _folded(dealt, lambda r: chunks(r["file"], start=r["range"] * size, most=size))


def _folded(rows: DataFrame, read) -> DataFrame:
    """Rows with the number of bytes that ``read`` gives of each, and their digest."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kind = pa.schema([("bytes_read", pa.int64()), ("sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, hashed = [], []
            for r in b.to_pylist():
                data = read(r)
                many, fold = 0, hashlib.sha256()
                for piece in data or ():
                    many += len(piece)
                    fold.update(piece)
                sizes.append(None if data is None else many)
                hashed.append(None if data is None else fold.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, kind[0].type), pa.array(hashed, kind[1].type)], [*b.schema.names, *kind.names])

    return rows.mapInArrow(work, f"{schema}, bytes_read long, sha256 string")


def joined_digests(archives: DataFrame) -> DataFrame:
    """(label, part, file, bytes, sha256, upto_sha256) for each part of (label, paths): of the part, and of all up to it.

    An archive's parts are read once, in order, by one task, as the digest of the whole is one chain.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                whole, out = hashlib.sha256(), []
                for i, path in enumerate(r["paths"] or ()):
                    many, part = 0, hashlib.sha256()
                    for piece in chunks(path):
                        many += len(piece)
                        part.update(piece)
                        whole.update(piece)
                    out.append((r["label"], i, path, many, part.hexdigest(), whole.copy().hexdigest()))
                if out:
                    columns = zip(*out, strict=True)
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "part", "file", "bytes", "sha256", "upto_sha256"])

    return archives.select(F.col("label").cast("string").alias("label"), "paths").mapInArrow(work, "label string, part int, file string, bytes long, sha256 string, upto_sha256 string")


def snapshot(spark: SparkSession, copies: DataFrame) -> DataFrame:
    """Copy exactly the first ``bytes`` of each (file, target, bytes): (file, target, bytes, sha256, problem).

    Sources may grow while they are read: what comes after those bytes isn't looked at. A copy is written aside, with a
    running digest, and appears under its name only when it is whole; a name that is taken keeps what it has. problem is
    null, ``short`` for a source with fewer bytes, or ``taken``. A task that runs again writes another copy aside, and
    only the one that it tells of is renamed. Copies are committed by the driver, one by one, so over MOST_COPIES of
    them are refused; their bytes never go through it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                aside = f"{r['target']}.{uuid.uuid4().hex}.tmp"
                store, at = opened(aside)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                fold, many = hashlib.sha256(), 0
                with store.open_output_stream(at, compression=None) as to:
                    for piece in chunks(r["file"], most=r["bytes"]):
                        to.write(piece)
                        fold.update(piece)
                        many += len(piece)
                out.append((r["file"], r["target"], many, fold.hexdigest(), aside, many < r["bytes"]))
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "target", "bytes", "sha256", "aside", "short"])

    asked = copies.select("file", "target", F.col("bytes").cast("long").alias("bytes"))
    made = asked.mapInArrow(work, "file string, target string, bytes long, sha256 string, aside string, short boolean").limit(MOST_COPIES + 1).collect()
    if len(made) > MOST_COPIES:
        raise ContractError(f"over {MOST_COPIES} copies at once")
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for r in made:
        aside, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (r["aside"], r["target"]))
        store, problem = aside.getFileSystem(hadoop), "short" if r["short"] else None
        if problem is None:
            try:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), hadoop)
                context.rename(aside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                problem = "taken"
        if problem is not None:
            store.delete(aside, False)
        out.append((r["file"], r["target"], r["bytes"], r["sha256"], problem))
    return spark.createDataFrame(out, "file string, target string, bytes long, sha256 string, problem string")
