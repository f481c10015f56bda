"""WARC archives: write tables of pages as gzipped archives, and read them with a Python data source.

The source plans one partition for a run of files of about PARTITION_BYTES. Predicates on the record type and on
headers are pushed down to it: they are tried on a record's parsed header block, and the block of a record that fails
is skipped without a look at it. With the option ``payload`` set to false no payload is decoded; set to ``digest`` it
is read for its length and SHA-1, which are columns, and not sent on.

Archives are reached through pyarrow's file systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from .shared import folder, ready, small, stored

PARTITION_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes that are inflated in one step: what a step leaves over is copied.
FED_BYTES = 1 << 16
#: Compressed bytes after which a task begins another archive: archives are read whole by a task.
ARCHIVE_BYTES = 256 << 20
SUFFIXES = (".warc", ".warc.gz")
#: Characters that would end a header line.
_BREAKS = str.maketrans("", "", "\r\n")
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, http_headers map<string,string>, payload binary, file string, place long, read_bytes long, read_digest string"
#: Columns that are headers; others are computed.
COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, whole: int, hashed: str, refers_to: str | None = None) -> bytes:
    """A record of a page: an HTTP response with its payload, or a revisit with the response's head alone.

    Both tell the payload's digest, and in the HTTP head its length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {whole}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri.translate(_BREAKS)}")
    head.append(f"WARC-Payload-Digest: sha1:{hashed}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {refers_to}")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record_id(page: object) -> str:
    return f"<urn:page:{page}>"


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row, and return the manifest (file, records, bytes) of the archives.

    Of rows whose payloads are equal and have at least ``least`` bytes, that with the largest key is the response and
    the others revisit it; rows that repeat that key and payload are responses too, and so are rows without a key when
    no equal payload has one. A null payload is an empty one, and an empty table makes no archives; texts of any length
    are one record each. Each task writes files under its partition's number, and moves them into place when all are
    whole: a task that runs again replaces them, so lost executors and double runs leave no part of a file. A folder
    that holds archives is refused.
    """
    spark = pages.sparkSession
    ready(spark)
    store, at = _opened(path)
    if any(i.path.endswith(SUFFIXES) for i in store.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True))):
        raise FileExistsError(f"{path} has archives")
    most = ARCHIVE_BYTES
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("html"))
    # A key for equal payloads: their SHA-1, so that texts don't move to be grouped.
    same = F.unhex(F.sha1(F.col("html").cast("binary")))
    keyed = rows.withColumn("same", same)
    newest = keyed.where(F.octet_length("html") >= least).groupBy("same").agg(F.max("id").alias("newest"), F.count("*").alias("rows"))
    newest = stored(newest.where("rows > 1").select("same", "newest"), "newest")
    dealt = keyed.join(small(newest), "same", "left").select("id", "url", "html", "newest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _opened(path)
        own, half = f"part-{TaskContext.get().partitionId():06d}-", f"{uuid.uuid4().hex}.tmp"
        folder_of, made, out = at.rstrip("/"), [], None
        for b in batches:
            for page, uri, text, newest in zip(b.column("id"), b.column("url"), b.column("html").cast(pa.large_binary()), b.column("newest"), strict=True):
                if out is None or made[-1][2] >= most:
                    if out is None:
                        store.create_dir(at, recursive=True)
                    else:
                        out.close()
                    made.append([f"{folder_of}/{own}{len(made):04d}.warc.gz", 0, 0])
                    out = store.open_output_stream(f"{made[-1][0]}.{half}", compression=None)
                page, newest, body = page.as_py(), newest.as_py(), text.as_py()
                revisit = newest is not None and page != newest
                member = gzip.compress(record("revisit" if revisit else "response", record_id(page), uri.as_py(), body, len(body), digest(body), record_id(newest) if revisit else None), 1, mtime=0)
                out.write(member)
                made[-1][1:] = made[-1][1] + 1, made[-1][2] + len(member)
        if out is None:
            return
        out.close()
        for info in store.get_file_info(arrow_fs.FileSelector(at)):  # of this task's earlier run
            if info.base_name.startswith(own) and info.base_name.endswith(SUFFIXES):
                store.delete_file(info.path)
        for name, _, _ in made:
            store.move(f"{name}.{half}", name)
        files, records, sizes = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{name.rsplit('/', 1)[1]}" for name in files]), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return stored(dealt.mapInArrow(work, "file string, records long, bytes long"), "archives")


# Reading.


class _Members:
    """The plain bytes of a stream of gzip members, or of a stream that isn't compressed."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.data, self.at, self.gone, self.end = raw, bytearray(), 0, 0, False
        self.block, self.used = raw.read(READ_BYTES), 0
        self.inflate = zlib.decompressobj(31) if self.block[:2] == b"\x1f\x8b" else None

    def _feed(self) -> None:
        """Take READ_BYTES more at most, however far the next bytes of the file inflate; drop what is passed."""
        if self.used == len(self.block):
            self.block, self.used = self.raw.read(READ_BYTES), 0
        piece = memoryview(self.block)[self.used : self.used + FED_BYTES]
        plain, left = piece, 0
        if self.inflate is not None:
            plain = self.inflate.decompress(piece, READ_BYTES)
            left = len(self.inflate.unused_data) + len(self.inflate.unconsumed_tail)
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.used += len(piece) - left
        self.end = not len(piece) and not len(plain)
        self.gone += self.at
        del self.data[: self.at]
        self.at = 0
        self.data += plain

    def fill(self, n: int) -> bool:
        """Have n bytes at hand, unless the stream ends."""
        while len(self.data) - self.at < n and not self.end:
            self._feed()
        return len(self.data) - self.at >= n

    def upto(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before the mark, which is passed; None, and nothing passed, where the next ``most`` bytes or the stream lack it."""
        searched = 0
        while (found := self.data.find(mark, self.at + searched, None if most is None else self.at + most)) < 0:
            have = len(self.data) - self.at
            searched = max(0, have - len(mark))
            if most is not None and have >= most or not self.fill(have + 1):
                return None
        out, self.at = bytes(self.data[self.at : found]), found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError("a record is shorter than its Content-Length")
        out, self.at = bytes(memoryview(self.data)[self.at : self.at + n]), self.at + n
        return out

    def skip(self, n: int) -> None:
        """Pass n bytes without keeping them."""
        while n:
            if not self.fill(1):
                raise EOFError("a record is shorter than its Content-Length")
            step = min(n, len(self.data) - self.at)
            self.at, n = self.at + step, n - step

    @property
    def place(self) -> int:
        return self.gone + self.at


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, _, rest = block.decode("utf-8", "replace").partition("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in rest.split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return first, out


@dataclass
class Files(InputPartition):
    """Files that one task reads, in order."""

    paths: tuple[str, ...]


def _test(f: Filter) -> tuple[str, object] | None:
    """A predicate that a header block decides, as (header, test); None for any other."""
    inner = f.child if isinstance(f, Not) else f
    at = getattr(inner, "attribute", ())
    if len(at) != 1 or at[0] not in COLUMNS:
        return None
    value = getattr(inner, "value", None)
    if isinstance(inner, (EqualTo, EqualNullSafe)):
        if isinstance(f, Not) and isinstance(inner, EqualNullSafe):
            return COLUMNS[at[0]], ("other", value)
        test = ("in", frozenset([value]))
    elif isinstance(inner, In):
        test = ("in", frozenset(value))
    elif isinstance(inner, IsNull):
        test = ("null", None)
    elif isinstance(inner, IsNotNull):
        test = ("known", None)
    elif isinstance(inner, StringStartsWith):
        test = ("starts", value)
    elif isinstance(inner, StringEndsWith):
        test = ("ends", value)
    elif isinstance(inner, StringContains):
        test = ("contains", value)
    else:
        return None
    return COLUMNS[at[0]], ("not", test) if isinstance(f, Not) else test


def _holds(value: str | None, test: tuple) -> bool:
    """As in SQL, only IS NULL and the null-safe forms hold for a header that is missing."""
    kind, arg = test
    if kind == "null":
        return value is None
    if kind == "known":
        return value is not None
    if kind == "other":
        return value != arg
    if kind == "not":
        return (value is not None if arg[0] == "null" else value is None) if arg[0] in ("null", "known") else value is not None and not _holds(value, arg)
    if value is None:
        return kind == "in" and None in arg
    return value in arg if kind == "in" else value.startswith(arg) if kind == "starts" else value.endswith(arg) if kind == "ends" else arg in value


def read_records(raw: io.RawIOBase, name: str, tests: list[tuple[str, tuple]], payload: str = "true") -> Iterator[tuple]:
    """Rows of SCHEMA of one archive. payload: true, false or digest."""
    stream = _Members(raw)
    while True:
        while stream.fill(2) and stream.data[stream.at : stream.at + 2] == b"\r\n":
            stream.skip(2)
        place = stream.place
        block = stream.upto(b"\r\n\r\n")
        if block is None:
            return
        version, head = _headers(block)
        if not version.startswith("WARC/"):
            raise ValueError(f"{name}: no record at {place}")
        # Values as the columns show them: the digest without the name of its algorithm.
        if "warc-payload-digest" in head:
            shown = head | {"warc-payload-digest": head["warc-payload-digest"].rpartition(":")[2]}
        else:
            shown = head
        length = int(head.get("content-length", 0))
        if not all(_holds(shown.get(h), t) for h, t in tests):
            stream.skip(length)
            continue
        http, body, many, hashed = None, None, None, None
        if head.get("content-type", "").startswith("application/http"):
            before = stream.place
            http_block = stream.upto(b"\r\n\r\n", length) or b""
            http = _headers(http_block)[1]
            length -= stream.place - before
        if payload == "false" or head.get("warc-type") == "revisit":
            stream.skip(length)
        else:
            body = stream.take(length)
            many, hashed = len(body), digest(body)
            body = None if payload == "digest" else body
        yield (*[shown.get(h) for h in COLUMNS.values()][:5], int(head.get("content-length", 0)), *[shown.get(h) for h in COLUMNS.values()][5:], head, http, body, name, place, many, hashed)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.payload = options["path"], str(options.get("payload", "true")).lower()
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        store, at = _opened(self.paths)
        prefix = self.paths[: len(self.paths) - len(at)] if self.paths.endswith(at) else ""
        infos = store.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True)) if store.get_file_info(at).type != arrow_fs.FileType.File else [store.get_file_info(at)]
        out, run, held = [], [], 0
        for info in sorted((i for i in infos if i.type == arrow_fs.FileType.File and i.path.endswith(SUFFIXES)), key=lambda i: i.path):
            if run and held + info.size > PARTITION_BYTES:
                out.append(Files(tuple(run)))
                run, held = [], 0
            run.append(prefix + info.path)
            held += info.size
        return [*out, Files(tuple(run))] if run or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            store, at = _opened(path)
            with store.open_input_stream(at, compression=None) as raw:
                yield from read_records(raw, path, self.tests, self.payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: path, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool | str = True) -> DataFrame:
    """Records of the archives in a folder, none of an empty one; payload: true, false, or "digest"."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write pages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Responses' payloads are read back, for length and digest; of revisits the headers alone. Without pages there are no
    rows; null keys stay null, and a null payload is an empty one.
    """
    spark = pages.sparkSession
    path = path or folder(spark, "warc")
    write(pages, path, least=least)

    def page(column: str):
        return F.regexp_extract(column, "^<urn:page:(.*)>$", 1)

    kind = dict(pages.dtypes)["page_id"]
    number = lambda column: F.when(page(column) != "None", page(column)).cast(kind)
    responses = read(spark, path, payload="digest").where("record_type = 'response'").select("record_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", "refers_to")
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    both = responses.unionAll(revisits)
    return both.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
