"""Images in and out of gzipped tar archives that come in parts.

Reading is streamed, by a list of names, checked, and tolerant of a cut end. Writing is streamed too: a task holds one
file of an archive at a time. A gzipped tar is one stream, so an archive is one task's work, and archives are many.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .files import opened
from .scratch import stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The largest image that is taken.
MOST_BYTES = 64 << 20
FOUND = "label string, name string, width int, height int, bytes long, sha256 string, content binary, ignored long, truncated boolean, problem string"


class Joined(io.RawIOBase):
    """Files one after another, as one stream that only goes forward."""

    def __init__(self, paths: list[str]):
        super().__init__()
        self.left, self.now = list(paths), None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.now is None:
                if not self.left:
                    return 0
                store, at = opened(self.left.pop(0))
                self.now = store.open_input_stream(at, compression=None)
            data = self.now.read(len(into))
            if data:
                into[: len(data)] = data
                return len(data)
            self.now.close()
            self.now = None


def png_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a whole PNG whose chunks all have their checksums; else None."""
    if not data.startswith(SIGNATURE):
        return None
    at, size = len(SIGNATURE), None
    while at + 12 <= len(data):
        length, name = struct.unpack_from(">I4s", data, at)
        end = at + 12 + length
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if name == b"IHDR" and length == 13:
            size = struct.unpack_from(">II", data, at + 8)
        if name == b"IEND":
            return size if end == len(data) else None
        at = end
    return None


def images(paths: list[str], allowed: set[str], most: int = MOST_BYTES) -> Iterator[tuple[str | None, bytes | None, int, bool]]:
    """(name, content, 0, False) of allowed regular files at the top of an archive, whole ones; at the end (None, None, ignored, truncated)."""
    ignored, cut = 0, False
    try:
        with tarfile.open(fileobj=io.BufferedReader(Joined(paths), 1 << 20), mode="r|gz") as archive:
            for member in archive:
                if not member.isfile() or "/" in member.name or not member.name.lower().endswith(".png") or member.name not in allowed:
                    ignored += 1
                    continue
                if not 0 < member.size <= most:
                    raise ValueError(f"{member.name} has {member.size} bytes")
                content = archive.extractfile(member).read(member.size)
                if len(content) != member.size:
                    cut = True
                    break
                yield member.name, content, 0, False
    except (EOFError, OSError, tarfile.TarError, zlib.error):
        cut = True
    yield None, None, ignored, cut


def extracted(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """FOUND for each image, and one row without a name for each archive, with what it ignored and whether it was cut.

    archives: label, paths (its parts in order), allowed (names), complete (a cut end is a problem). problem tells of an
    image that is no whole PNG, and of a complete archive that is cut. One archive is one stream, read by one task; an
    empty table gives no rows. Archives are dealt over as many tasks as a shuffle has partitions.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for name, content, ignored, cut in images(r["paths"], set(r["allowed"]), most):
                    if name is None:
                        row = (r["label"], None, None, None, None, None, None, ignored, cut, "cut" if cut and r["complete"] else None)
                    else:
                        size = png_size(content)
                        row = (r["label"], name, *(size or (None, None)), len(content), hashlib.sha256(content).hexdigest(), content, None, None, None if size else "no PNG")
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]
    # The rows are small and their work is not: a number that is told keeps adaptive execution from joining them in one task.
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("label", "paths", "allowed", "complete").repartition(tasks, "label").mapInArrow(work, FOUND)


class Parts(io.RawIOBase):
    """A stream cut into files of at most so many bytes; a file takes its name when it is whole."""

    def __init__(self, path: str, most: int):
        super().__init__()
        self.path, self.most, self.sizes, self.out, self.held = path, most, [], None, 0
        self.store, self.at = opened(path)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        view = memoryview(data).cast("B")
        at = 0
        while at < len(view):
            if self.out is None:
                self.own = f"{self.at}.{uuid.uuid4().hex}"
                self.out, self.held = self.store.open_output_stream(self.own, compression=None), 0
            piece = view[at : at + self.most - self.held]
            self.out.write(piece)
            at, self.held = at + len(piece), self.held + len(piece)
            if self.held == self.most:
                self._named()
        return len(view)

    def _named(self) -> None:
        if self.out is None:
            return
        self.out.close()
        to = f"{self.at}.{len(self.sizes)}"
        # A task that runs twice makes the same bytes: the file that is there stays.
        if self.store.get_file_info(to).type == arrow_fs.FileType.NotFound:
            self.store.move(self.own, to)
        else:
            self.store.delete_file(self.own)
        self.sizes.append(self.held)
        self.out = None

    def close(self) -> None:
        if not self.closed:
            self._named()
        super().close()


class Archive:
    """A gzipped tar written member by member: the same bytes every time."""

    def __init__(self, raw: io.RawIOBase | io.BytesIO):
        self.zipped = gzip.GzipFile("", "wb", compresslevel=1, fileobj=raw, mtime=0)
        self.tar = tarfile.open(fileobj=self.zipped, mode="w|")

    def add(self, name: str, content: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(content)
        self.tar.addfile(info, io.BytesIO(content))

    def close(self) -> None:
        self.tar.close()
        self.zipped.close()


def packed(files: dict[str, bytes]) -> bytes:
    """A gzipped tar of files, the same bytes every time."""
    out = io.BytesIO()
    archive = Archive(out)
    for name, content in files.items():
        archive.add(name, content)
    archive.close()
    return out.getvalue()


def written(files: DataFrame, to: str, most: int = 64 << 20) -> DataFrame:
    """(label, paths, bytes) of an archive for each label of (label, name, content), written to a shared folder in parts of at most so many bytes.

    Files are named by the label's digest. Members stand in order of their names, and rows that repeat one in order of their content; a null content is an empty
    member. Rows without a label or a name are left out. An empty table writes nothing and gives no rows.
    """
    store, at = opened(to)
    store.create_dir(at, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts, archive = None, None, None

        def told() -> pa.RecordBatch:
            archive.close()
            parts.close()
            row = {"label": label, "paths": [f"{parts.path}.{i}" for i in range(len(parts.sizes))], "bytes": sum(parts.sizes)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("label", pa.string()), ("paths", pa.list_(pa.string())), ("bytes", pa.int64())]))

        for b in batches:
            for key, name, content in zip(*(b.column(c) for c in ("label", "name", "content")), strict=True):
                if key.as_py() != label:
                    if archive is not None:
                        yield told()
                    label = key.as_py()
                    parts = Parts(f"{to.rstrip('/')}/{hashlib.sha256(label.encode()).hexdigest()[:32]}", most)
                    archive = Archive(parts)
                archive.add(name.as_py(), content.as_py() or b"")
        if archive is not None:
            yield told()

    rows = files.where("label IS NOT NULL AND name IS NOT NULL").select("label", "name", F.col("content").cast("binary").alias("content"))
    return stored(rows.repartition("label").sortWithinPartitions("label", "name", "content").mapInArrow(work, "label string, paths array<string>, bytes long"), "archives")


def png(width: int, height: int, pixels: bytes, depth: int = 3) -> bytes:
    """A PNG of rows of 8-bit samples, three (RGB) or one (gray) a pixel; ValueError where there are more or fewer."""
    line = width * depth
    if len(pixels) != line * height:
        raise ValueError(f"{len(pixels)} samples, not {line * height}")

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))

    lines = b"".join(b"\0" + pixels[i * line : (i + 1) * line] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 1: 0}[depth], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


@F.arrow_udf(BinaryType())
def as_png(width: pa.Array, height: pa.Array, pixels: pa.Array) -> pa.Array:
    """Raw RGB pixels as a PNG; null where one of them is."""
    rows = zip(width.to_pylist(), height.to_pylist(), pixels.to_pylist(), strict=True)
    return pa.array([None if None in r else png(*r) for r in rows], pa.binary())


def gray_png(width: int, height: int, value: int = 127) -> bytes:
    """A small PNG of one gray, for fixtures."""
    return png(width, height, bytes([value]) * width * height, 1)
