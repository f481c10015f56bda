"""Media columns: sniff what bytes really are, check their structure, correct declared types and carve embedded media.

An Aho-Corasick automaton finds every known signature in one pass over the bytes. At each hit a validator of that
format walks the structure and gives the length of the whole file, or nothing where lengths, checksums or bounds don't
hold. What is valid at the first byte decides the type; the rest are embedded files and can be cut out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import as_bytes, ready, tidy

Span = int | None
#: Of one blob, what a walk found from a place on, by (format, place): starts of one format that come to the same place
#: share the rest of the walk, so a blob of nothing but signatures takes no more steps than it has bytes.
Seen = dict[tuple[str, int], object]


def _chain(p: Span, step: Callable[[int], Span], is_end: Callable[[int], bool], kind: str, seen: Seen) -> Span:
    """Where a chain of parts that begins at p ends: after the first part that is an end, or None where a part can't be."""
    walked, out = [], None
    while p is not None:
        if (kind, p) in seen:
            out = seen[kind, p]
            break
        walked.append(p)
        following = step(p)
        if following is not None and is_end(p):
            out = following
            break
        p = following
    for q in walked:
        seen[kind, q] = out
    return out

# Fixed values of the formats: signatures, and where in a file they stand.
SIGNATURES = {
    b"RIFF": ("riff", 0), b"BM": ("bmp", 0), b"\x89PNG\r\n\x1a\n": ("png", 0), b".snd": ("au", 0), b"P5\n": ("pgm", 0), b"P5 ": ("pgm", 0),
    b"GIF87a": ("gif", 0), b"GIF89a": ("gif", 0), b"\xff\xd8\xff": ("jpeg", 0), b"MThd": ("midi", 0), b"OggS": ("ogg", 0), b"ftyp": ("mp4", 4),
}
MIME = {"wav": "audio/wav", "webp": "image/webp", "avi": "video/avi", "bmp": "image/bmp", "png": "image/png", "au": "audio/basic", "pgm": "image/x-portable-graymap", "gif": "image/gif", "jpeg": "image/jpeg", "midi": "audio/midi", "ogg": "audio/ogg", "mp4": "video/mp4"}


@dataclass(frozen=True)
class Found:
    """A valid file in some bytes, and the number of valid files around it."""

    kind: str
    start: int
    length: int
    depth: int = 0


def _riff(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I", b, at + 4)[0], bytes(b[at + 8 : at + 12])
    kind = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form)
    end, p = at + 8 + size, at + 12
    if kind is None or end > len(b):
        return None
    seen = []
    while p + 8 <= end:
        name, n = bytes(b[p : p + 4]), struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        seen.append(name)
        p += 8 + n + (n & 1)
    if p < end or not seen or kind == "wav" and not {b"fmt ", b"data"} <= set(seen):
        return None
    return kind, 8 + size


def _bmp(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, _, offset, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    if not 14 + header <= offset <= size or packed == 0 and offset + rows > size or at + size > len(b):
        return None
    return "bmp", size


def _png(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    def chunk(p: int) -> Span:
        n = struct.unpack_from(">I", b, p)[0] if p + 12 <= len(b) else len(b)
        return p + 12 + n if p + 12 + n <= len(b) else None

    def last(p: int) -> bool:
        return b[p + 4 : p + 8] == b"IEND"

    first = at + 8
    if b[first : first + 8] != b"\0\0\0\x0dIHDR":
        return None
    end = _chain(first, chunk, last, "png", seen)
    # Checksums are made where there is an end to come to, and once for each place of a chunk.
    whole = lambda p: p + 4 if zlib.crc32(b[p + 4 : chunk(p) - 4]) == struct.unpack_from(">I", b, chunk(p) - 4)[0] else None
    if end is None or _chain(first, lambda p: chunk(p) if whole(p) else None, last, "png, summed", seen) is None:
        return None
    return "png", end - at


def _au(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    if at + 24 > len(b):
        return None
    offset, size, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if offset < 24 or not 1 <= code <= 27 or not rate or not 1 <= channels <= 64 or size == 0xFFFFFFFF or at + offset + size > len(b):
        return None
    return "au", offset + size


def _pgm_head(b: memoryview, at: int) -> tuple[int, int, int, int] | None:
    """Width, height, largest value, and place of the samples."""
    head, p = [], at + 2
    for _ in range(3):
        while p < len(b) and b[p] in b" \t\r\n#":
            if b[p] == 35:  # a comment runs to the end of its line
                while p < len(b) and b[p] not in b"\r\n":
                    p += 1
            else:
                p += 1
        q = p
        while q < len(b) and 48 <= b[q] <= 57 and q - p < 10:
            q += 1
        if q == p or q >= len(b) or b[q] not in b" \t\r\n":
            return None
        head.append(int(bytes(b[p:q])))
        p = q
    return (*head, p + 1)


def _pgm(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    found = _pgm_head(b, at)
    if found is None:
        return None
    width, height, top, p = found
    p -= 1
    size = width * height * (1 if top < 256 else 2)
    if not width or not height or not 0 < top < 65536 or p + 1 + size > len(b):
        return None
    return "pgm", p + 1 + size - at


def _gif(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None

    def colours(p: int) -> int:
        return 3 << (b[p] & 7) + 1 if b[p] & 128 else 0

    def blocks(p: int) -> Span:
        return _chain(p, lambda q: q + 1 + b[q] if q < len(b) else None, lambda q: b[q] == 0, "gif, blocks", seen)

    def part(p: int) -> Span:
        if p >= len(b):
            return None
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            return blocks(p + 2)
        return blocks(p + 10 + colours(p + 9) + 1) if b[p] == 0x2C and p + 10 < len(b) else None

    end = _chain(at + 13 + colours(at + 10), part, lambda p: b[p] == 0x3B, "gif", seen)
    return None if end is None else ("gif", end - at)


def _jpeg(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xD9:
            return ("jpeg", p + 2 - at) if frame else None
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:
            # Samples run to the first marker: from any place before it, to the same one.
            raw, q, runs = b.obj, p, []
            while ("jpeg", q) not in seen:
                runs.append(q)
                q = raw.find(b"\xff", q)
                if q < 0 or q + 1 >= len(raw) or not (raw[q + 1] == 0 or 0xD0 <= raw[q + 1] <= 0xD7):
                    break
                q += 2
            else:
                q = seen["jpeg", q]
            for r in runs:
                seen["jpeg", r] = q
            if q < 0 or q + 1 >= len(raw):
                return None
            p = q
            if raw[q + 1] == 0xD9:
                return ("jpeg", p + 2 - at) if frame else None
    return None


def _midi(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    if at + 14 > len(b) or struct.unpack_from(">I", b, at + 4)[0] != 6:
        return None
    form, tracks, _ = struct.unpack_from(">HHH", b, at + 8)
    p = at + 14
    for _ in range(tracks):
        if p + 8 > len(b) or bytes(b[p : p + 4]) != b"MTrk":
            return None
        p += 8 + struct.unpack_from(">I", b, p + 4)[0]
    return ("midi", p - at) if form < 3 and tracks and p <= len(b) else None


def _ogg(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    def page(p: int) -> Span:
        if p + 27 > len(b) or b[p : p + 4] != b"OggS" or b[p + 4] != 0 or p + 27 + b[p + 26] > len(b):
            return None
        end = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        return end if end <= len(b) else None

    end = _chain(at, page, lambda p: bool(b[p + 5] & 4), "ogg", seen)
    return None if end is None else ("ogg", end - at)


def _mp4(b: memoryview, at: int, seen: Seen) -> tuple[str, int] | None:
    """A run of boxes as far as they go on; what it holds from each of them on is remembered."""
    walked, p, found = [], at, (at, False)
    while True:
        if ("mp4", p) in seen:
            found = seen["mp4", p]
            break
        n, name = struct.unpack_from(">I4s", b, p) if p + 8 <= len(b) else (0, b"")
        if n < 8 or p + n > len(b) or not name.isalnum():
            found = seen["mp4", p] = p, False
            break
        walked.append((p, name == b"moov"))
        p += n
    for p, moov in reversed(walked):
        found = seen["mp4", p] = found[0], found[1] or moov
    return ("mp4", found[0] - at) if found[0] > at and found[1] else None


VALIDATORS: dict[str, Callable[[memoryview, int, Seen], tuple[str, int] | None]] = {"riff": _riff, "bmp": _bmp, "png": _png, "au": _au, "pgm": _pgm, "gif": _gif, "jpeg": _jpeg, "midi": _midi, "ogg": _ogg, "mp4": _mp4}


def automaton() -> ahocorasick.Automaton:
    """Of the signatures; bytes are held as Latin-1 text, one character each."""
    out = ahocorasick.Automaton()
    for magic, (kind, offset) in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + offset))
    out.make_automaton()
    return out


def sniff(blob: bytes, magic: ahocorasick.Automaton) -> list[Found]:
    """Valid files in order of their starts; any two are apart or one is wholly inside the other.

    At each place the first that holds counts, and one that begins inside another must end in it.
    """
    out, view, around, seen = [], memoryview(blob), [], {}
    for end, (kind, back) in magic.iter(blob.decode("latin-1")):
        start = end - back
        if start < 0 or out and start <= out[-1].start:
            continue
        while around and around[-1] <= start:
            around.pop()
        valid = VALIDATORS[kind](view, start, seen)
        if valid and (not around or start + valid[1] <= around[-1]):
            out.append(Found(valid[0], start, valid[1], len(around)))
            around.append(start + valid[1])
    return out


# Writers and readers of 8-bit samples, one byte each.

UNIT = 576


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))


def encode(samples: bytes, kind: str) -> bytes:
    """A file of one kind with these samples; their number is a multiple of UNIT."""
    n, rows = len(samples), len(samples) // UNIT
    if kind == "wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + samples
    if kind == "au":
        return b".snd" + struct.pack(">IIIII", 24, n, 2, 8000, 1) + samples
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (UNIT, rows) + samples
    if kind == "bmp":
        gray = b"".join(bytes((v, v, v, 0)) for v in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, UNIT, -rows, 1, 8, 0, n, 2835, 2835, 256, 256) + gray + samples
    if kind == "png":
        lines = b"".join(b"\0" + samples[i : i + UNIT] for i in range(0, n, UNIT))
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")
    raise ValueError(f"no writer for {kind}")


def cut(blob: bytes, found: Found) -> memoryview:
    """The bytes of a valid file."""
    return memoryview(blob)[found.start : found.start + found.length]


def decode(blob: bytes, found: Found) -> bytes | None:
    """The 8-bit samples of a valid file; None for kinds and forms without a reader."""
    b = memoryview(blob)[found.start : found.start + found.length]
    if found.kind == "wav":
        p, form = 12, None
        while p + 8 <= len(b):
            n = struct.unpack_from("<I", b, p + 4)[0]
            if bytes(b[p : p + 4]) == b"fmt ":
                form = struct.unpack_from("<H", b, p + 8)[0], struct.unpack_from("<H", b, p + 22)[0]
            if bytes(b[p : p + 4]) == b"data":
                return bytes(b[p + 8 : p + 8 + n]) if form == (1, 8) else None
            p += 8 + n + (n & 1)
    if found.kind == "au":
        offset, n, code = struct.unpack_from(">III", b, 4)
        return bytes(b[offset : offset + n]) if code == 2 else None
    if found.kind == "pgm":
        width, height, top, head = _pgm_head(b, 0)
        return bytes(b[head : head + width * height]) if top < 256 else None
    if found.kind == "bmp":
        offset, _, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", b, 10)
        if depth != 8 or packed:
            return None
        stride = (width + 3) // 4 * 4
        order = range(-height) if height < 0 else range(height - 1, -1, -1)
        return b"".join(bytes(b[offset + r * stride : offset + r * stride + width]) for r in order)
    if found.kind == "png":
        p, data, form = 8, [], None
        while p + 12 <= len(b):
            n, name = struct.unpack_from(">I", b, p)[0], bytes(b[p + 4 : p + 8])
            if name == b"IHDR":
                form = struct.unpack_from(">IIBBBBB", b, p + 8)
            if name == b"IDAT":
                data.append(bytes(b[p + 8 : p + 8 + n]))
            p += 12 + n
        if form is None or form[2:] != (8, 0, 0, 0, 0):
            return None
        raw, width = zlib.decompress(b"".join(data)), form[0] + 1
        if len(raw) != width * form[1] or any(raw[i] for i in range(0, len(raw), width)):
            return None
        return b"".join(raw[i + 1 : i + width] for i in range(0, len(raw), width))
    return None


STORED_KINDS = ("wav", "bmp", "png", "au", "pgm")


def stored_kind(samples: bytes) -> str:
    return STORED_KINDS[zlib.crc32(samples) % len(STORED_KINDS)]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, declared, media): each text as a media file of 8-bit samples.

    Null is an empty text. Repeated rows stay, texts may be of any length, and an empty table gives no rows; a key may
    be null, and other columns play no part. The kind follows from the bytes; the declared type is that of the kind before, wrong on
    purpose, as crawled types often are.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, declared, media = [], [], []
            for raw in as_bytes(b.column("text")):
                samples = padded(raw or b"")
                kind = stored_kind(samples)
                n.append(len(raw or b""))
                declared.append(MIME[STORED_KINDS[STORED_KINDS.index(kind) - 1]])
                media.append(encode(samples, kind))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["id", "n_bytes", "declared", "media"])

    return docs.mapInArrow(_bounded(work), f"id {dict(docs.dtypes)['id']}, n_bytes long, declared string, media binary").withColumnRenamed("id", key)


#: Bytes of input that a batch of media is made from: outputs stay far below what an Arrow column can hold.
MADE_FROM = 64 << 20


def _bounded(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on slices of batches, each of about MADE_FROM bytes or one row."""
    most = MADE_FROM

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * most // max(most, b.nbytes))
            for at in range(0, b.num_rows, step):
                yield from work(iter([b.slice(at, step)]))
        tidy()

    return sliced


def _feature(kind: str | None, samples: bytes | None, embedded: int) -> str:
    if samples is None:
        return f"{kind or 'unknown'};embedded={embedded}"
    if not samples:
        return f"{kind};n=0;embedded={embedded}"
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    total, values = int(counts.sum()), np.flatnonzero(counts)
    mean = int((counts * np.arange(256)).sum()) / total
    return f"{kind};n={total};min={values[0]};max={values[-1]};mean={mean:.4f};distinct={len(values)};embedded={embedded}"


def inspect(table: DataFrame, key: str, media: str = "media", declared: str | None = "declared", extra: list[str] | None = None) -> DataFrame:
    """What a column of bytes holds, one row for each of its rows.

    key and extra columns, then media_type (null where nothing valid starts the bytes), corrected (the declared type
    was another), files: the valid files' kind, start, length, depth and
    digest, in order, those inside others too; payload facts of the first one's samples
    (payload_bytes, payload_sha256, tail_crc32, null where it has no reader), media_bytes, media_sha256 and a feature.
    Null media is like empty bytes; repeated rows are all kept.
    """
    ready(table.sparkSession)
    passed = [key, *(extra or [])]
    told = F.col(declared) if declared else F.lit(None).cast("string")
    schema = table.select(*passed).schema
    made_here = StructType.fromDDL("media_type string, corrected boolean, files array<struct<kind:string,start:long,length:long,depth:int,sha256:string>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    for field in made_here:
        schema = schema.add(field)
    files_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32()), ("sha256", pa.string())]))
    kinds = [pa.string(), pa.bool_(), files_kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for b in batches:
            rows = []
            for said, raw in zip(b.column(b.num_columns - 2), as_bytes(b.column(b.num_columns - 1)), strict=True):
                blob = raw or b""
                found = sniff(blob, magic)
                first = found[0] if found and found[0].start == 0 else None
                samples = decode(blob, first) if first else None
                kind = MIME[first.kind] if first else None
                rows.append((
                    kind, kind is not None and said.as_py() != kind, [{"kind": f.kind, "start": f.start, "length": f.length, "depth": f.depth, "sha256": hashlib.sha256(cut(blob, f)).hexdigest()} for f in found],
                    None if samples is None else len(samples), None if samples is None else hashlib.sha256(samples).hexdigest(), None if samples is None else zlib.crc32(samples[-32:]),
                    len(blob), hashlib.sha256(blob).hexdigest(), _feature(first and first.kind, samples, len(found) - (first is not None)),
                ))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], [*b.schema.names[:-2], *schema.names[len(passed) :]])

    return table.select(*passed, told.alias("_declared"), F.col(media).alias("_media")).mapInArrow(work, schema)


def carve(table: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, place, media_type, media): every valid file in the bytes, cut out, those inside others too.

    The first may be the whole. Null and empty bytes, and those without a valid file, give no row; repeated rows give
    theirs each. Pieces go out in batches of bounded size.
    """
    ready(table.sparkSession)
    rows = table.select(F.col(key).alias("id"), F.col(media).alias("media"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for b in batches:
            at, place, kind, out = [], [], [], []
            for i, raw in enumerate(as_bytes(b.column("media"))):
                for f in sniff(raw or b"", magic):
                    at.append(i)
                    place.append(f.start)
                    kind.append(MIME[f.kind])
                    out.append(cut(raw, f))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(place, pa.int64()), pa.array(kind, pa.string()), pa.array(out, pa.binary())], ["id", "place", "media_type", "media"])

    return rows.mapInArrow(_bounded(work), f"id {dict(rows.dtypes)['id']}, place long, media_type string, media binary").withColumnRenamed("id", key)
