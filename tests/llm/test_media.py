import hashlib
import random
import struct
import time
import zlib

import pytest

from gradus.llm import media

MAGIC = media.automaton()
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"
MIDI = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04cd\xff\xda\0\x04ef" + b"\x11\xff\0\x22\xff\xd0\x33" + b"\xff\xd9"
MP4 = struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov"
OGG = b"OggS\0\x04" + bytes(20) + b"\x01\x05hello"


@pytest.mark.parametrize("kind", media.STORED_KINDS)
@pytest.mark.parametrize("text", ["", "x", "a" * 576, "BM RIFF GIF89a P5\n1 1\n255\n" * 50, "é\n" * 4000])
def test_round_trip(kind, text):
    samples = media.padded(text.encode())
    assert len(samples) % 576 == 0 and samples
    blob = media.encode(samples, kind)
    found = media.sniff(blob, MAGIC)
    assert (found[0].kind, found[0].start, found[0].length) == (kind, 0, len(blob))
    assert media.decode(blob, found[0]) == samples


@pytest.mark.parametrize(("kind", "blob"), [("gif", GIF), ("midi", MIDI), ("jpeg", JPEG), ("mp4", MP4), ("ogg", OGG)])
def test_other_kinds(kind, blob):
    assert [(f.kind, f.start, f.length) for f in media.sniff(b"junk" + blob + b"more", MAGIC)] == [(kind, 4, len(blob))]
    for cut in range(1, len(blob)):
        assert media.sniff(blob[:cut], MAGIC) == [], cut


@pytest.mark.parametrize("kind", media.STORED_KINDS)
def test_broken_files_are_refused(kind):
    blob = media.encode(media.padded(b"text"), kind)
    assert media.sniff(blob[:-1], MAGIC) == []
    if kind == "png":
        assert media.sniff(blob[:40] + bytes([blob[40] ^ 1]) + blob[41:], MAGIC) == []


def test_files_inside_files():
    """A PNG in a WAV's samples, a GIF in that WAV too, and one that runs beyond its end."""
    png = media.encode(media.padded(b"inner"), "png")
    wav = media.encode(media.padded(b"ab" + png + b"cd" + GIF), "wav")
    found = media.sniff(b"x" + wav + MIDI, MAGIC)
    assert [(f.kind, f.start, f.length, f.depth) for f in found] == [("wav", 1, len(wav), 0), ("png", 1 + 44 + 2, len(png), 1), ("gif", 1 + 44 + 2 + len(png) + 2, len(GIF), 1), ("midi", 1 + len(wav), len(MIDI), 0)]
    twice = media.encode(media.padded(wav), "au")
    assert [f.depth for f in media.sniff(twice, MAGIC)] == [0, 1, 2, 2]
    short = bytearray(media.encode(media.padded(b""), "wav"))
    short[-10:] = GIF[:10]
    assert [f.kind for f in media.sniff(bytes(short) + GIF[10:], MAGIC)] == ["wav"]


def test_comments_in_a_head():
    blob = b"P5\n# made by hand\n3 2 # size\n255\n" + bytes(range(6))
    found = media.sniff(blob, MAGIC)
    assert [(f.kind, f.length) for f in found] == [("pgm", len(blob))] and media.decode(blob, found[0]) == bytes(range(6))


def test_every_document_is_read_back(spark):
    """Over the whole table, against plain code."""
    import os

    from gradus.llm.queries import op2_media_columns
    from tests.oracle import FOLDER

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op2_media_columns(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        padded = texts[r["doc_id"]] + b"\xff" * (-len(texts[r["doc_id"]]) % 576 or (0 if texts[r["doc_id"]] else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        media_of = media.encode(padded, media.stored_kind(padded))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media_of), hashlib.sha256(media_of).hexdigest())


def test_store_inspect_and_carve(spark):
    rows = [(1, "one"), (2, None), (3, ""), (1, "one"), (None, "z" * 200_000)]
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
    got = media.inspect(stored, "doc_id", extra=["n_bytes"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "one", 2: "", 3: "", None: "z" * 200_000}[r["doc_id"]].encode()
        padded = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["corrected"] and r["media_bytes"] == r["files"][0]["length"]
    wav = media.encode(media.padded(b"in"), "wav")
    table = spark.createDataFrame([(1, bytearray(b"head" + wav + GIF + b"tail")), (2, None), (3, bytearray(b"nothing"))], "id long, media binary")
    assert [(r["id"], r["place"], r["media_type"], bytes(r["media"])) for r in media.carve(table, "id").orderBy("place").collect()] == [(1, 4, "audio/wav", wav), (1, 4 + len(wav), "image/gif", GIF)]
    none = media.inspect(table, "id", declared=None).where("id > 1").collect()
    assert [(r["media_type"], r["corrected"], r["payload_bytes"]) for r in none] == [(None, False, None)] * 2


def test_empty(spark):
    stored = media.store(spark.createDataFrame([], "doc_id long, text string"))
    assert media.inspect(stored, "doc_id").count() == 0
    assert media.carve(stored, "doc_id").count() == 0


@pytest.mark.parametrize("unit", [*media.SIGNATURES, b"\0\0\0\x08ftyp", b"\0\0\0\x08ftyp\0\0\0\x08moov", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + bytes(17), b"GIF89a" + bytes(7) + b"!\xf9\x01x", b"\xff\xd8\xff\xe0\0\x02\xff\xc0\0\x02\xff\xda\0\x02", b"\xff\xd8\xff\xda\0\x02\xff\0", b"OggS" + bytes(22) + b"\x01\x01x", b"MThd\0\0\0\x06\0\x01\xff\xff\0\x01MTrk\0\0\0\0", b".snd\0\0\0\x18\0\0\0\x04\0\0\0\x01\0\0\0\x01\0\0\0\x01"])
def test_a_megabyte_of_signatures(unit):
    """Walks of one format that meet share what follows, so no blob takes the square of its size."""
    began = time.process_time()
    media.sniff(unit * ((1 << 20) // len(unit)), media.automaton())
    assert time.process_time() - began < 8


def test_shared_walks_find_what_single_ones_do():
    """Each start of a blob of many formats, validated with what others found before and without it."""
    rng = random.Random(5)
    parts = [media.encode(bytes(576), k) for k in ("wav", "au", "pgm", "bmp", "png")] + [b"\0\0\0\x08ftyp", b"\0\0\0\x08moov", b"\0\0\0\x10freeftyp\0\0\0\x08", b"GIF89a" + bytes(7) + b"!\xf9\x01x\0;", b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02ab\xff\0\xff\xd9", b"OggS\0\x04" + bytes(20) + b"\x01\x01x", b"OggS\0\0" + bytes(20) + b"\x01\x01x", b"\xff\xd8\xff\xda\0\x02", b"xyz"]
    for _ in range(40):
        blob = b"".join(rng.choice(parts) for _ in range(30))
        blob = blob[: rng.randrange(len(blob))]
        seen = {}
        for end, (kind, back) in media.automaton().iter(blob.decode("latin-1")):
            if end >= back:
                one, two = (media.VALIDATORS[kind](memoryview(blob), end - back, s) for s in (seen, {}))
                assert one == two
