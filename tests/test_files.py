import hashlib
import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from gradus.sources import files


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a", b""), ("b", b"x" * 10), ("c", bytes(range(256)) * 50_000), ("sub/d", b"last")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_digests(spark, folder):
    listed = files.listing(spark, str(folder / "in"))
    got = {r["file"].rsplit("/", 1)[1]: (r["bytes"], r["bytes_read"], r["sha256"]) for r in files.digests(listed).collect()}
    want = {p.name: (len(d := p.read_bytes()), len(d), sha(d)) for p in (folder / "in").rglob("*") if p.is_file() and p.stat().st_size}
    assert got == want and len(got) == 3
    empty = files.digests(spark.createDataFrame([(str(folder / "in" / "a"),)], "file string")).first()
    assert (empty["bytes_read"], empty["sha256"]) == (0, sha(b""))
    null = files.digests(spark.createDataFrame([(None,)], "file string")).first()
    assert (null["bytes_read"], null["sha256"]) == (None, None)
    assert files.digests(listed.where("false")).collect() == []


def test_ranges(spark, folder):
    listed = files.listing(spark, str(folder / "in"))
    data = (folder / "in" / "c").read_bytes()
    got = files.range_digests(listed, 1 << 20).where(F.col("file").endswith("/c")).orderBy("range").collect()
    assert [(r["range"], r["bytes_read"], r["sha256"]) for r in got] == [(i, len(x := data[i << 20 : (i + 1) << 20]), sha(x)) for i in range(len(got))]
    assert sum(r["bytes_read"] for r in got) == len(data)
    assert files.range_digests(spark.createDataFrame([(str(folder / "in" / "a"), 0)], "file string, bytes long")).collect() == []


def test_joined(spark, folder):
    paths = [str(folder / "in" / n) for n in ("b", "a", "c", "sub/d")]
    rows = spark.createDataFrame([("whole", paths), ("none", []), ("null", None)], "label string, paths array<string>")
    found, upto = files.joined_digests(rows).orderBy("part").collect(), b""
    for r, path in zip(found, paths, strict=True):
        data = open(path, "rb").read()
        upto += data
        assert (r["label"], r["file"], r["bytes"], r["sha256"], r["upto_sha256"]) == ("whole", path, len(data), sha(data), sha(upto))


def test_a_file_larger_than_the_memory_to_read_it(tmp_path):
    """300 MB under an address space that couldn't hold it, digested to the same value as hashlib's of its pieces."""
    path, want = tmp_path / "large", hashlib.sha256()
    with open(path, "wb") as out:
        for i in range(300):
            piece = bytes([i % 251]) * (1 << 20)
            out.write(piece)
            want.update(piece)
    code = f"""
import hashlib, resource, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from gradus.sources.files import chunks
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
fold = hashlib.sha256()
for piece in chunks({str(path)!r}):
    assert len(piece) <= 4 << 20
    fold.update(piece)
print(fold.hexdigest(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    digest, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert digest == want.hexdigest() and int(grown) < 60 << 10


def test_snapshot(spark, folder):
    data = (folder / "in" / "c").read_bytes()
    rows = [(str(folder / "in" / "c"), str(folder / "out" / "c"), 1_000_003), (str(folder / "in" / "b"), str(folder / "out" / "b"), 11), (str(folder / "in" / "a"), str(folder / "out" / "a"), 0)]
    copies = spark.createDataFrame(rows, "file string, target string, bytes long")
    got = {r["target"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"], r["problem"]) for r in files.snapshot(spark, copies).collect()}
    assert got == {"c": (1_000_003, sha(data[:1_000_003]), None), "b": (10, sha(b"x" * 10), "short"), "a": (0, sha(b""), None)}
    assert (folder / "out" / "c").read_bytes() == data[:1_000_003] and not (folder / "out" / "b").exists()
    # A name that is taken keeps what it has, and nothing is left aside.
    again = spark.createDataFrame([(str(folder / "in" / "b"), str(folder / "out" / "c"), 5)], "file string, target string, bytes long")
    assert files.snapshot(spark, again).first()["problem"] == "taken"
    assert (folder / "out" / "c").read_bytes() == data[:1_000_003]
    assert {p.name for p in (folder / "out").iterdir() if not p.name.startswith(".")} == {"a", "c"}


def test_a_source_that_grows(tmp_path):
    """Exactly the bytes that were asked for, while another thread goes on writing."""
    path, stop = tmp_path / "growing", threading.Event()
    path.write_bytes(b"a" * (1 << 20))

    def grow():
        with open(path, "ab") as out:
            while not stop.is_set():
                out.write(b"b" * 4096)
                out.flush()
                time.sleep(0.0005)

    writer = threading.Thread(target=grow)
    writer.start()
    try:
        data = b""
        for piece in files.chunks(str(path), size=1000, most=(1 << 20) + 100):
            data += piece
    finally:
        stop.set()
        writer.join()
    assert data == (b"a" * (1 << 20) + b"b" * 100)[: len(data)] and (1 << 20) <= len(data) <= (1 << 20) + 100
    assert path.stat().st_size > len(data)
