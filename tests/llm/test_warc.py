import base64
import gzip
import hashlib
import io
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from gradus.llm import warc


def rows():
    out = [(i, f"http://h{i}.net/p\r\nX: y", f"<p>{i % 7}</p>" * (i % 5)) for i in range(40)]
    return out + [(40, None, None), (41, "http://a/", ""), (42, "u", "é" * 100_000), (None, "u", "only null"), (7, *out[7][1:]), (50, "u", "\r\n\r\nWARC/1.1\r\n"), (51, "u", "\r\n\r\nWARC/1.1\r\n")]


def brute(pages):
    newest = {}
    for page, _, html in pages:
        body = (html or "").encode()
        if page is not None:
            newest[body] = max(newest.get(body, page), page)
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        revisit = newest.get(body) is not None and page != newest[body]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", newest[body] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "mine") for r in rows()], "page_id long, url string, html string, newest string").repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == brute(rows())


def test_headers_and_predicates(spark, tmp_path):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    manifest = warc.write(pages, path)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows())
    found = warc.read(spark, path)
    assert {r["record_type"]: r["n"] for r in found.groupBy("record_type").agg(F.count("*").alias("n")).collect()} == {"response": sum(r[3] == "response" for r in brute(rows())), "revisit": sum(r[3] == "revisit" for r in brute(rows()))}
    everything = found.collect()
    for condition, test in [
        ("record_type = 'revisit'", lambda r: r["record_type"] == "revisit"), ("record_type IN ('response', 'x')", lambda r: r["record_type"] == "response"), ("target_uri LIKE 'http://h1%'", lambda r: (r["target_uri"] or "").startswith("http://h1")),
        ("refers_to IS NULL AND target_uri IS NOT NULL", lambda r: r["refers_to"] is None and r["target_uri"] is not None), ("NOT target_uri = 'u'", lambda r: r["target_uri"] is not None and r["target_uri"] != "u"), ("content_length > 200", lambda r: r["content_length"] > 200),
    ]:
        assert sorted(r["place"] for r in found.where(condition).collect()) == sorted(r["place"] for r in everything if test(r)), condition
    assert warc.read(spark, path, payload=False).where("payload IS NOT NULL").count() == 0


def test_pushed_predicates_skip_payloads():
    data = b"".join(gzip.compress(warc.record(k, f"<urn:page:{i}>", None, b"x" * 50, 50, "D", "<r>")) for i, k in enumerate(["response", "revisit", "response"]))
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 3)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    assert [r[0] for r in warc.read_records(io.BytesIO(data), "f", reader.tests)] == ["<urn:page:1>"]


def test_uncompressed_and_broken():
    plain = warc.record("response", "<a>", "u\r\nInjected: 1", b"body\r\n\r\n", 8, "D")
    found = list(warc.read_records(io.BytesIO(plain * 2), "f", []))
    assert len(found) == 2 and found[0][10] == b"body\r\n\r\n" and "injected" not in found[0][8]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(plain[:-20]), "f", []))
    with pytest.raises(ValueError, match="no record"):
        list(warc.read_records(io.BytesIO(b"junk\r\n\r\n"), "f", []))


def test_archives_roll_and_are_not_mixed(spark, tmp_path, monkeypatch):
    """Archives of bounded size; digests without payloads; a folder in use is refused."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(2)
    files = warc.write(pages, path).collect()
    assert len(files) > 4 and sum(f["records"] for f in files) == len(rows())
    found = warc.read(spark, path, payload="digest").where("record_type = 'response'").collect()
    assert len(found) == sum(r[3] == "response" for r in brute(rows()))
    assert all(r["payload"] is None and r["read_digest"] == r["payload_digest"] and r["read_bytes"] == int(r["http_headers"]["content-length"]) for r in found)
    with pytest.raises(FileExistsError):
        warc.write(pages, path)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Zeros(io.RawIOBase):
    """A WARC record of so many zeros, made as it is read."""

    def __init__(self, many):
        self.head, self.left, self.tail = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % many, many, b"\r\n\r\nWARC/1.1\r\nWARC-Type: last\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

    def read(self, n=-1):
        out, self.head = self.head[:n], self.head[n:]
        more = min(n - len(out), self.left)
        self.left -= more
        out += bytes(more)
        if not self.left:
            out, self.tail = out + self.tail[: n - len(out)], self.tail[n - len(out) :]
        return out


def test_skipped_payloads_are_not_kept():
    """An archive of 200 KB that inflates to 200 MB, read without payloads, takes a few MB; so does a plain one."""
    packed = gzip.compress(b"".join(iter(lambda z=Zeros(200 << 20): z.read(1 << 20), b"")), 9, mtime=0)
    assert len(packed) < 300_000
    for raw in (io.BytesIO(packed), Zeros(200 << 20)):
        tracemalloc.start()
        found = [r[0] if isinstance(r[0], str) else r for r in warc.read_records(raw, "x", [], "false")]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 2 and peak < 16 << 20


def test_a_long_record_takes_time_in_proportion():
    began = time.process_time()
    rows_ = list(warc.read_records(Zeros(200 << 20), "x", [], "digest"))
    assert len(rows_) == 2 and (200 << 20) in rows_[0] and time.process_time() - began < 8


def test_a_block_without_http_headers_stays_in_its_record():
    """The blank line is sought within the record alone."""
    block = b"no headers here"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    raw = head % len(block) + block + b"\r\n\r\n" + head % 9 + b"A: b\r\n\r\nx" + b"\r\n\r\n"
    found = list(warc.read_records(io.BytesIO(raw), "x", []))
    assert len(found) == 2 and block in found[0] and b"x" in found[1]
