import hashlib
import io
import json
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import digests, images
from gradus.sources import archives as A


def test_archives_in_parts(spark, tmp_path):
    """Whole archives and cut ones, in parts of any size; names that aren't allowed, folders, and a broken image."""
    png = A.gray_png(5, 3)
    data = A.packed({"a.png": png, "b.txt": b"text", "in/c.png": png, "d.png": png[:-3] + b"\0\0\0", "e.PNG": A.gray_png(7, 2), "f.png": png})
    cuts = [data[:50], data[50:51], data[51:]]
    paths = []
    for i, part in enumerate(cuts):
        (tmp_path / f"p{i}").write_bytes(part)
        paths.append(str(tmp_path / f"p{i}"))
    (tmp_path / "short").write_bytes(A.packed({"a.png": np.random.default_rng(0).bytes(40_000)})[:20_000])
    allowed = ["a.png", "c.png", "d.png", "e.PNG"]
    rows = [("whole", paths, allowed, True), ("short", [str(tmp_path / "short")], allowed, False), ("bad", [str(tmp_path / "short")], allowed, True)]
    got = A.extracted(spark.createDataFrame(rows, "label string, paths array<string>, allowed array<string>, complete boolean")).collect()
    found = {(r["label"], r["name"]): r for r in got}
    assert set(found) == {("whole", "a.png"), ("whole", "d.png"), ("whole", "e.PNG"), ("whole", None), ("short", None), ("bad", None)}
    assert (found["whole", "a.png"]["width"], found["whole", "a.png"]["height"], found["whole", "a.png"]["sha256"]) == (5, 3, hashlib.sha256(png).hexdigest())
    assert found["whole", "d.png"]["problem"] == "no PNG" and found["whole", "e.PNG"]["problem"] is None
    assert [(found[x, None]["ignored"], found[x, None]["truncated"], found[x, None]["problem"]) for x in ("whole", "short", "bad")] == [(3, False, None), (0, True, None), (0, True, "cut")]


def test_variants(spark):
    pixels = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    rows = spark.createDataFrame([("x", 6, 4, bytearray(pixels.tobytes())), ("bad", 6, 4, bytearray(b"12"))], "id string, width int, height int, pixels binary")
    got = {r["variant"]: np.frombuffer(r["pixels"], np.uint8).reshape(4, 6, 3) for r in images.variants(rows, "id").collect()}
    assert (got["normal"] == pixels).all() and (got["blank"] == 127).all()
    assert (got["occluded"][1:3, 1:4] == 127).all() and (got["occluded"][0] == pixels[0]).all()
    seed = int(hashlib.sha256(b"1234:x").hexdigest()[:16], 16)
    want = np.clip(np.rint(pixels.astype(np.float32) + np.random.default_rng(seed).normal(0.0, 50.0, pixels.shape)), 0, 255)
    assert (got["noise"] == want).all()


def test_tensor_digest(spark):
    parts = {"b": np.arange(6, dtype=np.float32).reshape(2, 3), "a": np.array([1, 2], np.int64)}
    plain = hashlib.sha256()
    for key in sorted(parts):
        header = json.dumps({"key": key, "dtype": f"torch.{parts[key].dtype}", "shape": list(parts[key].shape)}, sort_keys=True, separators=(",", ":")).encode()
        plain.update(len(header).to_bytes(8, "big") + header + parts[key].nbytes.to_bytes(8, "big") + parts[key].tobytes())
    rows = spark.createDataFrame([([(k, f"torch.{v.dtype}", list(v.shape), bytearray(v.tobytes())) for k, v in parts.items()],)], "t array<struct<key:string,dtype:string,shape:array<int>,bytes:binary>>")
    assert rows.select(digests.tensor_sha256(F.col("t"))).first()[0] == plain.hexdigest()


def test_written_archives(spark, tmp_path):
    """Parts of bounded size, odd labels, repeated names, null and empty members, a second run, an empty table."""
    big = np.random.default_rng(1).bytes(50_000)
    rows = [("a/ü %20", "b.png", bytearray(big)), ("a/ü %20", "a.png", bytearray(A.png(2, 1, b"abcdef"))), ("b", "x.png", None), ("b", "y.png", bytearray(b"2")), ("b", "y.png", bytearray(b"1")), (None, "z", bytearray(b"3")), ("b", None, bytearray(b"4"))]
    files = spark.createDataFrame(rows, "label string, name string, content binary")
    to = f"file://{tmp_path}/out"
    got = {r["label"]: r for r in A.written(files, to, 20_000).collect()}
    again = {r["label"]: r for r in A.written(files, to, 20_000).collect()}
    assert set(got) == {"a/ü %20", "b"} and got == again
    found = sorted((tmp_path / "out").iterdir())
    assert len(found) == sum(len(r["paths"]) for r in got.values()) and all(p.stat().st_size <= 20_000 for p in found)
    assert len(got["a/ü %20"]["paths"]) == 3
    members = {}
    for label, r in got.items():
        data = b"".join((tmp_path / "out" / p.rsplit("/", 1)[1]).read_bytes() for p in r["paths"])
        assert len(data) == r["bytes"]
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as archive:
            members[label] = [(m.name, archive.extractfile(m).read()) for m in archive.getmembers()]
    assert members == {"a/ü %20": [("a.png", A.png(2, 1, b"abcdef")), ("b.png", big)], "b": [("x.png", b""), ("y.png", b"1"), ("y.png", b"2")]}
    assert A.written(files.where("false"), to).count() == 0


def test_png(spark):
    data = A.png(2, 2, bytes(range(12)))
    assert A.png_size(data) == (2, 2)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : -16]) == b"\0" + bytes(range(6)) + b"\0" + bytes(range(6, 12))
    with pytest.raises(ValueError):
        A.png(2, 2, b"123")
