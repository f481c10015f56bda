import hashlib
import math

import numpy as np
import pytest

from gradus.functions import images as I


def plain(pixels, to, axis, name):
    """One pixel and one weight at a time."""
    length = pixels.shape[axis]
    if length == to:
        return pixels
    reach, scale = {"triangle": 1.0, "lanczos": 3.0}[name], length / to
    wide = max(scale, 1.0)

    def shape(x):
        if name == "triangle":
            return max(0.0, 1.0 - abs(x))
        if x == 0:
            return 1.0
        return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0

    src = np.moveaxis(pixels, axis, 0)
    out = np.zeros((to, *src.shape[1:]), np.uint8)
    for i in range(to):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - reach * wide + 0.5)), min(length, int(centre + reach * wide + 0.5))
        w = [shape((x - centre + 0.5) / wide) for x in range(lo, hi)]
        fixed = [int(k / sum(w) * 2**22 + (0.5 if k >= 0 else -0.5)) for k in w]
        for where in np.ndindex(src.shape[1:]):
            total = sum(k * int(src[(lo + j, *where)]) for j, k in enumerate(fixed))
            out[(i, *where)] = min(255, max(0, (total + 2**21) >> 22))
    return np.moveaxis(out, 0, axis)


@pytest.mark.parametrize("name", ["triangle", "lanczos"])
@pytest.mark.parametrize(("size", "to"), [((5, 7), (16, 16)), ((40, 33), (16, 16)), ((3, 1), (6, 2)), ((8, 8), (8, 5))])
def test_resized_against_loops(name, size, to):
    pixels = np.random.default_rng(1).integers(0, 256, (*size, 3)).astype(np.uint8)
    want = plain(plain(pixels, to[1], 1, name), to[0], 0, name)
    assert (I.resized(pixels, to[1], to[0], name) == want).all()


def test_views(spark):
    pixels = np.random.default_rng(2).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    raw = pixels.tobytes()
    rows = [("a", 8, 9, raw, [1, 2, 7, 9]), ("tiny", 8, 9, raw, [3, 3, 5, 4]), ("none", 8, 9, raw, None), ("out", 8, 9, raw, [1, 2, 9, 9]), ("flat", 8, 9, raw, [2, 2, 2, 4]), ("odd", 8, 9, raw, [1, 2]), ("short", 8, 9, raw[:5], [1, 2, 3, 4]), ("null", None, 9, raw, None), ("bare", 8, 9, None, None)]
    found = I.teacher_views(spark.createDataFrame(rows, "key string, width int, height int, pixels binary, box array<int>"), "key").collect()
    got = {(r["key"], r["view"]): (r["width"], r["height"], r["pixels"], r["problem"]) for r in found}
    red = pixels.copy()
    for y in range(2, 9):
        for x in range(1, 7):
            if min(y - 2, 8 - y, x - 1, 6 - x) < 2:
                red[y, x] = (255, 0, 0)
    crop = pixels[2:9, 1:7]
    assert got["a", "student"] == (8, 9, red.tobytes(), None)
    assert got["a", "teacher"] == (12, 14, plain(plain(crop, 12, 1, "lanczos"), 14, 0, "lanczos").tobytes(), None)
    red = pixels.copy()
    red[3:4, 3:5] = (255, 0, 0)
    assert got["tiny", "student"] == (8, 9, red.tobytes(), None) and got["tiny", "teacher"][:2] == (4, 2)
    assert got["none", "student"] == got["none", "teacher"] == (8, 9, raw, None)
    assert {k: v[3] for k, v in got.items() if k[1] is None} == {("out", None): "box", ("flat", None): "box", ("odd", None): "box", ("short", None): "pixels", ("null", None): "pixels", ("bare", None): "pixels"}


def test_whole_queries_against_plain_code(spark):
    """Every page of the smallest tables: digests of variants and views made by loops and by numpy's generator."""
    import os

    from gradus.queries import QUERIES, _html_images
    from tests.oracle import FOLDER

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    rows = {str(r["page_id"]): r for r in _html_images(spark, FOLDER).collect()}
    got = {(r["page_id"], r["variant"]): r["digest"] for r in QUERIES["arr16_variant_digests"](spark, FOLDER).collect()}
    assert {k for k, _ in got} == {k for k, r in rows.items() if r["height"]} and len(got) % 5 == 0

    def digest(p):
        return hashlib.sha256(f"RGB:{p.shape[1]}x{p.shape[0]}:".encode() + p.tobytes()).hexdigest()

    for key in sorted(k for k, r in rows.items() if r["height"])[:6]:
        p = np.frombuffer(rows[key]["pixels"], np.uint8).reshape(rows[key]["height"], 24, 3)
        small = plain(plain(p, 16, 1, "triangle"), 16, 0, "triangle")
        noise = np.random.default_rng(int.from_bytes(hashlib.sha256(f"1234:{key}".encode()).digest()[:8], "big")).normal(0.0, 50.0, p.shape)
        assert got[key, "blur"] == digest(plain(plain(small, 24, 1, "triangle"), p.shape[0], 0, "triangle"))
        assert got[key, "noise"] == digest(np.clip(np.rint(p.astype(np.float32) + noise), 0, 255).astype(np.uint8))
    views = QUERIES["snk11_teacher_views"](spark, FOLDER).collect()
    assert {r["page_id"] for r in views} == set(rows)
    for r in views:
        box, height = rows[r["page_id"]]["box"], rows[r["page_id"]]["height"]
        fits = box is None or 0 <= box[0] < box[2] <= 24 and 0 <= box[1] < box[3] <= height
        assert (r["problem"] is None) == fits
        if r["view"] == "teacher" and box is not None:
            assert (r["width"], r["height"]) == (2 * (box[2] - box[0]), 2 * (box[3] - box[1]))
