"""Raw RGB images for diagnostics and teachers: blank, blurred, with the middle covered, with seeded noise; crops and boxes.

Resampling is separable: a filter of a small support, widened where an image shrinks, with weights in fixed point of
FIXED bits, first along rows and then along columns, each rounded to bytes. Weights are one matrix for each length, and
products of whole numbers that a double holds exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import importable

# The gray of what is covered, and the noise's seed and deviation.
GRAY, NOISE_SEED, NOISE_DEVIATION = 127, 1234, 50.0
# Bits of a weight, the side that a blur shrinks to, and the colour and width of a box's lines.
FIXED, BLURRED, BOX_COLOUR, BOX_WIDTH = 22, 16, (255, 0, 0), 2


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Filters, and how far they reach.
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"triangle": (triangle, 1.0), "lanczos": (lanczos, 3.0)}


@lru_cache(64)
def weights(length: int, to: int, name: str) -> np.ndarray:
    """A matrix of (to, length): the part that each old pixel has in each new one, in fixed point."""
    shape, reach = FILTERS[name]
    scale = length / to
    wide = max(scale, 1.0)
    out = np.zeros((to, length))
    for i in range(to):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - reach * wide + 0.5)), min(length, int(centre + reach * wide + 0.5))
        part = shape((np.arange(first, last) - centre + 0.5) / wide)
        part = part / part.sum() * (1 << FIXED)
        out[i, first:last] = np.trunc(part + np.where(part < 0, -0.5, 0.5))
    return out


def _along(pixels: np.ndarray, to: int, name: str) -> np.ndarray:
    """Resampled along the first axis; one that keeps its length stays as it is."""
    if pixels.shape[0] == to:
        return pixels
    made = weights(pixels.shape[0], to, name) @ pixels.reshape(pixels.shape[0], -1).astype(float)
    return np.clip(np.floor((made + (1 << FIXED - 1)) / (1 << FIXED)), 0, 255).astype(np.uint8).reshape(to, *pixels.shape[1:])


def resized(pixels: np.ndarray, width: int, height: int, name: str) -> np.ndarray:
    """pixels: height, width, 3, in bytes."""
    return _along(_along(pixels.swapaxes(0, 1), width, name).swapaxes(0, 1), height, name)


def blurred(pixels: np.ndarray) -> np.ndarray:
    height, width, _ = pixels.shape
    return resized(resized(pixels, BLURRED, BLURRED, "triangle"), width, height, "triangle")


def boxed(pixels: np.ndarray, box: tuple[int, int, int, int], width: int = BOX_WIDTH) -> np.ndarray:
    """With lines of a width along the inside of a half-open box (left, top, right, bottom)."""
    left, top, right, bottom = box
    out, inner = pixels.copy(), pixels[top + width : max(bottom - width, top + width), left + width : max(right - width, left + width)].copy()
    out[top:bottom, left:right] = BOX_COLOUR
    if bottom - top > 2 * width and right - left > 2 * width:
        out[top + width : bottom - width, left + width : right - width] = inner
    return out


def cropped(pixels: np.ndarray, box: tuple[int, int, int, int], times: int = 2) -> np.ndarray:
    """The part in a half-open box, so many times as large."""
    left, top, right, bottom = box
    part = pixels[top:bottom, left:right]
    return resized(part, times * (right - left), times * (bottom - top), "lanczos")


def noise_seed(key: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{NOISE_SEED}:{key}".encode()).digest()[:8], "big")


def variants_of(pixels: np.ndarray, key: str) -> dict[str, np.ndarray]:
    """pixels: height, width, 3, in bytes."""
    height, width, _ = pixels.shape
    covered = pixels.copy()
    covered[height // 4 : height // 4 + height // 2, width // 4 : width // 4 + width // 2] = GRAY
    noise = np.random.default_rng(noise_seed(key)).normal(0.0, NOISE_DEVIATION, pixels.shape)
    noisy = np.clip(np.rint(pixels.astype(np.float32) + noise), 0, 255).astype(np.uint8)
    return {"normal": pixels, "blur": blurred(pixels), "blank": np.full_like(pixels, GRAY), "occluded": covered, "noise": noisy}


def variants(rows: DataFrame, key: str, width: str = "width", height: str = "height", pixels: str = "pixels") -> DataFrame:
    """(key, variant, pixels) of rows with width * height * 3 bytes; rows with another number of bytes give none."""
    importable(rows.sparkSession)
    whole = rows.where(F.octet_length(pixels) == F.col(width) * F.col(height) * 3)
    taken = whole.select(F.col(key).cast("string").alias("key"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(pixels).alias("p"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                made = variants_of(np.frombuffer(r["p"], np.uint8).reshape(r["h"], r["w"], 3), r["key"])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(made)), pa.array(list(made)), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["key", "variant", "pixels"])

    return taken.mapInArrow(work, "key string, variant string, pixels binary").withColumnRenamed("key", key)


def teacher_views(rows: DataFrame, key: str, box: str = "box", width: str = "width", height: str = "height", pixels: str = "pixels") -> DataFrame:
    """(key, view, width, height, pixels, problem): for each row a ``student`` view, with the box drawn on it, and a ``teacher`` view, the box cut out at twice its size.

    A row without a box has the whole image in both views. One whose pixels aren't width * height * 3 bytes, or whose box
    isn't four numbers that hold some part of the image, has one row with neither view, and the problem. Null pixels are
    such a problem too; an image without pixels has none that a box could hold.
    """
    importable(rows.sparkSession)
    taken = rows.select(F.col(key).cast("string").alias("key"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h"), F.col(pixels).alias("p"), F.col(box).cast("array<int>").alias("box"))

    def views(r: dict) -> list[tuple]:
        w, h, p, box = r["w"], r["h"], r["p"], r["box"]
        if w is None or h is None or p is None or len(p) != w * h * 3:
            return [(r["key"], None, None, None, None, "pixels")]
        image = np.frombuffer(p, np.uint8).reshape(h, w, 3)
        if box is None:
            return [(r["key"], view, w, h, p, None) for view in ("student", "teacher")]
        if len(box) != 4 or None in box or not (0 <= box[0] < box[2] <= w and 0 <= box[1] < box[3] <= h):
            return [(r["key"], None, None, None, None, "box")]
        made = {"student": boxed(image, tuple(box)), "teacher": cropped(image, tuple(box))}
        return [(r["key"], view, x.shape[1], x.shape[0], x.tobytes(), None) for view, x in made.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*views(r), strict=True), kinds, strict=True)], ["key", "view", "width", "height", "pixels", "problem"])

    return taken.mapInArrow(work, "key string, view string, width int, height int, pixels binary, problem string").withColumnRenamed("key", key)
