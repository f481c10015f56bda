"""Grade documents by ordinal regression: a cumulative-link model over hashed words.

P(grade > k) = sigmoid(w . x - cut_k): one weight vector for all grades, and ordered cuts. x marks which hashed words,
words' starts and text statistics a document has, each once, so a long document isn't diluted. The model is fitted here
on a bounded sample of rated rows, over features that tell grades apart beyond chance; scoring runs over every document
on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import REMEMBERED, as_bytes, fresh, ready, stored, tidy

#: Hashed features. The sample that a fit takes is bounded twice: rated rows of the smallest hashes of their keys, as long
#: as there are no more than so many, and no more than so many features on them (64 MB).
BUCKETS, MAX_RATED, MAX_FEATURES = 1 << 20, 12_000, 16_000_000
#: A feature is used if it is in FEWEST rated documents and off by so many deviations for one of the cuts.
FEWEST, DEVIATIONS = 3, 4.0
#: Bytes of a word's start that is a feature too.
START = 5
#: Byte classes: lower-case letter, upper-case letter, digit, part of a longer character, anything else.
_CLASS = bytes(0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 4 for b in range(256))
_EDGES = b"".join(bytes([b]) for b in range(256) if _CLASS[b] == 4)


def _share(part: int, whole: int) -> int:
    """A share in eight steps, finer near 0."""
    return int(np.searchsorted((0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75), part / whole)) if whole else 0


class Tokens(dict):
    """Features of words, remembered: the word's own, its start's, and whether a sign ends it, in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(_EDGES)
        own = start = 4096 + xxhash.xxh3_64_intdigest(bare) % (BUCKETS - 4096)
        if len(bare) > START:
            start = 4096 + xxhash.xxh3_64_intdigest(bare[:START] + b"\0") % (BUCKETS - 4096)
        value = self[word] = own | start << 24 | (word[-1] in b"!*$%&#|@") << 48
        return value


def features(text: bytes | None, tokens: Tokens) -> np.ndarray:
    """Sorted distinct feature numbers of a text; a null or empty one has only those of its statistics."""
    raw = text or b""
    found = raw.lower().split()
    distinct = set(found)
    packed = np.fromiter(map(tokens.__getitem__, distinct), np.int64, len(distinct))
    shape = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=5) if raw else np.zeros(5, int)
    n = len(found)
    stats = (
        _share(int(shape[1]), len(raw)), _share(int(shape[2]), len(raw)), _share(int(shape[4]) - n, len(raw)), _share(len(distinct), n), _share(int((packed >> 48).sum()), len(distinct)),
        _share(raw.count(b"|"), n), min(15, n.bit_length()), min(15, len(raw) // max(1, n) // 2),
    )
    own = np.array([(i << 8) + v for i, v in enumerate(stats)], np.int64)
    return np.unique(np.concatenate((packed & 0xFFFFFF, packed >> 24 & 0xFFFFFF, own)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """Weights by feature, and cuts in rising order: one fewer than there are grades."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, at: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.cuts - self.weights[at].sum(), -40, 40)))


def telling(rows: list[np.ndarray], grades: np.ndarray, top: int) -> np.ndarray:
    """Features whose documents' grades are above or below a cut more often than chance has it, and statistics' features."""
    n = len(rows)
    # Documents that have a feature, by grade; nothing is made for each single feature of a document.
    by_grade = [np.bincount(np.concatenate(own), minlength=BUCKETS) if (own := [r for r, g in zip(rows, grades, strict=True) if g == k]) else np.zeros(BUCKETS, np.int64) for k in range(top + 1)]
    have, most = sum(by_grade), np.zeros(BUCKETS)
    for k in range(top):
        p = float((grades > k).mean())
        off = sum(by_grade[k + 1 :]) - p * have
        spread = np.sqrt(np.maximum(have * (1 - have / n) * p * (1 - p), 1e-9))
        most = np.maximum(most, np.abs(off) / spread)
    return np.flatnonzero((have >= FEWEST) & ((most >= DEVIATIONS) | (np.arange(BUCKETS) < 4096)))


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, rounds: int = 250, rate: float = 0.08, decay: float = 1e-4) -> Model:
    """Maximum likelihood by full-batch Adam. The cuts' gaps are exponentials, so they keep their order.

    rows: features of each rated document. Without rows, weights are 0 and the cuts stay evenly spaced.
    """
    weights, free = np.zeros(BUCKETS), np.zeros(max(1, top))
    if rows:
        used = np.zeros(BUCKETS, bool)
        used[telling(rows, grades, max(1, top))] = True
        rows = [r[used[r]] for r in rows]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, local = np.unique(flat, return_inverse=True)
    w, moments = np.zeros(len(used)), [np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(free)), np.zeros(len(free))]
    for t in range(1, rounds + 1 if rows else 1):
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(owner, w[local], len(rows))
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))  # P(grade > k)
        bounds = np.hstack((np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))))
        slope = np.hstack((np.zeros((len(rows), 1)), up * (1 - up), np.zeros((len(rows), 1))))
        n = np.arange(len(rows))
        p = np.maximum(bounds[n, grades] - bounds[n, grades + 1], 1e-12)
        by_score = -(slope[n, grades] - slope[n, grades + 1]) / p / len(rows)
        by_cut = np.zeros(len(cuts) + 2)
        np.add.at(by_cut, grades, slope[n, grades] / p / len(rows))
        np.add.at(by_cut, grades + 1, -slope[n, grades + 1] / p / len(rows))
        by_cut = by_cut[1:-1]
        by_free = np.concatenate(([by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps))
        for value, slopes, m, v in ((w, np.bincount(local, by_score[owner], len(used)) + decay * w, *moments[:2]), (free, by_free, *moments[2:])):
            m += 0.1 * (slopes - m)
            v += 0.01 * (slopes**2 - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = w
    return Model(weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def rated_sample(docs: DataFrame, ratings: DataFrame, key: str, text: str, grade: str, most: int = MAX_RATED) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of rated documents in order of a hash of their keys, up to both bounds of the sample.

    Ratings without a grade or key are left out; of several grades of one key the lowest counts; documents that repeat a
    key are each taken. The order has nothing to do with grades or lengths, so neither bound favours any.
    """
    ready(docs.sparkSession)
    chosen = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(grade).alias("_grade")).orderBy(F.xxhash64("_key"), "_key").limit(most)
    rated = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            found = [features(t, tokens).tobytes() for t in as_bytes(b.column("_text"))]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_grade"), pa.array(found, pa.binary())], ["_key", "_grade", "at"])
        tidy()

    kind = dict(rated.dtypes)
    rows = stored(rated.mapInArrow(work, f"_key {kind['_key']}, _grade int, at binary"), "rated").withColumn("order", F.xxhash64("_key"))
    order = ["order", "_key", "_grade", F.xxhash64("at")]
    # Only lengths come to the driver, until it is known how many rows fit.
    sizes = np.cumsum([r["n"] for r in rows.select(*order, (F.octet_length("at") / 4).cast("long").alias("n")).orderBy(*order).limit(most).select("n").collect()])
    taken = rows.orderBy(*order).limit(max(1, int(np.searchsorted(sizes, MAX_FEATURES, "right")))).select("at", "_grade").collect()
    return [np.frombuffer(r["at"], np.int32) for r in taken], np.array([r["_grade"] for r in taken], np.int64)


def score(docs: DataFrame, model: Model, text: str = "text", beyond: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs with its columns, or those named, then expected_grade and tail_probability = P(grade > beyond), the top grade's by default.

    A null text is scored as an empty one. Repeated rows stay. A column of docs with one of the two names is replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    model_at = spark.sparkContext.broadcast(model)
    k = len(model.cuts) - 1 if beyond is None else beyond
    docs = docs.drop("expected_grade", "tail_probability")
    columns = docs.columns if columns is None else columns
    schema = docs.select(*columns).schema.add("expected_grade", "double").add("tail_probability", "double")
    docs = docs.select(*columns, F.col(text).alias(fresh(docs, "_scored")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, m = Tokens(), model_at.value
        for b in batches:
            tails = [m.tails(features(t, tokens)) for t in as_bytes(b.column(b.num_columns - 1))]
            graded = [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[k]) for t in tails], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *graded], [*b.schema.names[:-1], "expected_grade", "tail_probability"])
        tidy()

    return docs.mapInArrow(work, schema)


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor. 1: well made but toxic. 2: well made and clean. Null where both labels are."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when((F.col(quality) == 1) | (F.col(toxic) == 0), 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit the three grades of ``grade_of`` on the labelled documents.

    Labels that are both null, or of no document, count for nothing; of a key's different labels the lowest grade counts.
    Without labels all weights are 0, and every document has the same probabilities. Null and empty texts are rated like
    any, and long ones are read whole.
    """
    rated = labels.select(key, grade_of().alias("_grade"))
    rows, grades = rated_sample(docs, rated, key, text, "_grade")
    return fit(rows, grades, 2)


#: The lowest probability of the top grade with which a document is kept.
KEEP = 0.75
