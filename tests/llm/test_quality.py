import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import quality


def docs(spark, n=600):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(rng.integers(5, 60))]
        grade = i % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["vile", "nasty", "rude"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_grades(spark):
    frame, labels = docs(spark)
    model = quality.train(frame, labels.where("doc_id < 400"))
    assert (np.diff(model.cuts) > 0).all()
    got = quality.score(frame.where("doc_id >= 400"), model).collect()
    right = sum((r["tail_probability"] >= 0.5) == (r["doc_id"] % 3 == 2) for r in got)
    assert right / len(got) > 0.95
    means = [np.mean([r["expected_grade"] for r in got if r["doc_id"] % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(quality, "FEWEST", 1)
    rows, grades = [np.array([1, 2]), np.array([2]), np.array([3]), np.array([1])], np.array([2, 1, 0, 2])
    model = quality.fit(rows, grades, 2, rounds=400, decay=0.0)

    def loss(w, cuts):
        out = 0.0
        for at, g in zip(rows, grades, strict=True):
            up = [1.0, *(1 / (1 + np.exp(cuts - w[at].sum()))), 0.0]
            out -= np.log(max(up[g] - up[g + 1], 1e-12))
        return out

    assert loss(model.weights, model.cuts) < 0.2 < loss(np.zeros(quality.BUCKETS), np.array([-0.5, 0.5]))


def plain_features(text):
    """What a text is graded by, in plain words: each distinct word, its start, and eight statistics."""
    import xxhash

    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = [w for w in __import__("re").split(rb"[\t-\r ]+", lower) if w]
    number = lambda w: 4096 + xxhash.xxh3_64(w).intdigest() % (2**20 - 4096)
    inside = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57 or b >= 128
    out, signed = set(), 0
    for w in set(words):
        at = [i for i, b in enumerate(w) if inside(b)]
        bare = w[at[0] : at[-1] + 1] if at else b""
        out.add(number(bare))
        out.add(number(bare[:5] + b"\0") if len(bare) > 5 else number(bare))
        signed += w[-1:] in (b"!", b"*", b"$", b"%", b"&", b"#", b"|", b"@")
    n, size = len(words), len(raw)

    def step(part, whole):
        return sum(part / whole >= edge if part / whole != edge else part / whole > edge for edge in (0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75)) if whole else 0

    other = sum(not inside(b) for b in raw)
    stats = [step(sum(65 <= b <= 90 for b in raw), size), step(sum(48 <= b <= 57 for b in raw), size), step(other - n, size), step(len(set(words)), n), step(signed, len(set(words))), step(raw.count(b"|"), n), min(15, n.bit_length()), min(15, size // max(1, n) // 2)]
    return out | {256 * i + v for i, v in enumerate(stats)}


def test_scores_against_plain_code(spark):
    """Every document of the test tables, scored by a sum over a set of features."""
    import math
    import os

    from tests.oracle import FOLDER

    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for r in quality.score(frame, model).collect():
        total = math.fsum(model.weights[i] for i in plain_features(r["text"]))
        tails = [1 / (1 + math.exp(cut - total)) for cut in model.cuts]
        assert abs(r["tail_probability"] - tails[-1]) < 1e-9 and abs(r["expected_grade"] - sum(tails)) < 1e-9


def test_both_bounds_of_the_sample(spark, monkeypatch):
    """The sample is the rows of the smallest hashes, whatever their keys, grades or lengths."""
    frame, labels = docs(spark, 60)
    rated = labels.select("doc_id", F.col("quality").alias("grade"))
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    sizes = np.cumsum([len(quality.features(texts[i].encode(), quality.Tokens())) for i in order])
    monkeypatch.setattr(quality, "MAX_FEATURES", int(sizes[20]))
    rows, grades = quality.rated_sample(frame, rated, "doc_id", "text", "grade", most=50)
    assert len(rows) == 21 and grades.tolist() == [int(i % 3 > 0) for i in order[:21]]
    assert len(quality.rated_sample(frame, rated, "doc_id", "text", "grade", most=10)[0]) == 10


def test_odd_rows(spark):
    frame, labels = docs(spark, 60)
    model = quality.train(frame, labels.unionAll(labels).withColumn("other", F.lit(1)))
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "word " * 50_000, 3.0)], "doc_id long, text string, tail_probability double")
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert quality.score(odd.limit(0), model).count() == 0


def test_no_labels(spark):
    frame, labels = docs(spark, 9)
    model = quality.train(frame, labels.limit(0))
    assert not model.weights.any()
    assert quality.score(frame, model, columns=["doc_id"]).columns == ["doc_id", "expected_grade", "tail_probability"]


@pytest.mark.parametrize("text", [None, b"", b"a", b"!!! ???", "é".encode() * 9])
def test_features_are_sorted_and_distinct(text):
    found = quality.features(text, quality.Tokens())
    assert list(found) == sorted(set(found)) and found.min() >= 0 and found.max() < quality.BUCKETS
