import os

import pytest

from gradus.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, check

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, held against plain code."""
    from fractions import Fraction

    import corpus_pipeline
    from gradus.llm import decontam, mixing, quality
    from gradus.llm.shared import Numbers, stored
    from tests.llm.test_parity_join import brute

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    items = [([r["item_id"]], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        planned = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs).collect()} if name == "mixing sources" else None
        many = [r["doc_id"] for r in docs.collect()]
        docs = stored(stage(spark, docs, FOLDER), "t")
        after = sorted(r["doc_id"] for r in docs.collect())
        if name == "quality classifier":
            want = sorted(i for i, t in before.items() if model.tails(quality.features(t.encode(), quality.Tokens()))[1] >= quality.KEEP)
        elif name == "n-gram Jaccard join":
            want = sorted(i for i, _, c in brute(sorted(before.items()), 5, Fraction(8, 10)) if i == c)
        elif name == "benchmark decontamination":
            seeds = decontam.Seeds(items, 5)
            want = sorted(i for i, t in before.items() if not decontam._leaks(seeds, Numbers(seeds.vocabulary), t.encode(), decontam.COVERAGE))
        elif name == "mixing sources":
            want = sorted(i for i in before for _ in range(planned[i]))
        else:
            want = sorted(many)
        assert after == want, name
        assert docs.columns[: len(columns)] == columns


def _folder(spark, tmp_path, docs, labels, benchmark):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long, shard string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        spark.createDataFrame(rows, kinds[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, and a column that is called like the last stage's; no labels or items."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "one text of some seven words here", "en", "s", 5, "b"), (3, "one text of some seven words here", "en", "s", 5, "b"), (None, "a text without any number of its own", None, None, None, None), (4, long, "de", "t", 9, "c"), (5, long + " tail", "de", "t", 9, "c")]
    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, docs, [], []))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "_shard"]
    ids = {r["doc_id"] for r in found.collect()}
    # Without labels and items nothing is rejected; of copies and near copies one stays, before sources are weighed.
    assert ids <= {1, 2, 3, None, 4} and {3, 4} & ids


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, [], [], []))
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "text"]
