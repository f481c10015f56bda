import os

import pytest

from gradus.llm import quality
from gradus.llm.queries import QUERIES
from tests.oracle import FOLDER


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_rejected_documents_are_scored_too(spark):
    rows = QUERIES["op4_quality_classifier"](spark, FOLDER).collect()
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in rows) == ids
    assert all(r["keep"] == (r["tail_probability"] >= quality.KEEP) for r in rows)
    assert {r["keep"] for r in rows} == {True, False}
