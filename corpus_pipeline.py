"""From raw documents to training shards, in five stages; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontam, mixing, parity_join, quality, sharding
from gradus.llm.shared import fresh, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose probability of the top grade is at least quality.KEEP.

    Null and empty texts are graded as what they are; repeated rows go or stay together. Without labels of these
    documents nothing tells them apart, and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs.select("doc_id"), "doc_id", "left_semi")
    if labels.where(quality.grade_of().isNotNull()).isEmpty():
        return docs
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    return scored.where(F.col("tail_probability") >= quality.KEEP).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, a similarity of at least 0.8.

    Documents without words all stay; of repeated rows one does.
    """
    return parity_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item; null and empty texts leak none, and without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents up to its target; those taken several times are repeated rows.

    A null source is a source; documents without words have no size and are taken with the others of their hash.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are read from compacted shards, and the number of their shard, under a name of its own.

    Nulls and repeated rows are kept as they are; of an empty table there are no shards, and no rows.
    """
    return sharding.shard(docs).read(shard=fresh(docs, "shard"))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("sharding", shard)]

#: The classifier's fit has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
