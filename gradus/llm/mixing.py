"""Mix sources to target weights with hash thresholds, in DataFrame operations only.

Each source gets a budget of words. Full passes over it are taken as often as they fit; the rest of the budget is a
threshold on a hash of the document's key: rows below it are taken once more. The threshold is found with histograms
of words by source and hash digit. Each level keeps only the bucket in which the budget runs out and cuts it finer, so
no level sorts documents, and the thresholds are nested: a larger budget keeps all that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, small, stored

#: Three levels of 12 bits, then single hash values of what is left: about a 69-billionth of a source.
LEVELS, DIGIT = 3, 12
HASH_BITS = 60
CAP = 3


def word_count(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(key: str, seed: int = 0) -> Column:
    """60 bits of an MD5 of the key, so that other engines can compute it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Targets from (source, source_size): shares of the total by weight, never over cap times the source's size.

    The excess of capped sources is shared again by weight until none is above its cap. That fixed point is
    min(cap * size, weight * level) with one level for all: order the sources by cap * size / weight, and cap the first
    of them for as long as the level that the others would get is above. One row a source goes to one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    ratio = F.col("most") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    none = F.lit(0.0)
    free_words = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), none)
    free_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)
    level = ranked.withColumn("level", free_words / free_weight).withColumn("capped", F.col("level") >= ratio)
    # Once a source is not capped none after it is, and levels only fall from there: the first one holds for all.
    level = level.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return level.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For (source, need) the hash below which rows are taken so that their words come nearest to the need.

    rows: (source, hash, size). Returns (source, threshold): rows with hash < threshold are taken.
    """
    frontier = budgets.select("source", F.col("need").cast("double").alias("need"), F.lit(0).cast("long").alias("low"))
    left = HASH_BITS
    for _ in range(LEVELS):
        left -= DIGIT
        span = F.lit(1 << left).cast("long")
        inside = (F.col("r.source").eqNullSafe(F.col("f.source"))) & (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << (left + DIGIT)).cast("long"))
        histogram = rows.alias("r").join(small(frontier).alias("f"), inside).groupBy("f.source", "need", "low", F.floor((F.col("hash") - F.col("low")) / span).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("words").over(upto))
        # The first bucket that reaches the need is the boundary; the need shrinks by what stands before it.
        at = summed.where("upto >= need").groupBy("source").agg(F.min_by(F.struct(F.col("bucket"), (F.col("need") - F.col("upto") + F.col("words")).alias("need"), F.col("low")), "bucket").alias("x"))
        frontier = stored(at.select("source", F.col("x.need").alias("need"), (F.col("x.low") + F.col("x.bucket") * span).alias("low")), "frontier")
    inside = (F.col("r.source").eqNullSafe(F.col("f.source"))) & (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << left).cast("long"))
    values = rows.alias("r").join(small(frontier).alias("f"), inside).groupBy("f.source", "need", "hash").agg(F.sum("size").alias("words"))
    summed = values.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("hash")))
    at = summed.where("upto >= need").groupBy("source").agg(F.min_by(F.struct("hash", "need", "upto", "words"), "hash").alias("x"))
    near = F.col("x.upto") - F.col("x.need") <= F.col("x.need") - (F.col("x.upto") - F.col("x.words"))
    return at.select("source", F.when(near, F.col("x.hash") + 1).otherwise(F.col("x.hash")).alias("threshold"))


def budget_table(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target, passes, threshold) from (source, hash, size)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets(sizes, weights, cap).withColumn("passes", passes)
    budgets = stored(budgets.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    # A need under half a word takes nothing.
    found = thresholds(rows, budgets.where("need >= 0.5"))
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    budgets = budgets.alias("b").join(found.alias("t"), same, "left")
    return stored(budgets.select("b.source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")), "budgets")


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    return stored(rows.withColumn("hash", hash_key("key", seed)), "sizes")


def plan_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 0) -> DataFrame:
    """For each row its key, size, source_size, target and the words taken of it; copies and source follow.

    Null texts have size 0. A null source is a source, last in order; a null key hashes as a value of its own. Rows with
    one key share one hash: they are taken together, and a source's words may then miss its target by half of theirs.
    An empty table gives no rows; other columns of the table play no part.
    """
    rows = _sized(docs, key, source, text, seed)
    budgets = budget_table(rows, weights, cap)
    out = rows.alias("r").join(small(budgets).alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")))
    copies = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("r.source").alias(source))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 0) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns that it came with.

    Copies depend on a row's source and key alone, so the budgets are joined to the documents in place; documents are
    neither sorted nor shuffled. A null source is a source, a null text has no words; rows without words, and rows that
    repeat a key, are taken as often as their hash is. Texts may be of any length; an empty table stays empty.
    """
    budgets = budget_table(_sized(docs, key, source, text, seed), weights, cap)
    own_source, passes, threshold, copy = (fresh(docs, name) for name in ("_source", "_passes", "_threshold", "_copy"))
    budgets = budgets.select(F.col("source").alias(own_source), F.col("passes").alias(passes), F.col("threshold").alias(threshold))
    out = docs.join(small(budgets), docs[source].eqNullSafe(F.col(own_source)))
    copies = F.col(passes) + (hash_key(key, seed) < F.col(threshold)).cast("long")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
