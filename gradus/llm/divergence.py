"""How far the sources of each language are apart in their words, by joint histograms of counts.

For two sources the terms of their language are tallied by the pair of counts that they have there. What is compared
depends on the counts alone, so it is evaluated once for each distinct pair of counts and multiplied by the tally: most
terms are rare, and a few pairs of small counts stand for nearly all of them. Only terms that both sources have are
looked at. The cells of terms that one of them lacks follow from the source's own histogram less what was met jointly,
and that of terms that both lack from the size of the vocabulary.

Terms are counted by document where they stand, combined within tasks and then by (lang, source, term), so a source with
a third of all documents is no task's burden. A language's vocabulary is never gathered; a term's list has one entry for
each source that uses it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_bytes, ready, small, stored, tidy

#: Rows that a task combines before it hands them on, and pairs of counts that it looks at in one step.
HELD, STEP = 150_000, 1_000_000
#: Shares are in units of one in so many.
SCALE = 1_000_000_000
#: A-Z in lower case, other ASCII but letters to spaces; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, in part; and for each group rows with a null term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in found.items():
                keys = list(n)
                many = len(keys) + 1
                columns = [pa.array([lang] * many), pa.array([source] * many), pa.array([*keys, None], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, keys), 0], pa.int64())], ["lang", "source", "term", "n", "d"])
            found.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), as_bytes(b.column("text")), strict=True):
                n, d = found[lang, source]
                own, before = terms(text), len(n)
                n.update(own)
                d.update(set(own))
                held += len(n) - before
                if held >= HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()
        tidy()

    return docs.mapInArrow(work, "lang string, source string, term string, n long, d long")


def _indices(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j < m, some STEP at a time, so that a term of very many sources takes no more memory than others."""
    for low in range(0, m - 1, max(1, STEP // m)):
        one = np.arange(low, min(low + max(1, STEP // m), m - 1))
        many = m - 1 - one
        i = np.repeat(one, many)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def _met(terms_: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, many), in part: of (lang, used: list of (source, n)), pairs of counts of sources a < b that share a term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("used")
            flat = lists.flatten()
            coded, langs = flat.field("source").dictionary_encode(), b.column("lang").dictionary_encode()
            names = coded.dictionary
            # Names in code point order, so that a < b means the same in every batch.
            rank = np.argsort(np.argsort(np.array([x.as_py().encode() for x in names], object))) if len(names) else np.zeros(0, np.int64)
            ordered = sorted(names.to_pylist(), key=str.encode)
            source, n = rank[coded.indices.to_numpy()], flat.field("n").to_numpy()
            many = lists.value_lengths().to_numpy()
            lang = langs.indices.to_numpy()
            start = np.cumsum(many) - many
            order = np.lexsort((source, np.repeat(np.arange(len(many)), many)))
            source, n = source[order], n[order]
            for m in np.unique(many[many > 1]):
                which = np.flatnonzero(many == m)
                for i, j, some in ((i, j, some) for i, j in _indices(m) for some in np.array_split(which, min(len(which), -(-len(which) * len(i) // STEP)))):
                    x, y = start[some][:, None] + i, start[some][:, None] + j
                    cells = np.stack([np.repeat(lang[some], len(i)), source[x].ravel(), source[y].ravel(), n[x].ravel(), n[y].ravel()]).astype(np.int64)
                    cells = cells[:, np.lexsort(cells)]
                    first = np.flatnonzero(np.concatenate(([True], (cells[:, 1:] != cells[:, :-1]).any(0))))
                    tally, cells = np.diff(np.append(first, cells.shape[1])), cells[:, first]
                    text = [pa.array(langs.dictionary).take(pa.array(cells[0])), *(pa.array(ordered).take(pa.array(c)) for c in cells[1:3])]
                    yield pa.RecordBatch.from_arrays([*text, pa.array(cells[3]), pa.array(cells[4]), pa.array(tally)], ["lang", "a", "b", "na", "nb", "many"])
        tidy()

    return terms_.mapInArrow(work, "lang string, a string, b string, na long, nb long, many long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exact for all longs; null where nothing is kept."""
    over = total.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * F.lit(2)
    return F.call_function("div", (count.cast("decimal(20,0)") + F.lit(2)) * F.lit(SCALE), F.nullif(over, F.lit(0).cast("decimal(20,0)"))) + F.lit(1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares; they are SCALE + 1 at most, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all sources a < b of a language, from the joint histogram of their counts."""
    pair = ["lang", "a", "b"]
    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), F.col("own").alias("own_a"), "kept")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.col("own").alias("own_b"))
    pairs = stored(one.join(two, "lang").where("a < b"), "source-pairs")
    near = small(pairs)
    joint = stored(_met(kept.select("lang", "used")).groupBy(*pair, "na", "nb").agg(F.sum("many").alias("many")), "joint")
    histogram = stored(kept.select("lang", F.explode("used").alias("u")).groupBy("lang", "u.source", "u.n").agg(F.count("*").alias("many")), "histogram")

    def cell(na: Column, nb: Column, many: Column) -> Column:
        return F.struct(na.cast("long").alias("na"), nb.cast("long").alias("nb"), many.cast("long").alias("many"))

    zero, na, nb, n, many = F.lit(0), F.col("na"), F.col("nb"), F.col("n"), F.col("many")
    # A term that both have leaves the cells of terms that one of them lacks; both marginals and the rest take it out there.
    met = joint.select(*pair, F.explode(F.array(cell(na, nb, many), cell(na, zero, -many), cell(zero, nb, -many), cell(zero, zero, many))).alias("c"))
    first = near.select(*pair).join(histogram.withColumnRenamed("source", "a"), ["lang", "a"]).select(*pair, cell(n, zero, many).alias("c"))
    second = near.select(*pair).join(histogram.withColumnRenamed("source", "b"), ["lang", "b"]).select(*pair, cell(zero, n, many).alias("c"))
    neither = pairs.select(*pair, cell(zero, zero, F.col("kept") - F.col("own_a") - F.col("own_b")).alias("c"))
    cells = met.unionAll(first).unionAll(second).unionAll(neither).select(*pair, "c.*").groupBy(*pair, "na", "nb").agg(F.sum("many").alias("many")).where("many > 0")
    p, q = share(na, F.col("total_a"), F.col("kept")), share(nb, F.col("total_b"), F.col("kept"))
    valued = cells.join(near, pair).select(*pair, "many", p.alias("p"), q.alias("q")).groupBy(*pair).agg(F.sum(gap(F.col("p"), F.col("q")) * F.col("many")).alias("value"))
    return pairs.select(*pair).join(small(stored(valued, "valued")), pair, "left").select(*pair, F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    A language keeps the terms that are in at least ``least`` of its documents. With p the share of a term in a source,
    over kept terms and smoothed, and q that in another, they are (p - q)^2 / (p + q) apart in it. Part ``pair`` has all
    other sources by their sum over kept terms; part ``term`` the ``top`` terms that the source uses more than its
    language does, by how far it is from that. Ranks start at 1; ties go by the items' UTF-8.

    Null texts, languages and sources are empty ones, and the empty name is a language or source like others. A source
    without terms has its rows too; where a language keeps none its pairs' values are 0. Repeated rows count as often as
    they are there; texts are read whole; other columns play no part; an empty table gives no rows. A term's list has an
    entry for each of its sources, which a task holds, and pairs are as many as there are rows to return.
    """
    ready(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = stored(_counted(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    listed = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("whole"), F.collect_list(F.struct("source", "n")).alias("used"))
    kept = stored(listed.where(F.col("d") >= least).select("lang", "term", "whole", "used"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    used = kept.select("lang", "term", "whole", F.explode("used").alias("u")).select("lang", "term", "whole", "u.source", "u.n")
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "own", "kept", "lang_total"]), "groups")
    pairs = _pairs(kept, groups)
    other = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    told = used.join(small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    told = told.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    # The limit is pushed before the shuffle: of a source's terms a task hands on the first ones.
    return ranked(other, "pair").unionAll(ranked(told, "term").where(F.col("rank") <= top))
