"""Judge URLs by a list of hosts and path prefixes, found through a blocked Bloom filter and an exact hash join.

A listed entry is a canonical ``host/path`` key. A URL's candidate keys are each suffix of its host, at label borders,
with each listed length of its path's prefixes. One 512-bit block of the filter, chosen by a key's hash, holds all of
the key's bits. The filter also has the listed hosts, so paths are tried only on hosts that may be listed. It is probed
row by row before anything is shuffled: rows without a possible hit are done. The others' possible hits go on to a hash
join with the list on the whole key, which removes the false positives, so the filter's size changes the cost and never
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, small, stored, tidy

#: Bits set by a key in its block, and the bits of filter for each listed key.
PROBES, BITS_PER_KEY, BLOCK_BITS = 8, 16, 512
#: The filter is at most so many blocks (32 MB), sent to every worker: a longer list only has more false hits.
MAX_BLOCKS = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Eight longs with the key's bits: each of the PROBES takes 9 bits of a hash."""
    h = F.xxhash64(key, F.lit("bits")), F.xxhash64(key, F.lit("more"))
    at = [F.shiftrightunsigned(h[i % 2], 9 * (i // 2)).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    masks = []
    for w in range(BLOCK_BITS // 64):
        out = F.lit(0).cast("long")
        for a in at:
            hit = F.shiftright(a, 6) == w
            out = out.bitwiseOR(F.when(hit, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        masks.append(out)
    return masks


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: one row (block, w0 to w7) for each block that has a bit; keys are combined before the shuffle."""
    parts = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)])


class Filter:
    """The filter's blocks on a worker, hashed as ``_block`` and ``_masks`` do."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def has(self, key: str) -> bool:
        def hashed(word: bytes) -> int:
            return xxhash.xxh64_intdigest(word, seed)

        seed = xxhash.xxh64_intdigest(key.encode(), 42)
        at = hashed(b"block")
        block = self.blocks[(at - (1 << 64) if at >> 63 else at) % len(self.blocks)]
        one, two = hashed(b"bits"), hashed(b"more")
        for i in range(PROBES):
            bit = ((two if i % 2 else one) >> (9 * (i // 2))) & 511
            if not int(block[bit >> 6]) >> (bit & 63) & 1:
                return False
        return True


def _probed(rows: DataFrame, blocks: np.ndarray, labels: int, lengths: list[int]) -> DataFrame:
    """rows (id, url, host, path) with hits: the candidate keys that the filter has, and the lengths of their parts."""
    sent = rows.sparkSession.sparkContext.broadcast((blocks, labels, lengths))
    kind = pa.list_(pa.struct([("key", pa.string()), ("host_length", pa.int32()), ("listed_length", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, labels, lengths = sent.value
        known = Filter(blocks)
        for b in batches:
            hits = []
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                own, at = [], len(host)
                # Suffixes of no more labels than the longest listed host has, so a long host costs no more than its length.
                for _ in range(labels if host else 0):
                    at = host.rfind(".", 0, at)
                    suffix = host[at + 1 :]
                    if known.has(f"{suffix}\n"):
                        own += [{"key": key, "host_length": len(suffix), "listed_length": n} for n in lengths if n <= len(path) and known.has(key := suffix + path[:n])]
                    if at < 0:
                        break
                hits.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, kind)], [*b.schema.names, "hits"])
        tidy()

    id_kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(work, f"id {id_kind}, url string, host string, path string, hits array<struct<key:string,host_length:int,listed_length:int>>")


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: its key, host, path, the longest listed entry that fits, and that entry's verdict.

    listed: (host, path, verdict, rule). An entry fits its host and all subdomains where the url's path starts with its
    path. Entries with a rule go before those where it is null, which only name URLs; then the longest host and path
    win, then the smaller verdict. A page that no entry fits has a null rule and the default verdict; so does a null
    url, or one without ``://``. URLs may be of any length.
    Rows that repeat a key and url are all kept; repeated entries count once. With an empty list all get the default,
    and without pages there are no rows.
    """
    spark = pages.sparkSession
    ready(spark)
    listed = listed.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict", "rule").where("host <> ''")
    listed = listed.withColumn("key", F.concat("host", "path")).withColumn("listed_length", F.length("path"))
    entries = listed.groupBy("key", "listed_length").agg(F.min(F.struct(F.col("rule").isNull().alias("unnamed"), "verdict", "rule")).alias("entry"), F.max(F.size(F.split("host", r"\."))).alias("labels"))
    entries = stored(entries, "entries")
    count, lengths, labels = entries.agg(F.count("*"), F.array_sort(F.collect_set("listed_length")), F.max("labels")).first()
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rules = entries.drop("labels")
    if not count:
        return rows.select(F.col("id").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    number = max(1, min(MAX_BLOCKS, -(-2 * count * BITS_PER_KEY // BLOCK_BITS)))
    hosts = rules.select(F.concat(F.expr("left(key, length(key) - listed_length)"), F.lit("\n")).alias("key")).distinct()
    found = bloom(rules.select("key").unionAll(hosts), number).toArrow()
    blocks = np.zeros((number, BLOCK_BITS // 64), np.uint64)
    blocks[found.column("block").to_numpy()] = np.stack([found.column(f"w{i}").to_numpy() for i in range(BLOCK_BITS // 64)], 1).view(np.uint64)
    probed = stored(_probed(rows, blocks, labels, lengths), "probed")
    done = probed.where(F.size("hits") == 0).select("id", "host", "path", F.lit(None).cast("struct<unnamed:boolean,verdict:string,rule:string>").alias("entry"))
    # Only rows with possible hits are shuffled.
    hit = probed.where(F.size("hits") > 0)
    exact = hit.select("id", "url", F.explode("hits").alias("h")).select("id", "url", "h.*").join(small(rules, 200_000), ["key", "listed_length"])
    best = exact.groupBy("id", "url").agg(F.max_by("entry", F.struct(~F.col("entry.unnamed"), F.col("host_length") + F.col("listed_length"), "host_length")).alias("entry"))
    same = F.col("p.id").eqNullSafe(F.col("b.id")) & F.col("p.url").eqNullSafe(F.col("b.url"))
    judged = hit.alias("p").join(best.alias("b"), same, "left").select(F.col("p.id").alias("id"), "host", "path", "entry")
    return done.unionAll(judged).select(F.col("id").alias(key), "host", "path", F.col("entry.rule").alias("rule"), F.coalesce("entry.verdict", F.lit(default)).alias("verdict"))
