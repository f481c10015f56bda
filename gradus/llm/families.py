"""Exact links and components of shingle sets, within families of sets that a cheaper comparison holds for near.

The sets of a family are compared in blocks of bounded members and bytes. First each block is compared in itself and
with the family's hub, a set that goes to all of its blocks: where all members link to the hub, or to one that does, as
copies of one text do, a family of n sets takes n comparisons by block and is done. Of a family that is not, the largest
group found so far stands on one side: only its other sets are compared with each other and with that group, and pairs
that one group holds are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Hashes, as_bytes, shingles, small, stored, tidy, words

#: Members of a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 8 << 20


def digest(own: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(own.tobytes())
    return h >> 64, h & (1 << 64) - 1


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, rest, shingles): the sets' hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            node, rest, found = [], [], []
            for text in as_bytes(b.column("text")):
                own = shingles(hashes.of(words(text)), k)
                if len(own):
                    hi, lo = digest(own)
                    node.append(hi - (1 << 64) if hi >> 63 else hi)
                    rest.append(lo - (1 << 64) if lo >> 63 else lo)
                    found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(rest, pa.int64()), pa.array(found, pa.binary())], ["node", "rest", "shingles"])
        tidy()

    return docs.mapInArrow(work, "node long, rest long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    """Whether two sets of sorted hashes have a similarity of at least t."""
    x, y = sorted((len(a), len(b)))
    if not x or x * t.denominator < y * t.numerator:
        return False
    if x > 4000:
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    else:
        both = x + y - len(np.unique(np.concatenate((a, b))))
    return both * t.denominator >= (x + y - both) * t.numerator


def sketch_bits(n: int) -> int:
    """Bits of the whole sketch of n shingles: a power of two of at least four for each."""
    return max(256, 1 << (4 * n - 1).bit_length())


def sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """A parity sketch of a whole set: bit i is the number, modulo 2, of shingles dealt to it."""
    odd = np.bincount((own >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def far(a: np.ndarray, b: np.ndarray) -> int:
    """The Hamming distance of two sketches; the longer is folded, as the XOR of its halves is the shorter sketch."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def compare(vertex: np.ndarray, side: np.ndarray, label: np.ndarray, same: bool, sets: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """Links that leave the exact groups of all members (same), or join those of two sides; equal labels are joined.

    Groups of all members are told as stars: each member with the smallest of its group.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    vertex, side, sets = vertex[order], side[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    bits = min(sketch_bits(int(size.max())), 1 << 16)
    sketches = np.stack([sketch(s, bits) for s in sets])
    group, out = np.unique(label[order], return_inverse=True)[1], []
    for i in range(len(sets)):
        # Sizes rise: later members link up to size / t.
        end = int(np.searchsorted(size, size[i] * t.denominator // t.numerator, "right"))
        rest = np.arange(i + 1, end)
        rest = rest[group[rest] != group[i]]
        if not same:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(1)
        most = ((size[rest] + size[i]) * (t.denominator - t.numerator)) // (t.denominator + t.numerator)
        for j in rest[apart <= most]:
            if group[j] != group[i] and linked(sets[i], sets[j], t):
                out.append((int(vertex[i]), int(vertex[j])))
                group[group == group[j]] = group[i]
    if not same:
        return out
    found, which = np.unique(group, return_inverse=True)
    least = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(least, which, vertex)
    return [(int(v), int(m)) for v, m in zip(vertex, least[which], strict=True) if v != m]


def _compared(dealt: DataFrame, t: Fraction) -> DataFrame:
    """Links (u, v) of (family, one, two, own, label, u, shingles), by (family, one, two)."""

    def work(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        vertex, side, label = (table.column(c).to_numpy() for c in ("u", "own", "label"))
        found = compare(vertex, side, label, table.column("one")[0] == table.column("two")[0], sets, t)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("family", "one", "two").applyInArrow(work, "u long, v long")


def _blocks(members: Column, size: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(0)).cast("int")


def links(members: DataFrame, t: Fraction) -> DataFrame:
    """Of a stored (family, u, shingles), links (u, v) that leave each family in its exact components."""
    counted = (F.count("*").alias("members"), F.sum(F.octet_length("shingles")).alias("bytes"))
    counts = stored(members.groupBy("family").agg(F.min("u").alias("hub"), *counted).select("family", "hub", _blocks(F.col("members"), F.col("bytes")).alias("blocks")), "counts")
    near = members.join(small(counts), "family")
    block = F.pmod(F.xxhash64("u", F.lit("block")), F.col("blocks")).cast("int")
    # The hub is in its own block and in all others.
    at = F.explode(F.when(F.col("u") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)))
    dealt = near.select("family", at.alias("one"), "u", "shingles").select("family", "one", F.col("one").alias("two"), F.col("one").alias("own"), F.col("u").alias("label"), "u", "shingles")
    first = stored(_compared(dealt, t), "first")
    many = counts.where("blocks > 1").select("family")
    if many.isEmpty():
        return first
    # The hub is the smallest of its family, and in each block: what links to it anywhere has it for a label, and a
    # member outside of its group is in one block alone.
    groups = first.select("u", F.col("v").alias("label"))
    open_ = members.join(small(many), "family", "left_semi").join(small(groups), "u", "left").withColumn("label", F.coalesce("label", "u"))
    labelled = stored(open_.select("family", "u", "label", F.octet_length("shingles").alias("bytes")), "labelled")
    by_label = stored(labelled.groupBy("family", "label").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes")), "groups")
    largest = by_label.groupBy("family").agg(F.max(F.struct("members", "label")).alias("main"), F.count("*").alias("parts"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes"))
    sides = largest.where("parts > 1").select("family", F.col("main.label").alias("main"), "members", "bytes").join(by_label.select("family", F.col("label").alias("main"), F.col("members").alias("m"), F.col("bytes").alias("b")), ["family", "main"])
    rests, mains = _blocks(F.col("members") - F.col("m"), F.col("bytes") - F.col("b")), _blocks(F.col("m"), F.col("b"))
    sides = stored(sides.select("family", "main", rests.alias("rests"), mains.alias("mains")), "sides")
    if sides.isEmpty():
        return first
    # Blocks 0 to rests - 1 are of the sets outside the largest group, those from rests on are of that group.
    rest = F.col("label") != F.col("main")
    spread = F.xxhash64("u", F.lit("block"))
    own = F.when(rest, F.pmod(spread, F.col("rests"))).otherwise(F.col("rests") + F.pmod(spread, F.col("mains"))).cast("int")
    others = F.when(rest, F.sequence(F.lit(0), F.col("rests") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    again = members.join(small(labelled.select("u", "label")), "u").join(small(sides), "family").withColumn("own", own).withColumn("other", F.explode(others))
    again = again.select("family", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "label", "u", "shingles")
    return first.unionAll(stored(_compared(again, t), "second"))


def named(docs: DataFrame, vertices: DataFrame, near: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(node, rest, component_id, keeper_id, keeper_mark) of all vertices.

    Vertices are (node, rest, keeper: the first row of that set, a struct with id and mark); near are pairs (u, v) of
    nodes whose sets may be linked, and all that are linked must be joined by them; docs are (id, text).
    """
    families = stored(components(stored(near, "near")).select(F.col("node").alias("u"), F.col("component").alias("family")), "families")
    # The texts of families' sets are read again, by id: those of others are never shuffled.
    nameless = F.lit(-(1 << 63))
    ids = vertices.join(families.select(F.col("u").alias("node")), "node", "left_semi").select(F.coalesce(F.col("keeper.id").cast("long"), nameless).alias("_first"))
    ids = stored(ids.distinct(), "wanted")
    texts = docs.withColumn("_first", F.coalesce(F.col("id").cast("long"), nameless)).join(small(ids), "_first", "left_semi")
    sets = _sets(texts.select("text"), k).groupBy("node", "rest").agg(F.first("shingles").alias("shingles"))
    members = stored(families.join(sets.select(F.col("node").alias("u"), "shingles"), "u").select("family", "u", "shingles"), "members")
    found = components(links(members, t))
    labelled = vertices.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labelled.groupBy("component").agg(F.min("keeper.id").alias("component_id"), F.min("keeper").alias("kept"))
    out = labelled.join(names, "component").select("node", "rest", "component_id", F.col("kept.id").alias("keeper_id"), F.col("kept.mark").alias("keeper_mark"))
    return stored(out, "names")
