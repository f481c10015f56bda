"""Exact Jaccard self-join of documents' word shingles by parity sketches.

Sets A and B with similarity of at least t differ in d <= (|A| + |B|) (1 - t) / (1 + t) shingles. Sets are put in bands
by size, and in a band of largest d each shingle flips one bit of one of P = d + 1 + E + R parts of a bit sketch. A
shingle that both sets have cancels in the XOR of their sketches, so the Hamming distance never exceeds d, and at least
1 + E + R parts agree in all bits. Documents are joined on those parts; a hash of (band, part, bits) is the join key.

An empty part says nothing and is no key. A set with at most E empty parts shares 1 + R keys at least with each that it
links to. A set with more is dealt anew with another seed, under whose parts it is joined too: two sets that agree in
too many empty parts both have over E of them and meet there.

Parts are dealt to groups, and a key comes with its mark, the parity sketch of its group in 32 bits. A group of q parts
in which two sets differ by q shingles or more need have no part in common, and the sum of q - (differing shingles) over
the other groups is 1 + E + R at least. So only members of a bucket whose marks are under q bits apart count, and a
linked pair still has 1 + R such keys. Passages that many documents share thus make few candidates: the rest of the
group differs.

Candidates with 1 + R common keys go on to a comparison of whole sketches, four bits or more for each shingle. What is
near there belongs to one family, in which the sets of shingles themselves are compared (see ``families``). Two kinds of buckets make families by themselves: those whose
members are mostly near each other, as of many near copies, and those of over GATHERED members. Of the latter a set may
leave out R by band, as it then still has a common key with each that it links to.

Equal sets are one vertex throughout, so copies never meet as pairs. Keys are worked off in SLICES, one after another,
which bounds the disk that their shuffles take.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import digest, far, named, sketch, sketch_bits
from .shared import Hashes, as_bytes, drop, fresh, mix, place, ready, shingles, small, stored, tidy, words

#: Bits of a part; parts of a group.
PART_BITS, GROUP = 128, 6
#: Members of a bucket that are gathered; pairs a member by which a bucket goes out as pairs, else as a family.
GATHERED, DENSE = 2048, 16
#: Low bits of a join key that tell its band; the next ones tell its slice.
BAND_BITS, SLICES = 9, 4
#: Seeds tried at most; a set that still has too many empty parts then also joins on them.
SEEDS = 24


def differ(a: int, b: int, t: Fraction) -> int:
    """The largest symmetric difference of linked sets of a and b shingles."""
    return int((a + b) * (1 - t) / (1 + t))


def bands(t: Fraction, most: int = 1 << 40) -> list[int]:
    """Lower bounds of the size bands; a band's sets can link to those of the next at most, but for the smallest sizes."""
    out, low = [], 1
    while low < most:
        out.append(low)
        low = max(low + 1, int(low / t))
    return out


def parts_of(band: int, lows: list[int], t: Fraction) -> tuple[int, int, int]:
    """Parts of the band's sketches, E and R. The band also takes larger sets that can link to one of its own."""
    top = lows[band + 1] - 1
    d = differ(top, int(top / t), t)
    more = (d + 4) // 8
    # Empty parts of the band's smallest sets: their mean, and two deviations.
    mean = (d + 1 + more) * math.exp(-lows[band] / (1.06 * (d + 1 + more)))
    empty = 1 + int(1.2 * mean + 2 * math.sqrt(mean)) if d else 0
    return d + 1 + empty + more, empty, more


class Keys:
    """Join keys of shingle sets, and their marks. It is made by the driver, so all tasks lay out parts alike."""

    def __init__(self, t: Fraction):
        self.t, self.lows = t, bands(t)
        self.starts = np.array(self.lows)
        self.layout = [parts_of(b, self.lows, t) for b in range(len(self.lows) - 1)]
        self.groups = [max(1, parts // GROUP) for parts, _, _ in self.layout]
        #: By band, the bits by which marks of a group with a common part may differ.
        self.apart = np.array([-(-parts // groups) - 1 for (parts, _, _), groups in zip(self.layout, self.groups, strict=True)])

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(own)
        band = int(np.searchsorted(self.starts, n, "right")) - 1
        out = self._band(own, band)
        # Where the largest set of the band below can link to this one, they meet under that band's parts.
        while band and (self.lows[band] - 1) * self.t.denominator >= n * self.t.numerator:
            band -= 1
            out += self._band(own, band)
        return np.concatenate([k for k, _ in out]), np.concatenate([m for _, m in out])

    def _band(self, own: np.ndarray, band: int) -> list[tuple[np.ndarray, np.ndarray]]:
        parts, spare, more = self.layout[band]
        low, out = np.uint64((1 << BAND_BITS) - 1), []
        for seed in range(SEEDS):
            salt = np.uint64(((band << 8 | seed) * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            dealt = mix(own ^ salt)
            part = ((dealt >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint16) if parts < 65_536 else part, kind="stable")
            part, dealt = part[order], dealt[order]
            cell = mix((part * np.uint64(PART_BITS) + (dealt & np.uint64(PART_BITS - 1))) ^ salt)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sketch = np.bitwise_xor.reduceat(cell, first)
            group = (part * np.uint64(self.groups[band])) // np.uint64(parts)
            border = np.concatenate(([True], group[1:] != group[:-1]))
            mark = np.bitwise_xor.reduceat(np.uint32(1) << (dealt >> np.uint64(8) & np.uint64(31)).astype(np.uint32), np.flatnonzero(border))
            keys = mix(sketch ^ mix(part[first] ^ salt))
            out.append((keys & ~low | np.uint64(band), mark[(np.cumsum(border) - 1)[first]]))
            if parts - len(first) <= spare:
                break
        else:  # sets that all seeds leave too many empty parts all meet
            keys = mix(np.arange(1 + more, dtype=np.uint64) ^ salt)
            out.append((keys & ~low | np.uint64(band), np.zeros(1 + more, np.uint32)))
        return out


def _profiles(docs: DataFrame, k: int, keys: Keys) -> DataFrame:
    """(id, mark, n, node, rest, sketch, and keys and marks by slice): node and rest tell equal sets. Empty sets have nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            n, node, rest, sketches, found = [], [], [], [], []
            for text in as_bytes(b.column("text")):
                own = shingles(hashes.of(words(text)), k)
                n.append(len(own))
                if len(own):
                    hi, lo = digest(own)
                    node.append(hi - (1 << 64) if hi >> 63 else hi)
                    rest.append(lo - (1 << 64) if lo >> 63 else lo)
                    sketches.append(sketch(own, sketch_bits(len(own))).tobytes())
                    found.append(keys.of(own))
                else:
                    node.append(None)
                    rest.append(None)
                    sketches.append(None)
                    found.append((np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
            columns = [b.column("id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(rest, pa.int64()), pa.array(sketches, pa.binary())]
            owner = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            every, marks = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.uint64, np.uint32)))
            of = every >> np.uint64(BAND_BITS) & np.uint64(SLICES - 1)
            for s in range(SLICES):
                own = of == s
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[own], minlength=len(found))))), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(every[own].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(marks[own].view(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names)
        tidy()

    by_slice = [f"{what}{s}" for s in range(SLICES) for what in ("keys", "marks")]
    names = ["id", "mark", "n", "node", "rest", "sketch", *by_slice]
    kinds = ", ".join(f"{c} array<{'long' if c.startswith('keys') else 'int'}>" for c in by_slice)
    return docs.mapInArrow(work, f"id {dict(docs.dtypes)['id']}, mark long, n long, node long, rest long, sketch binary, {kinds}")


def _near(pairs: DataFrame, t: Fraction) -> DataFrame:
    """(u, v) of those (u, v, nu, nv, a, b) whose sketches a and b aren't farther apart than linked sets can be."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column("nu").to_numpy() + b.column("nv").to_numpy()) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
            ok = [far(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) <= m for x, y, m in zip(b.column("a"), b.column("b"), most, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(work, "u long, v long")


def _met(buckets: DataFrame, keys: Keys) -> DataFrame:
    """(band, u, v) of the pairs in buckets (bucket, m) of (node, mark) whose marks allow a link.

    Of a bucket with over ``DENSE`` such pairs a member, (-1, member, the first of those that it is near to in steps).
    """
    apart, dense = keys.apart, DENSE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("m")
            flat = lists.flatten()
            node, mark = flat.field("node").to_numpy(), flat.field("mark").to_numpy().view(np.uint32)
            band = b.column("bucket").to_numpy() & (1 << BAND_BITS) - 1
            owner = np.repeat(np.arange(len(band)), lists.value_lengths().to_numpy())
            order = np.lexsort((node, owner))
            node, mark, owner = node[order], mark[order], owner[order]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (node[1:] != node[:-1]))) if len(node) else np.zeros(0, bool)
            node, mark, owner = node[new], mark[new], owner[new]
            many = np.bincount(owner, minlength=len(band))
            start = np.cumsum(many) - many
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for m in np.unique(many):
                if m < 2:
                    continue
                which = np.flatnonzero(many == m)
                if m <= 2 * dense + 1:  # never dense
                    i, j = np.triu_indices(m, 1)
                    for some in np.array_split(which, -(-len(which) * len(i) // 1_000_000)):
                        at = start[some][:, None]
                        ok = np.bitwise_count(mark[at + i] ^ mark[at + j]) <= apart[band[some]][:, None]
                        of, pair = np.nonzero(ok)
                        out.append((band[some][of], node[start[some][of] + i[pair]], node[start[some][of] + j[pair]]))
                else:
                    for x in which:
                        out.append(_large(band[x], node[start[x] : start[x] + m], mark[start[x] : start[x] + m], apart, dense))
            columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])], ["band", "u", "v"])
        tidy()

    return buckets.mapInArrow(work, "band int, u long, v long")


def _large(band: int, node: np.ndarray, mark: np.ndarray, apart: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_met`` has of one bucket of distinct nodes."""
    m, first, second, found = len(node), [], [], 0
    group = np.arange(m)
    for i in range(m - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(mark[i + 1 :] ^ mark[i]) <= apart[band])
        found += len(near)
        if found <= dense * m:
            first.append(np.full(len(near), i))
            second.append(near)
        # A group is named by its first member.
        joined = np.unique(np.append(group[near], group[i]))
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    if found <= dense * m:
        i, j = np.concatenate(first), np.concatenate(second)
        return np.full(len(i), band), node[i], node[j]
    other = np.flatnonzero(group != np.arange(m))
    return np.full(len(other), -1), node[other], node[group[other]]


def _slice(whole: DataFrame, s: int, keys: Keys) -> tuple[DataFrame, DataFrame | None]:
    """Of one slice of the keys: (band, u, v, common) of pairs and, for band -1, of families; (node, bucket, hub) of buckets of over GATHERED sets, if there are any."""
    plain = whole.select("node", F.explode(f"keys{s}").alias("bucket"))
    keyed = whole.select("node", F.explode(F.arrays_zip(F.col(f"keys{s}").alias("bucket"), F.col(f"marks{s}").alias("mark"))).alias("k")).select("node", "k.bucket", "k.mark")
    # Buckets with two sets at least, found with fixed-width aggregates that combine before the shuffle.
    shared = plain.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("rows")).where("low < high")
    shared = stored(shared.select("bucket", F.least("rows", F.lit(GATHERED + 1)).cast("int").alias("rows")), "shared")
    # Shuffled and sorted at any size, and so gathered: both sides are in the billions where it matters.
    rare = keyed.join(shared.where(F.col("rows") <= GATHERED).select("bucket").hint("merge"), "bucket", "left_semi")

    def gathered(rows: DataFrame) -> DataFrame:
        """Joined by bucket, rows are where they are gathered."""
        return _met(rows.groupBy("bucket").agg(F.collect_list(F.struct("node", "mark")).alias("m")), keys)

    def counted(met: DataFrame) -> DataFrame:
        return stored(met.groupBy("band", "u", "v").agg(F.count("*").alias("common")), "met")

    many = shared.where(F.col("rows") > GATHERED).select("bucket")
    if many.isEmpty():
        met = counted(gathered(rare))
        drop(whole.sparkSession, place(shared))
        return met, None
    # Rows may be copies of fewer sets: a bucket of many rows is gathered yet if its sets are few.
    members = stored(keyed.join(small(many), "bucket", "left_semi").distinct(), "members")
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("hub")), "sizes")
    copied = members.join(small(sizes.where(F.col("size") <= GATHERED).select("bucket")), "bucket", "left_semi")
    met = counted(gathered(rare).unionAll(gathered(copied)))
    hot = stored(members.join(small(sizes.where(F.col("size") > GATHERED).select("bucket", "hub")), "bucket").select("node", "bucket", "hub"), "hot")
    for gone in (shared, members, sizes):
        drop(whole.sparkSession, place(gone))
    return met, hot


def _named(docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """For (id, mark, text): profiles of all rows, and (node, rest, component_id, keeper_id, keeper_mark) of all sets."""
    spark, keys = docs.sparkSession, Keys(t)
    whole = stored(_profiles(docs, k, keys), "keys")
    profiles = whole.select("id", "mark", "n", "node", "rest")
    # Vertices: one for each set. Its keeper is the row of the smallest id, then the smallest mark.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    vertices = stored(profiles.where("node is not null").groupBy("node", "rest").agg(F.min(order).alias("keeper")), "vertices")
    slices = [_slice(whole, s, keys) for s in range(SLICES)]
    # One file holds a slice's keys, sketches and numbers: what is read again is written apart before the keys go.
    profiles, sketches = stored(profiles, "profiles"), stored(whole.where("node is not null").select("node", "n", "sketch"), "sketches")
    drop(spark, place(whole))
    met = slices[0][0]
    for m, _ in slices[1:]:
        met = met.unionAll(m)
    spare = F.array(*[F.lit(more) for _, _, more in keys.layout])
    pairs = met.where("band >= 0").groupBy("u", "v", "band").agg(F.sum("common").alias("common"))
    near = met.where("band < 0").select("u", "v")
    hots = [h for _, h in slices if h is not None]
    if hots:
        hot = hots[0]
        for h in hots[1:]:
            hot = hot.unionAll(h)
        hot = hot.withColumn("band", F.col("bucket").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int"))
        # A set leaves out its large buckets of a band if they are R at most; those of the others make families.
        large = stored(hot.groupBy("node", "band").agg(F.count("*").alias("lost")), "large")
        left_out = large.where(F.col("lost") <= F.element_at(spare, F.col("band") + 1))
        staying = hot.join(small(left_out.select("node", "band")), ["node", "band"], "left_anti")
        near = near.unionAll(staying.select(F.col("node").alias("u"), F.col("hub").alias("v")))
        lost = small(left_out.select(F.col("node").alias("u"), "band", F.col("lost").alias("lost_u")))
        pairs = pairs.join(lost, ["u", "band"], "left").join(lost.withColumnsRenamed({"u": "v", "lost_u": "lost_v"}), ["v", "band"], "left")
        pairs = pairs.withColumn("common", F.col("common") + F.greatest(F.coalesce("lost_u", F.lit(0)), F.coalesce("lost_v", F.lit(0))))
    pairs = stored(pairs.where(F.col("common") > F.element_at(spare, F.col("band") + 1)).select("u", "v").distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    # Copies of a set are combined before the shuffle, and then joined where they are.
    seen = stored(sketches.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(wanted, "node", "left_semi"), "seen")
    sides = pairs.join(seen.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("a")), "u").join(seen.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("b")), "v")
    fits = F.least("nu", "nv") * F.lit(t.denominator) >= F.greatest("nu", "nv") * F.lit(t.numerator)
    near = _near(sides.where(fits), t).unionAll(near)
    return profiles, named(docs, vertices, near, k, t)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, t: Fraction = Fraction(8, 10)) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs.

    A row's set is that of its distinct k-word shingles; with fewer words the whole sequence is one; without words or
    with a null text it is empty, and linked with nothing. Rows link when |A and B| >= t |A or B|; a component is named
    by the smallest key reachable by links. Equal sets link, so repeated rows share a component. Keys are integers; one
    may repeat, or be null and then names nothing but a row without others. Texts may be of any length and are read
    whole; other columns play no part, whatever they are called. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    profiles, names = _named(docs.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("mark"), F.col(text).alias("text")), k, t)
    out = profiles.select("id", "n", "node", "rest").join(names, ["node", "rest"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, t: Fraction = Fraction(8, 10)) -> DataFrame:
    """One row of each component of ``join``, with all its columns: that of the smallest key, then of a hash of the text.

    Rows with empty sets, as of null texts, all stay. Of rows that repeat a key and a text one stays. Without rows there
    are none.
    """
    ready(docs.sparkSession)
    mark = F.coalesce(F.xxhash64(docs[text]), F.lit(0))
    profiles, names = _named(docs.select(F.col(key).alias("id"), mark.alias("mark"), F.col(text).alias("text")), k, t)
    found = profiles.where("node is not null").select("id", "mark", "node", "rest").join(names, ["node", "rest"])
    stays = F.col("id").eqNullSafe(F.col("keeper_id")) & (F.col("mark") == F.col("keeper_mark"))
    own_id, own_mark = fresh(docs, "_id"), fresh(docs, "_mark")
    pair = F.col("id").alias(own_id), F.col("mark").alias(own_mark)
    gone = stored(found.where(~stays).select(*pair).distinct(), "gone")
    same = docs[key].eqNullSafe(F.col(own_id)) & (mark == F.col(own_mark))
    kept = docs.join(small(gone), same, "left_anti")
    repeated = stored(found.where(stays).groupBy(*pair).agg(F.count("*").alias("rows")).where("rows > 1").select(own_id, own_mark), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(small(repeated), same, "left_semi").dropDuplicates([key, text])
    return kept.join(small(repeated), same, "left_anti").unionByName(again)
