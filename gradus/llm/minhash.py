"""Near copies by MinHash: banded candidates, sequential Bayesian verification of signatures, exact verification of survivors.

A shingle set's signature has the smallest value of the set under each of many hash functions; two sets agree in one of
them with the probability of their similarity s. Bands of ROWS such values make join keys: a pair of similarity t or more
has no key in common with a probability of at most (1 - t^r)^b, and r and b are chosen so that it is below MISS.

Candidates are then compared in batches of hash functions. After n of them with m agreements, and any similarity as
likely as any other before, P(s >= t | m, n) is that of at most m successes in n + 1 draws of probability t. A pair goes
as soon as this is below MISS; what stays to the end survives. The first batch is of functions that no band uses, so it
isn't biased by what made the pair a candidate; it is compared within the buckets, before any pair is made. Agreements
are told from one byte of each value: other values agree in one of 256, which can only keep a pair.

Survivors make families, in which the sets themselves are compared (see ``families``). A bucket whose members mostly
survive the first batch, as of many near copies, makes a family without its pairs, as does one of over GATHERED members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .families import digest, named
from .shared import Hashes, as_bytes, drop, mix, place, ready, shingles, small, stored, tidy, words

#: The chosen miss probability of banding, and of each comparison of a batch.
MISS = 1e-10
#: Bands at most: the longest rows are taken with which so many do. Functions of the first batch, and of later ones.
BANDS, FIRST, BATCH = 40, 24, 30
#: Members of a bucket that are gathered; pairs a member by which a bucket goes out as pairs, else as a family.
GATHERED, DENSE = 2048, 16
#: Values made in one step, and pairs compared in one.
STEP = 1 << 19


def posterior(agree: int, of: int, t: Fraction) -> float:
    """P(similarity >= t) after so many agreements, from a uniform prior: a tail of the binomial distribution."""
    p = float(t)
    return math.fsum(math.comb(of + 1, i) * p**i * (1 - p) ** (of + 1 - i) for i in range(agree + 1))


class Plan:
    """Rows and bands, and the agreements that a pair must have after each batch, for a similarity and a miss probability."""

    def __init__(self, t: Fraction, miss: float = MISS):
        def bands(rows: int) -> int:
            return max(1, math.ceil(math.log(miss) / math.log1p(-(float(t) ** rows)))) if t < 1 else 1

        self.rows = max([r for r in range(1, 9) if bands(r) <= BANDS], default=1)
        self.bands = bands(self.rows)
        self.hashes = FIRST + self.rows * self.bands
        self.ends = [*range(FIRST, self.hashes, BATCH), self.hashes]
        self.least = [next(m for m in range(end + 1) if posterior(m, end, t) >= miss) for end in self.ends]
        draw = np.random.default_rng(12)
        self.factors, self.shifts = (draw.integers(0, 1 << 63, self.hashes, np.uint64) * np.uint64(2) + np.uint64(x) for x in (1, 0))

    def signature(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each hash function, and the keys of the bands."""
        low, step = None, max(1, STEP // self.hashes)
        for at in range(0, len(own), step):
            values = (own[at : at + step, None] * self.factors + self.shifts).min(0)
            low = values if low is None else np.minimum(low, values)
        keys = np.arange(self.bands, dtype=np.uint64)
        for row in range(self.rows):
            keys = mix(keys + low[FIRST + row :: self.rows])
        return low.astype(np.uint8), keys


def _profiles(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(id, mark, n, node, rest, signature, keys); node and rest tell equal sets. Empty sets have nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            n, node, rest, signature, keys = [], [], [], [], []
            for text in as_bytes(b.column("text")):
                own = shingles(hashes.of(words(text)), k)
                n.append(len(own))
                if len(own):
                    hi, lo = digest(own)
                    node.append(hi - (1 << 64) if hi >> 63 else hi)
                    rest.append(lo - (1 << 64) if lo >> 63 else lo)
                    found, bands = plan.signature(own)
                    signature.append(found.tobytes())
                    keys.append(bands.view(np.int64))
                else:
                    for column in (node, rest, signature, keys):
                        column.append(None)
            columns = [b.column("id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(rest, pa.int64()), pa.array(signature, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n", "node", "rest", "signature", "keys"])
        tidy()

    return docs.mapInArrow(work, f"id {dict(docs.dtypes)['id']}, mark long, n long, node long, rest long, signature binary, keys array<long>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes of one width."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(len(column), width)


def _first_batch(node: np.ndarray, first: np.ndarray, least: int, dense: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a bucket's members that survive the first batch, and False; of a dense one links that join them, and True."""
    m, ones, others, found = len(node), [], [], 0
    group = np.arange(m)
    for i in range(m - 1):
        near = i + 1 + np.flatnonzero((first[i + 1 :] == first[i]).sum(1) >= least)
        found += len(near)
        if found <= dense * m:
            ones.append(np.full(len(near), i))
            others.append(near)
        # A group is named by its first member.
        joined = np.unique(np.append(group[near], group[i]))
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    if found <= dense * m:
        return node[np.concatenate(ones)], node[np.concatenate(others)], False
    other = np.flatnonzero(group != np.arange(m))
    return node[other], node[group[other]], True


def _met(buckets: DataFrame, plan: Plan) -> DataFrame:
    """(u, v, family) of buckets' lists m of (node, first): pairs u < v that survive the first batch, or links of families."""
    least, dense = plan.least[0], DENSE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("m")
            flat = lists.flatten()
            many = lists.value_lengths().to_numpy()
            node, first = flat.field("node").to_numpy(), _matrix(flat.field("first"), FIRST)
            order = np.lexsort((node, np.repeat(np.arange(len(many)), many)))
            node, first = node[order], first[order]
            start = np.cumsum(many) - many
            out = []
            for m in np.unique(many[many > 1]):
                which = np.flatnonzero(many == m)
                if m > 2 * dense + 1:
                    out += [_first_batch(node[s : s + m], first[s : s + m], least, dense) for s in start[which]]
                    continue
                i, j = np.triu_indices(m, 1)  # so few are never dense
                for some in np.array_split(which, min(len(which), -(-len(which) * len(i) * FIRST // STEP))):
                    x, y = (start[some][:, None] + i).ravel(), (start[some][:, None] + j).ravel()
                    stays = (first[x] == first[y]).sum(1) >= least
                    out.append((node[x[stays]], node[y[stays]], False))
            columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in (0, 1)]
            family = np.repeat([o[2] for o in out], [len(o[0]) for o in out]).astype(bool) if out else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(family)], ["u", "v", "family"])
        tidy()

    return buckets.mapInArrow(work, "u long, v long, family boolean")


def survivors(a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
    """Positions of the pairs of signatures that no batch prunes."""
    alive, agree, begin = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for end, least in zip(plan.ends, plan.least, strict=True):
        agree[alive] += (a[alive, begin:end] == b[alive, begin:end]).sum(1)
        alive = alive[agree[alive] >= least]
        begin = end
    return alive


def _verified(pairs: DataFrame, plan: Plan) -> DataFrame:
    """(u, v) of the (u, v, a, b) whose signatures survive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = survivors(*(_matrix(b.column(c), plan.hashes) for c in ("a", "b")), plan)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).take(pa.array(stays))
        tidy()

    return pairs.mapInArrow(work, "u long, v long")


def _survivors(sets: DataFrame, t: Fraction, plan: Plan) -> DataFrame:
    """(u, v): survivors and links of families, of distinct sets (node, n, signature, keys)."""
    spark = sets.sparkSession
    shared = sets.select("node", F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"), F.min("node").alias("hub")).where("rows > 1")
    shared = stored(shared.select("bucket", "hub", (F.col("rows") > GATHERED).alias("large")), "shared")
    keyed = sets.select("node", F.substring("signature", 1, FIRST).alias("first"), F.explode("keys").alias("bucket"))
    # Shuffled and sorted at any size, and so gathered: both sides grow with the input.
    rare = keyed.join(shared.where("not large").select("bucket").hint("merge"), "bucket", "left_semi")
    met = _met(rare.groupBy("bucket").agg(F.collect_list(F.struct("node", "first")).alias("m")), plan)
    met = stored(met.groupBy("u", "v").agg(F.max("family").alias("family")), "met")
    large = shared.where("large").select("bucket", "hub")
    near = met.where("family").select("u", "v")
    if not large.isEmpty():
        near = near.unionAll(sets.select("node", F.explode("keys").alias("bucket")).join(small(large), "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    pairs = met.where("not family").select("u", "v")
    wanted = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    seen = stored(sets.select("node", "n", "signature").join(wanted, "node", "left_semi"), "seen")
    sides = pairs.join(seen.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("signature").alias("a")), "u").join(seen.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("signature").alias("b")), "v")
    fits = F.least("nu", "nv") * F.lit(t.denominator) >= F.greatest("nu", "nv") * F.lit(t.numerator)
    out = stored(_verified(sides.where(fits).select("u", "v", "a", "b"), plan).unionAll(near), "survivors")
    for gone in (shared, met, seen):
        drop(spark, place(gone))
    return out


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, t: Fraction = Fraction(85, 100), miss: float = MISS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs; kept is whether the key names its component.

    A row's set is that of its distinct k-word shingles; with fewer words the whole sequence is one; without words or
    with a null text it is empty, and linked with nothing. Rows link when |A and B| >= t |A or B|, which is confirmed on
    whole sets; a linked pair isn't looked at with a probability of some ``miss``, in which case it may still be joined by
    others. A component is named by the smallest key reachable by links. Equal sets link, so repeated rows share a
    component, and are kept alike. Keys are integers; one may repeat, or be null and then names nothing but a row without
    others, which is kept. Texts may be of any length and are read whole; other columns play no part, whatever they are
    called. An empty table gives no rows.
    """
    spark, plan = docs.sparkSession, Plan(t, miss)
    ready(spark)
    docs = docs.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("mark"), F.col(text).alias("text"))
    whole = stored(_profiles(docs, k, plan), "signatures")
    profiles = whole.select("id", "mark", "n", "node", "rest")
    # Vertices: one for each set, told by the row of the smallest id. Copies are combined before the shuffle.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    vertices = stored(profiles.where("node is not null").groupBy("node", "rest").agg(F.min(order).alias("keeper")), "vertices")
    sets = whole.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    sets, profiles = stored(sets, "distinct-sets"), stored(profiles, "profiles")
    drop(spark, place(whole))
    near = _survivors(sets, t, plan)
    drop(spark, place(sets))
    names = named(docs, vertices, near, k, t)
    component = F.coalesce("component_id", "id")
    out = profiles.select("id", "n", "node", "rest").join(names, ["node", "rest"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
