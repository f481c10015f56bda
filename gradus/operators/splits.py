"""Reproducible samples and splits by hash rank, and audits of what must not be in two places."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a frozen list that is held against itself.
MOST_LISTED = 1000


def rank_key(seed: object, *parts: Column) -> Column:
    """SHA-256 of the seed and parts, with NUL between."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def subset(rows: DataFrame, key: str, k: int, seed: object) -> DataFrame:
    """The k rows of the smallest SHA-256 of ``seed:key``, then key. A top-k: no task sees more than k rows of each other."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("rank_sha256", rank).orderBy("rank_sha256", key).limit(k)


def representatives(rows: DataFrame, scene: str, index: str, seed: object) -> DataFrame:
    """Of each scene the row of the smallest hash, then index: a pre-aggregated minimum, not a sort."""
    ranked = rows.withColumn("rank_sha256", rank_key(seed, F.col(scene), F.col(index)))
    return ranked.groupBy(scene).agg(F.min(F.struct("rank_sha256", index)).alias("x")).select(scene, F.col(f"x.{index}").alias(index), F.col("x.rank_sha256").alias("rank_sha256"))


def split(rows: DataFrame, scene: str, index: str, train: int, validation: int, seed: object) -> DataFrame:
    """Scenes' representatives dealt to train and validation by hash rank; ValueError where there are too few."""
    chosen = representatives(rows, scene, index, seed).orderBy("rank_sha256", scene).limit(train + validation)
    place = F.row_number().over(Window.orderBy("rank_sha256", scene))  # of train + validation rows
    out = chosen.select(scene, index, F.when(place <= train, "train").otherwise("validation").alias("split"))
    if (n := out.count()) < train + validation:
        raise ValueError(f"{n} scenes are too few for {train} and {validation}")
    return out


def overlap(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(value) that stands in any of the columns on both sides."""
    def values(frame: DataFrame) -> DataFrame:
        return frame.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value IS NOT NULL")

    return values(left).intersect(values(right))


def leaked(rows: DataFrame, content: str, part: str) -> DataFrame:
    """(sha256, copies, parts) of contents that stand in more than one part."""
    out = rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.count_distinct(part).alias("parts"))
    return out.where("parts > 1")


def uncovered(source: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of the source not taken, and taken ones beyond the source; repeats count."""
    a, b = source.select(key), taken.select(key)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionAll(b.exceptAll(a).withColumn("side", F.lit("extra")))


def seed_of(text: Column, below: int | None = None) -> Column:
    """The first eight bytes of a SHA-256 as an unsigned number, modulo a bound if one is given."""
    value = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return value if below is None else (value % F.lit(str(below)).cast("decimal(20,0)")).cast("decimal(20,0)")


def stride(rows: DataFrame, order: str, world: int) -> DataFrame:
    """Adds the shard of each row by its place in order.

    Places come from totals of buckets of 4096 numbers, and those from totals of 4096 buckets each: a row of sixteen
    million numbers meets the others in one task.
    """
    buckets = rows.withColumn("_b", F.floor(F.col(order) / 4096))
    totals = buckets.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_c", F.floor(F.col("_b") / 4096))
    earlier = lambda n, window: F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = totals.groupBy("_c").agg(F.sum("_n").alias("_m")).select("_c", earlier("_m", Window.orderBy("_c")).alias("_first"))
    totals = totals.join(coarse, "_c").select("_b", (F.col("_first") + earlier("_n", Window.partitionBy("_c").orderBy("_b"))).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return buckets.join(totals, "_b").withColumn("shard", F.pmod(place, F.lit(world)).cast("int" if world < 1 << 31 else "long")).drop("_b", "_before")


def in_listed_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of a list of (position, key), and the position; a key that no row has stays away, see ``absent``."""
    return rows.join(ids, key)


def absent(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return ids.join(rows, key, "left_anti")


def successors(ids: DataFrame, hashes: tuple[str, ...] = ()) -> DataFrame:
    """For each of a stated list of (pos, id, scene): the next one in a circle that has another scene and other hashes.

    The list is held against itself, so it has MOST_LISTED rows at most. A null scene or hash differs from none.
    """
    n = ids.count()
    if n > MOST_LISTED:
        raise ValueError(f"a list of {n} ids is too long; {MOST_LISTED} are the most")
    a, b = (ids.select(F.col("pos").alias(f"{x}pos"), F.col("id").alias(f"{x}id"), *[F.col(c).alias(f"{x}{c}") for c in ("scene", *hashes)]) for x in "pq")
    jump = F.pmod(F.col("qpos") - F.col("ppos"), F.lit(n))
    other = jump > 0
    for c in ("scene", *hashes):
        other = other & (F.col(f"p{c}") != F.col(f"q{c}"))
    return a.join(F.broadcast(b), other).groupBy(F.col("pid").alias("id")).agg(F.min_by("qid", jump).alias("next_id"))


#: Rows and steps that the driver shuffles: some 100 MB.
MOST_SHUFFLED = 1_000_000


def epoch_order(n: int, steps: int, seed: int) -> Iterator[tuple[int, int, int]]:
    """(step, epoch, place) of rows dealt in shuffled epochs, each taken from its end; one Mersenne Twister runs through all.

    That order is one stream, so it is made on the driver: places, not rows.
    """
    rng, left, epoch = random.Random(seed), [], 0
    for step in range(1, steps + 1 if n else 1):
        if not left:
            left, epoch = list(range(n)), epoch + 1
            rng.shuffle(left)
        yield step, epoch, left.pop()


def in_epochs(rows: DataFrame, order: str, steps: int, seed: int) -> DataFrame:
    """(step, epoch, columns of rows) of ``epoch_order`` over the rows in order; for more, see ``in_keyed_epochs``."""
    n = rows.count()
    if max(n, steps) > MOST_SHUFFLED:
        raise ValueError(f"{MOST_SHUFFLED} rows and steps are the most that one stream of draws orders")
    places = rows.sparkSession.createDataFrame(list(epoch_order(n, steps, seed)), "step long, epoch long, shard long")
    return stride(rows, order, (1 << 31) - 1).withColumn("shard", F.col("shard").cast("long")).join(places, "shard").select("step", "epoch", *rows.columns)


#: Rounds of a permutation's network, and steps by which a place that isn't one of n is followed. A step misses with a
#: probability of some one in sqrt(n), and of a quarter for the smallest n, so WALKS never end early.
ROUNDS, WALKS = 6, 64


def permuted(place: Column, n: int, key: Column) -> Column:
    """The place of a number 0 <= place < n in a permutation of n that a key names.

    A Feistel network over pairs (x, y) of x < a and y < b, where a is the root of n and b is n / a, rounded up: each
    round adds to one half a digest of the other, which can be undone, so it permutes all pairs. Those that stand for no
    number below n are followed until they come back.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a) or 1

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        digest = F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.when(even, pair["y"]).otherwise(pair["x"]).cast("string")).cast("binary"))
        drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(F.when(even, F.pmod(pair["x"] + drawn, F.lit(a))).otherwise(pair["x"]).alias("x"), F.when(even, pair["y"]).otherwise(F.pmod(pair["y"] + drawn, F.lit(b))).alias("y"))

    def network(v: Column) -> Column:
        pair = F.struct(F.floor(v / F.lit(b)).cast("long").alias("x"), F.pmod(v, F.lit(b).cast("long")).alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, step, lambda p: p["x"] * F.lit(b).cast("long") + p["y"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(place.cast("long")), lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a permutation's walk did not end")).cast("long"))


def in_keyed_epochs(rows: DataFrame, order: str, steps: int, seed: int) -> DataFrame:
    """(step, epoch, columns of rows): rows dealt in epochs, each in a permutation of its own, up to so many steps.

    Every row's place is told by its number in order, the seed and the epoch alone, so nothing is shuffled to be ordered
    and the driver has a count. An epoch is a permutation of all rows; the last one may be cut. Without rows there are
    no steps.
    """
    n = rows.count()
    own = [f.name for f in rows.schema]
    places = stride(rows, order, 1 << 62)
    epochs = places.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-steps // max(n, 1)))))))
    at = permuted(F.col("shard"), n, F.concat_ws(":", F.lit(str(seed)), F.col("_epoch").cast("string")))
    dealt = epochs.withColumn("_step", (F.col("_epoch") - 1).cast("long") * F.lit(n) + at + 1)
    return dealt.where(F.col("_step") <= steps).select(F.col("_step").alias("step"), F.col("_epoch").cast("long").alias("epoch"), *own)


#: (train, validation), the first that candidates suffice for.
PLANS = ((512, 128), (256, 64))


def sizes_for(candidates: Column, plans: tuple[tuple[int, int], ...] = PLANS) -> Column:
    """struct(train, validation) of the first plan that the candidates suffice for; both null for too few."""
    train, validation = (F.coalesce(*[F.when(candidates >= p[0] + p[1], F.lit(p[i])) for p in plans]) for i in (0, 1))
    return F.struct(train.alias("train"), validation.alias("validation"))


def split_sizes(candidates: int, plans: tuple[tuple[int, int], ...] = PLANS) -> tuple[int, int]:
    """The first (train, validation) that the candidates suffice for."""
    for train, validation in plans:
        if candidates >= train + validation:
            return train, validation
    raise ValueError(f"{candidates} candidates are too few")


def allowed_only(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names, key, "left_semi")


def at_positions(annotations: DataFrame, rows: DataFrame, position: str, frozen: list[str]) -> DataFrame:
    """Annotations joined to rows by position, with ``same``: whether the frozen fields are equal on both sides."""
    renamed = rows.withColumnsRenamed({c: f"{c}_found" for c in frozen})
    same = F.lit(True)
    for c in frozen:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_found"))
    return annotations.join(renamed, position, "left").withColumn("same", same)


def repeating(rows: DataFrame, group: str, source: str) -> DataFrame:
    """Groups that select a source more than once."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(source).alias("d")).where("n <> d").select(group)


def matched(rows: DataFrame, sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows with ``state``: the name of the one side that has their key, both or neither. sides: name to (ids, key)."""
    (one, (a, key_a)), (two, (b, key_b)) = sides.items()
    rows = rows.join(a.select(key_a).distinct().withColumn("_one", F.lit(True)), key_a, "left").join(b.select(key_b).distinct().withColumn("_two", F.lit(True)), key_b, "left")
    state = F.when(F.col("_one") & F.col("_two"), "both").when(F.col("_one"), one).when(F.col("_two"), two).otherwise("neither")
    return rows.withColumn("state", state).drop("_one", "_two")


def first_few(rows: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The k smallest, to be shown in an error."""
    return rows.orderBy(order).limit(k)
