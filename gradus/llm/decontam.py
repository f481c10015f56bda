"""Find benchmark items in documents by greedy string tiling.

Every run of k words of an item is a seed, known by a Karp-Rabin hash. Rolling hashes of a document's words are looked
up among the seeds; hits on one diagonal join to maximal common runs. Tiling then marks the longest run that no tile
overlaps, again and again, cutting what a tile covers off the others, until none of k words is left. The share of an
item's words under tiles is its coverage, whatever the order in which a document has its parts.

The benchmark is the stated query set: it is read in blocks of bounded size, each of which is broadcast and held
against all documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Numbers, as_bytes, fresh, mix, plain_words, ready, stored, tidy, words

#: Words of the shortest tile; the least coverage of a leak; words of benchmark items in a block.
MIN_TILE, COVERAGE, BLOCK_WORDS = 5, 0.5, 1_000_000
#: Pairs of places that are listed at once; beyond, runs are sought by their lengths. Both ways mark the same tiles.
MOST_PAIRS = 1_000_000
#: An odd base of the rolling hashes.
BASE = 0x9E3779B97F4A7C15


def rolling(numbers: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k word numbers, modulo 2**64."""
    value = mix(numbers.astype(np.uint64))
    out = value[: len(value) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(BASE) + value[i : len(value) - k + 1 + i]
    return out


class Seeds:
    """Items as word numbers, and where each run of k words stands in them. An item may have several ids."""

    def __init__(self, items: list[tuple[list, str | None]], k: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.items = [], []
        for keys, text in items:
            if found := plain_words(text):
                self.ids.append(keys)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32))
        #: Items of under k words are sought whole.
        self.tables = []
        for size in sorted({min(k, len(x)) for x in self.items}):
            own = [(i, x) for i, x in enumerate(self.items) if min(k, len(x)) == size]
            hashes = np.concatenate([rolling(x, size) for _, x in own])
            item = np.concatenate([np.full(len(x) - size + 1, i) for i, x in own])
            at = np.concatenate([np.arange(len(x) - size + 1) for _, x in own])
            order = np.argsort(hashes, kind="stable")
            self.tables.append((size, hashes[order], item[order], at[order]))

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray] | tuple[int, int, None, None]]:
        """(k, item, places in item, places in numbers) of the seeds found, for each item that has any.

        Where an item and a text repeat a seed so often that their places make over MOST_PAIRS pairs, none are listed.
        """
        for size, hashes, item, at in self.tables:
            if len(numbers) < size:
                continue
            known = np.concatenate(([0], np.cumsum(numbers > 0)))
            start = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(start):
                continue
            rolled = rolling(numbers, size)[start]
            low, high = np.searchsorted(hashes, rolled), np.searchsorted(hashes, rolled, "right")
            some = high > low
            low, many, start, rolled = low[some], (high - low)[some], start[some], rolled[some]
            if not len(low):
                continue
            if many.sum() <= MOST_PAIRS:
                each = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                of, places, stands = item[each], at[each], np.repeat(start, many)
                for i in np.unique(of):
                    mine = of == i
                    yield size, int(i), places[mine], stands[mine]
                continue
            # Item by item: those that stand in a range of the table, told by its borders.
            border = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(border, np.unique(low), 1)
            np.add.at(border, np.unique(low + many), -1)
            for i in np.unique(item[np.cumsum(border)[:-1] > 0]):
                own = np.flatnonzero(item == i)
                first, last = np.searchsorted(hashes[own], rolled), np.searchsorted(hashes[own], rolled, "right")
                count = last - first
                if count.sum() > MOST_PAIRS:
                    yield size, int(i), None, None
                else:
                    each = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    yield size, int(i), at[own][each], np.repeat(start, count)


def repeating_tiles(item: np.ndarray, text: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """What ``tiles`` finds, in memory of the two lengths: again and again the longest run free in both, by its length.

    For each length that is tried, Karp-Rabin hashes of all free runs of one side are looked up among the other's.
    """
    item, text = item.copy(), text.copy()
    out: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[int, int] | None:
        """The first place in item, then in text, of a common run of n."""
        if n > min(len(item), len(text)):
            return None
        known = [np.concatenate(([0], np.cumsum(x > 0))) for x in (item, text)]
        free = [np.flatnonzero(x[n:] - x[:-n] == n) for x in known]
        a, b = (_whole(x, n)[f] for x, f in zip((item, text), free, strict=True))
        for i in free[0][np.isin(a, b)]:
            for j in free[1][b == _whole(item[i : i + n], n)[0]]:
                if np.array_equal(item[i : i + n], text[j : j + n]):
                    return int(i), int(j)
        return None

    most = min(len(item), len(text))
    while True:
        low, high, best = k - 1, most, None
        while low < high:
            n = (low + high + 1) // 2
            found = common(n)
            low, high, best = (n, high, found) if found else (low, n - 1, best)
        if best is None:
            return out
        i, j = best
        out.append((i, j, low))
        item[i : i + low], text[j : j + low], most = -1, -1, low


def _whole(numbers: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n modulo 2**64, from sums of prefixes: whatever n, in time of the length."""
    value = mix(numbers.astype(np.int64).astype(np.uint64))
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(value), BASE, np.uint64))))
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(value), pow(BASE, -1, 1 << 64), np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[:-1])))
    runs = total[n:] - total[:-n]
    return runs * back[: len(runs)]


def tiles(item: np.ndarray, text: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, words) from seed hits, longest first, then those that stand first."""
    order = np.lexsort((at, place - at))
    at, place = at[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 1))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    heap = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        i, j, n = int(at[a]), int(place[a]), int(at[b] - at[a]) + k
        if np.array_equal(item[i : i + n], text[j : j + n]):  # else a hash collided
            heap.append((-n, i, j))
    heapq.heapify(heap)
    in_item, in_text, out = np.zeros(len(item), bool), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [not in_item[i + x] and j + x not in in_text for x in range(-n)]
        if all(free):
            in_item[i : i - n] = True
            in_text.update(range(j, j - n))
            out.append((i, j, -n))
            continue
        x = 0
        while x < len(free):
            y = x
            while y < len(free) and free[y]:
                y += 1
            if y - x >= k:
                heapq.heappush(heap, (x - y, i + x, j + x))
            x = y + 1
    return out


def _leaks(seeds: Seeds, numbers: Numbers, text: bytes | None, least: float) -> list[tuple[object, int, int, int, int]]:
    """(item id, its words, those covered, tiles, words of the longest) for each item that the text leaks."""
    own = numbers.of(words(text))
    own = own[own >= 0]  # words of punctuation alone stand between no two words, as in items
    out = []
    for k, i, at, place in seeds.hits(own):
        found = repeating_tiles(seeds.items[i], own, k) if at is None else tiles(seeds.items[i], own, at, place, k)
        covered = sum(n for _, _, n in found)
        if found and covered >= least * len(seeds.items[i]):
            out += [(key, len(seeds.items[i]), covered, len(found), max(n for _, _, n in found)) for key in seeds.ids[i]]
    return out


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[list, str | None]]]:
    """The ids and text of each distinct text, in blocks of about ``most`` characters / 6 words; each is collected on its own.

    Texts are dealt by a hash, and one that many items repeat is one text. Ids are a benchmark's, and not a corpus's.
    """
    rows = benchmark.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.collect_list(F.struct(F.col(item).alias("id"))).alias("ids"))
    rows = stored(rows.select("ids", "text"), "items")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // (6 * most)))
    for n in range(count):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == n) if count > 1 else rows
        yield [([i["id"] for i in r["ids"]], r["text"]) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = MIN_TILE, least: float = COVERAGE) -> DataFrame:
    """(key, item, item_words, covered_words, coverage, tiles, longest_tile) of each document and item that it leaks.

    Words are compared in lower case (A-Z) and without ASCII punctuation at their ends. An item of under k words leaks
    as a whole; one without words never does. Null and empty texts leak nothing; repeated rows are each reported, and
    so are items that repeat a text. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kinds = dict(docs.dtypes)["id"], dict(benchmark.dtypes)[item]
    out = None
    for block in blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(Seeds(block, k))
        part = docs.mapInArrow(_finder(sent, least, docs.schema["id"].dataType, benchmark.schema[item].dataType), f"id {kinds[0]}, item {kinds[1]}, item_words int, covered_words int, coverage double, tiles int, longest_tile int")
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": key, "item": item})


def _finder(sent, least: float, id_kind, item_kind):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(id_kind), to_arrow_type(item_kind), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        numbers = Numbers(seeds.vocabulary)
        for b in batches:
            rows = []
            for key, text in zip(b.column("id"), as_bytes(b.column("text")), strict=True):
                rows += [(key.as_py(), i, n, covered, covered / n, count, longest) for i, n, covered, count, longest in _leaks(seeds, numbers, text, least)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["id", "item", "item_words", "covered_words", "coverage", "tiles", "longest_tile"])
        tidy()

    return work


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = MIN_TILE, least: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns; nothing of them is shuffled.

    Null and empty texts leak nothing and stay, as do repeated rows; texts of any length are read whole. Without items
    all documents stay, and without documents there are none. A column that is called like a helper's keeps its own.
    """
    spark = docs.sparkSession
    ready(spark)
    schema, own = docs.schema, fresh(docs, "_checked")
    for block in blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(Seeds(block, k))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            numbers = Numbers(seeds.vocabulary)
            for b in batches:
                stays = [not _leaks(seeds, numbers, t, least) for t in as_bytes(b.column(b.num_columns - 1))]
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(stays, pa.bool_()))
            tidy()

        docs = docs.withColumn(own, F.col(text)).mapInArrow(work, schema)
    return docs
