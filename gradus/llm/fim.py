"""Fill-in-middle: documents cut into prefix, middle and suffix at two unit ranks, rearranged between sentinels, and put back.

A text is a rope: a balanced tree over leaves of some LEAF bytes, each ending where a unit ends, whose nodes cache their
units and code points. A cut by either rank walks one path of the tree and scans one leaf; a concatenation is one node
over two trees, so no text is copied until the leaves of the result are joined. The inverse finds the sentinels in the
leaves of the output's rope, and splits that by code points.

A unit is a word with the white space before it; white space at the end of a text is one more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, ready, tidy

#: Bytes after which a leaf ends with its next unit.
LEAF = 2048
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: The last byte of a word that white space follows: a unit's end that needs no look at what comes later.
BORDER = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class Leaf:
    __slots__ = ("points", "text", "units")

    def __init__(self, text: bytes, units: int, points: int):
        self.text, self.units, self.points = text, units, points

    def leaves(self) -> Iterator[Leaf]:
        yield self


class Node:
    __slots__ = ("left", "points", "right", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points

    def leaves(self) -> Iterator[Leaf]:
        waiting: list[Rope] = [self]
        while waiting:
            rope = waiting.pop()
            if isinstance(rope, Node):
                waiting += (rope.right, rope.left)
            else:
                yield rope


Rope = Leaf | Node
EMPTY = Leaf(b"", 0, 0)


def leaf(text: bytes) -> Leaf:
    """A leaf of whole units: as many as words, and one of white space at its end."""
    return Leaf(text, len(text.split()) + (text[-1:].isspace()), len(text.decode()))


def sentinel(text: bytes) -> Leaf:
    return Leaf(text, 0, len(text))


def concat(*ropes: Rope) -> Rope:
    out: Rope = EMPTY
    for rope in ropes:
        out = rope if out.points == 0 else out if rope.points == 0 else Node(out, rope)
    return out


def build(text: bytes) -> Rope:
    """A balanced rope of a text in UTF-8."""
    row: list[Rope] = []
    at = 0
    while at < len(text):
        border = BORDER.search(text, min(at + LEAF, len(text)) - 1)
        end = border.end() if border else len(text)
        row.append(leaf(text[at:end]))
        at = end
    while len(row) > 1:
        row = [Node(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def _at_unit(one: Leaf, rank: int) -> tuple[Rope, Rope]:
    end = next(islice(UNIT.finditer(one.text), rank - 1, None)).end()
    points = len(one.text[:end].decode())
    return Leaf(one.text[:end], rank, points), Leaf(one.text[end:], one.units - rank, one.points - points)


def _at_point(one: Leaf, rank: int) -> tuple[Rope, Rope]:
    text = one.text.decode()
    left, right = text[:rank].encode(), text[rank:].encode()
    return Leaf(left, len(left.split()), rank), Leaf(right, len(right.split()), one.points - rank)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What comes before a rank, counted in units or points, and what comes after it.

    Leaves that are cut within a unit, as only a rank of points can do, count words for units.
    """
    lefts, rights = [], []
    while isinstance(rope, Node):
        before = getattr(rope.left, by)
        if rank <= before:
            rights.append(rope.right)
            rope = rope.left
        else:
            lefts.append(rope.left)
            rope, rank = rope.right, rank - before
    if rank <= 0:
        one, two = EMPTY, rope
    elif rank >= getattr(rope, by):
        one, two = rope, EMPTY
    else:
        one, two = (_at_unit if by == "units" else _at_point)(rope, rank)
    for rope in reversed(lefts):
        one = concat(rope, one)
    for rope in reversed(rights):
        two = concat(two, rope)
    return one, two


def find(rope: Rope, mark: bytes) -> int | None:
    """Code points before the first place of a mark without white space, which no border between leaves can cut."""
    before = 0
    for one in rope.leaves():
        at = one.text.find(mark)
        if at >= 0:
            return before + len(one.text[:at].decode())
        before += one.points
    return None


def joined(rope: Rope) -> bytes:
    return b"".join(one.text for one in rope.leaves())


def rearrange(text: bytes, key: object, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix's points, middle's points, output) of one text."""
    tree = build(text)
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))
    if not text or h3 % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return tree.units, "plain", None, None, text
    first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, second - first)
    p, s, m = sentinel(PREFIX), sentinel(SUFFIX), sentinel(MIDDLE)
    form = "spm" if h4 % 100 < spm_below else "psm"
    out = concat(s, suffix, p, prefix, m, middle) if form == "spm" else concat(p, prefix, s, suffix, m, middle)
    return tree.units, form, prefix.points, middle.points, joined(out)


def restore(output: bytes, form: str) -> bytes | None:
    """The text whose output in a form this is; nothing where that lacks a sentinel, or the form is none of the three."""
    if form == "plain":
        return output
    order = {"spm": (SUFFIX, PREFIX, MIDDLE), "psm": (PREFIX, SUFFIX, MIDDLE)}.get(form)
    if order is None or not output.startswith(order[0]):
        return None
    _, rest = split(build(output), len(order[0]), "points")
    parts = {}
    for mark, following in zip(order, order[1:], strict=False):
        at = find(rest, following)
        if at is None:
            return None
        parts[mark], rest = split(rest, at, "points")
        _, rest = split(rest, len(following), "points")
    return joined(concat(parts[PREFIX], rest, parts[SUFFIX]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for each row of docs.

    Of a hundred documents some ``rate`` are rearranged, of these some ``spm`` as suffix, prefix, middle and the others
    as prefix, suffix, middle; which, and where they are cut, follows from the seed and the key alone. A null key counts
    as the word null. Null and empty texts, and those that hold a sentinel, stay plain: a null text is an empty one.
    Repeated rows stay and are rearranged alike; texts are read whole, whatever their length; other columns play no
    part; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary())
        for b in batches:
            found = [rearrange(raw or b"", one.as_py(), seed, rate, spm) for one, raw in zip(b.column("id"), as_bytes(b.column("text")), strict=True)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            columns[-1] = columns[-1].cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        tidy()

    out = rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", key)


def invert(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Rows of outputs and forms with their texts, rebuilt from these two alone, in a column of their own.

    A row whose output isn't of its form, or where one of both is null, has null. All columns and rows stay as they are.
    """
    ready(rows.sparkSession)
    names, kinds = [*rows.columns, restored], [f.dataType.simpleString() for f in rows.schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, outputs = b.column(names.index(form)).to_pylist(), as_bytes(b.column(names.index(output)))
            texts = [None if x is None or y is None else restore(x, y) for x, y in zip(outputs, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names)
        tidy()

    return rows.mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in zip(names, [*kinds, "string"], strict=True)))
