"""Count word pieces with a linear longest-match automaton.

The vocabulary's pieces form one trie with two roots: pieces that start a word, and pieces that go on with it. A node's
failure link leads to where matching goes on once the longest pieces of its text are cut off, and its pops say how many
pieces that were; both are precomputed. Reading a word then takes one step for each byte and one for each piece, never
goes back, and counts without building a piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import REMEMBERED, as_bytes, ready

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """Byte pieces of a rank file: one in base64 and its rank on each line. A word starts with a space."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Nodes by number: 0 starts a word, 1 goes on with it. A word is its bytes after the prefix."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" "):
        self.prefix = prefix
        self.steps: list[dict[int, int]] = [{}, {}]
        whole = set()
        for piece in vocabulary:
            starts = piece.startswith(prefix)
            if not piece:
                continue
            node = 0 if starts else 1
            for byte in piece:
                if byte not in self.steps[node]:
                    self.steps[node][byte] = len(self.steps)
                    self.steps.append({})
                node = self.steps[node][byte]
            whole.add(node)
        n = len(self.steps)
        self.link, self.pops = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in self.steps[parent].items():
                queue.append(node)
                if node in whole:
                    self.link[node], self.pops[node] = 1, 1
                    continue
                at, count = self.link[parent], self.pops[parent]
                while at >= 0 and byte not in self.steps[at]:
                    count += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.steps[at][byte], count

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; a word that pieces don't cover is one unknown piece."""
        steps, link, pops = self.steps, self.link, self.pops
        node = total = 0
        for byte in self.prefix + word:
            while (to := steps[node].get(byte)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node != 1:
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class Counts(dict):
    """Pieces of words, remembered; memory is bounded."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.automaton.count(word)
        return value


#: A worker's automaton of the vocabulary that it counted with last: building one takes longer than many a task.
_kept: dict[bytes, Counts] = {}


def _counter(digest: bytes, vocabulary: list[bytes]) -> Counts:
    if digest not in _kept:
        _kept.clear()
        _kept[digest] = Counts(Automaton(vocabulary))
    return _kept[digest]


def count_pieces(docs: DataFrame, vocabulary: list[bytes] | None = None, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_words, n_pieces) for each row: words between ASCII white space, and their greedy longest pieces.

    Null and empty texts have none; texts and words may be of any length; repeated rows are all kept; extra columns play
    no part; an empty table gives no rows. The vocabulary, by default that of the file at ``path``, is bounded by its
    file and broadcast.
    """
    spark = docs.sparkSession
    ready(spark)
    vocabulary = pieces(path) if vocabulary is None else vocabulary
    digest = hashlib.sha256(b"".join(b"%d:%s" % (len(p), p) for p in vocabulary)).digest()
    sent = spark.sparkContext.broadcast(vocabulary)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(digest, sent.value)
        for b in batches:
            n, total = [], []
            for raw in as_bytes(b.column("text")):
                found = raw.split() if raw else []
                n.append(len(found))
                total.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["id", "n_words", "n_pieces"])

    return docs.mapInArrow(work, f"id {dict(docs.dtypes)['id']}, n_words long, n_pieces long").withColumnRenamed("id", key)
