import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import wordpiece as W


def greedy(word, vocabulary, prefix=b" "):
    """Longest pieces by trying all lengths that a piece has."""
    rest, start, count = prefix + word, True, 0
    longest = max(map(len, vocabulary), default=0)
    while rest:
        for n in range(min(len(rest), longest), 0, -1):
            piece = rest[:n]
            if piece in vocabulary and piece.startswith(prefix) == start:
                break
        else:
            return 1
        rest, start, count = rest[n:], False, count + 1
    return count


@settings(deadline=None, max_examples=400)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=25), st.sets(st.text("abc", max_size=5), max_size=15), st.text("abcd", max_size=20))
def test_against_greedy(inner, starts, word):
    vocabulary = {p.encode() for p in inner} | {b" " + p.encode() for p in starts}
    assert W.Automaton(vocabulary).count(word.encode()) == greedy(word.encode(), vocabulary)


@pytest.mark.skipif(not os.path.exists(W.VOCABULARY), reason="no vocabulary file")
def test_public_vocabulary(spark):
    vocabulary = set(W.pieces())
    automaton = W.Automaton(vocabulary)
    words = [b"the", b"unbelievably", "élévation".encode(), b"x" * 3000, b"\xff", b"Hello,world!"]
    assert [automaton.count(w) for w in words] == [greedy(w, vocabulary) for w in words]
    rows = [(1, "the end\tof  it"), (2, None), (3, ""), (1, "the end\tof  it"), (None, "é" * 50_000)]
    got = W.count_pieces(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_words int")).collect()
    want = [(k, len((t or "").encode().split()), sum(greedy(w, vocabulary) for w in (t or "").encode().split())) for k, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert W.count_pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
