import hashlib
import random
import re

import pytest

from gradus.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    """By slices of the list of units."""
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\t\n ", "a", " a", "a ", "a<P", "<", "S> <", "x <M> y", "<P>", "   x", "ab\x85cd", "\x1c\x1d", "é" * 5000, " " * 5000, "x" * 9000 + " " + "y" * 9000, "w " * 30_000]
    for _ in range(300):
        out.append("".join(rng.choice(["a", "é", "漢", "😀", " ", "\n", "\r\n", "\x0b", " ", "<", ">", "P", "word ", "S>"]) for _ in range(rng.choice([3, 20, 400, 6000]))))
    return out


def test_against_slices_and_back(spark):
    rows = [(i if i % 7 else None, t, "x", "y") for i, t in enumerate(texts())] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string, form string").repartition(3)
    found = fim.invert(fim.transform(frame)).collect()
    want = sorted(((k, *brute(k, t), t or "") for k, t, _, _ in rows), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert all(type(r["n"]) is int for r in found)


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_trees_of_small_leaves(monkeypatch, leaf):
    """Caches hold at every node, and any cut is the cut of the list of units, or of the string."""
    monkeypatch.setattr(fim, "LEAF", leaf)
    for text in texts()[1:80]:
        units, tree = UNIT.findall(text), fim.build(text.encode())
        assert (tree.units, tree.points) == (len(units), len(text))
        for rank in {0, min(1, len(units)), len(units) // 3, max(0, len(units) - 1), len(units)}:
            one, two = fim.split(tree, rank)
            assert (fim.joined(one).decode(), fim.joined(two).decode()) == ("".join(units[:rank]), "".join(units[rank:]))
            assert (one.units, two.units, one.points + two.points) == (rank, len(units) - rank, len(text))
        for rank in {0, len(text) // 2, len(text)}:
            one, two = fim.split(tree, rank, "points")
            assert (fim.joined(one).decode(), fim.joined(two).decode()) == (text[:rank], text[rank:])


def test_a_cut_walks_one_path(monkeypatch):
    """Of a text of a million words two leaves at most are scanned, and the tree is as deep as its leaves' logarithm."""
    tree, scanned = fim.build(b"word " * 1_000_000), []

    class Unit:
        def finditer(self, text):
            scanned.append(len(text))
            return UNIT.__class__.finditer(fim_unit, text)

    fim_unit = fim.UNIT
    monkeypatch.setattr(fim, "UNIT", Unit())
    deep, at = 0, tree
    while isinstance(at, fim.Node):
        deep, at = deep + 1, at.left
    fim.split(tree, 500_001)
    assert deep <= 13 and sum(scanned) <= 2 * (fim.LEAF + 5)


def test_outputs_that_are_none(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("a<P>", "psm"), (None, "spm"), ("x", None), ("x", "other"), ("x", "plain"), ("<S>c<P>a<M>b", "spm"), ("", "spm")]
    found = fim.invert(spark.createDataFrame(rows, "output string, form string")).collect()
    assert [r["restored"] for r in found] == ["acb", None, None, None, None, None, "x", "abc", None]


def test_empty_table(spark):
    assert fim.invert(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
