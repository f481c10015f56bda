import random
from bisect import bisect_left

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm import license_scan as L
from gradus.llm.shared import Numbers, words


def numbers(text, t):
    own = Numbers(t.vocabulary).of(words(text.encode()))
    return own[own >= 0]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 9), max_size=30), st.lists(st.integers(0, 9), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    found = L.align(np.array(a), np.array(b))
    assert all(a[i] == b[j] != 0 for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


@given(st.permutations(range(1, 25)))
def test_unique_words_align_by_the_longest_rising_run(order):
    """Without common ends, one level is the longest increasing subsequence."""
    a, b = [*range(1, 25), 90], [91, *order, 92]
    tops = []
    for x in order:
        at = bisect_left(tops, x)
        tops[at : at + 1] = [x]
    assert len(L.align(np.array([93, *a]), np.array(b))) == len(tops)


def plainly(a, b, p=0, r=0):
    """Patience alignment by its definition: common ends, then the longest rising run of common unique words, then gaps."""
    a, b, out = list(a), list(b), []
    while a and b and a[0] == b[0] != 0:
        out.append((p, r))
        a, b, p, r = a[1:], b[1:], p + 1, r + 1
    while a and b and a[-1] == b[-1] != 0:
        out.append((p + len(a) - 1, r + len(b) - 1))
        a, b = a[:-1], b[:-1]
    common = [j for j, w in enumerate(b) if w and b.count(w) == 1 and a.count(w) == 1]
    if not common:
        return sorted(out)
    at = [a.index(b[j]) for j in common]
    longest = []  # of the runs that end with each; its predecessor is the last before it whose run is one shorter
    for n, x in enumerate(at):
        longest.append(1 + max([longest[m] for m in range(n) if at[m] < x], default=0))
    n = max(m for m in range(len(at)) if longest[m] == max(longest))
    chain = [n]
    while longest[n] > 1:
        n = max(m for m in range(n) if longest[m] == longest[n] - 1)
        chain.append(n)
    i, j = 0, 0
    for n in reversed(chain):
        out += [(p + at[n], r + common[n]), *plainly(a[i : at[n]], b[j : common[n]], p + i, r + j)]
        i, j = at[n] + 1, common[n] + 1
    return sorted([*out, *plainly(a[i:], b[j:], p + i, r + j)])


@settings(deadline=None, max_examples=400)
@given(st.lists(st.integers(0, 25), max_size=40), st.lists(st.integers(0, 25), max_size=40))
def test_alignment_against_its_definition(a, b):
    assert L.align(np.array(a), np.array(b)) == plainly(a, b)


def test_coverage_does_not_depend_on_the_place():
    """Foreign words after each word, or some; the text begins at any word."""
    t = L.Templates(L.TEMPLATES)
    own = L.TEMPLATES["MIT"].split()
    for every in (1, 2, 3):
        wide = " ".join(f"{w} zzq" if i % every == 0 else w for i, w in enumerate(own))
        found = {L.scan(numbers(f"{'zzq ' * offset} {wide} {'zzq ' * 500}", t), t)[0][:2] for offset in (0, 1, 40, 81, 165, 170, 333, 1000)}
        assert len(found) == 1 and all(name == "MIT" and coverage > 0.97 for name, coverage in found), every


def test_every_template_is_found_in_noise():
    t, rng = L.Templates(L.TEMPLATES), random.Random(0)
    noise = lambda n: " ".join(rng.choice(["the", "of", "thand", "software", "erin", "and"]) for _ in range(n))
    for name, text in L.TEMPLATES.items():
        found = {r[0]: r for r in L.scan(numbers(f"{noise(300)} {text} {noise(200)} {text}", t), t)}
        assert found[name][1] == 1.0, name
        wrapped = text.replace(" ", "\n * ").upper() if len(text) < 60 else text.replace(", ", ",\n# ")
        assert any(r[0] == name for r in L.scan(numbers(wrapped, t), t)), name


def test_changed_text_has_its_coverage():
    t = L.Templates(L.TEMPLATES)
    cut = L.TEMPLATES["ISC"].split()
    changed = " ".join(w for i, w in enumerate(cut) if i % 10)
    found = {r[0]: r[1] for r in L.scan(numbers(changed, t), t)}
    assert 0.8 <= found["ISC"] < 0.95
    assert not L.scan(numbers(" ".join(sorted(cut)), t), t)


def test_query(spark):
    rows = [(1, "x Released under the MIT License. y"), (2, None), (3, ""), (1, "x Released under the MIT License. y"), (None, "Released under the Apache License."), (5, "thou " * 100_000 + L.TEMPLATES["MIT"])]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"], r["first_word"]) for r in L.licenses(frame).collect()), key=repr)
    assert got == [(1, "MIT notice", 1), (1, "MIT notice", 1), (5, "MIT", 100_000)]
    assert L.licenses(frame.limit(0)).count() == 0
