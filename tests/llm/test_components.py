import random

import pytest

from gradus.llm.components import components


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(-40, 0)] + [(100, 100 + i) for i in range(200)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
