import hashlib
import math
import os
import random

import numpy as np
import pytest

from gradus.operators import paired as P
from gradus.queries import METRICS, QUERIES
from tests.oracle import FOLDER


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_twister_draws_are_those_of_randrange(n):
    values, rng = np.random.default_rng(n).normal(size=n), random.Random(2**63 + n)
    want = [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(1200)]
    assert P.twister_means(values, 1200, 2**63 + n) == pytest.approx(want, abs=1e-12)


def test_hashed_bootstrap_against_brute_force(spark):
    sizes = {"raw_js": 9, "visual_proxy": 5}
    rows = [("c", f"e{i}", m, "all_available", ((i * 7) % 10) / 8) for m, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "condition string, example_id string, metric string, scope string, delta double")
    got = {r["metric"]: (r["low"], r["high"]) for r in P.hashed_bootstrap(frame, 130, 3).collect()}
    for m, n in sizes.items():
        means = []
        for rep in range(130):
            weights = []
            for i in range(n):
                digest = hashlib.md5(f"3|{rep // 4}|e{i}".encode()).hexdigest()
                u = int(digest[rep % 4 * 8 : rep % 4 * 8 + 8], 16) / 2**32
                # A Poisson number of mean 1 by its distribution function.
                k, below = 0, math.exp(-1)
                while u >= below and k < 9:
                    k += 1
                    below += math.exp(-1) / math.factorial(k)
                weights.append(k)
            if sum(weights):
                means.append(sum(w * r[4] for w, r in zip(weights, [r for r in rows if r[2] == m], strict=True)) / sum(weights))
        assert got[m] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["agg29_exact_bootstrap", "agg29_hashed_bootstrap_5000"])
def test_every_metric_has_intervals(spark, name):
    found = QUERIES[name](spark, FOLDER).collect()
    assert {r["metric"] for r in found} == set(METRICS) and {r["scope"] for r in found} == {"all_available", "valid_to_valid"}
