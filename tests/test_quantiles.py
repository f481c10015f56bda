import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import paired as P
from gradus.operators import quantiles as Q

WANTED = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0}


@pytest.mark.parametrize(("few", "bins"), [(4096, 4096), (5, 3)])
def test_against_sorted_values(spark, monkeypatch, few, bins):
    """Groups of one value, of ties, of a wide spread, and of a null key; nulls don't count."""
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    rng = random.Random(2)
    groups = {"ties": [1.0] * 40 + [2.0] * 9, "wide": [rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for _ in range(60)], "one": [3.5], None: [rng.random() for _ in range(30)], "two": [1.0, 2.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("ties", None), ("none", None)]
    got = {r["g"]: r for r in Q.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", WANTED).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, q in WANTED.items():
            assert got[k][name] == pytest.approx(np.quantile(values, q), rel=1e-9), (k, name)


def test_without_keys_or_rows(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert Q.quantiles(rows, [], "v", {"m": 0.25}).first()["m"] == 2.5
    assert Q.quantiles(rows.limit(0), [], "v", {"m": 0.25}).count() == 0
    assert Q.beside(rows.limit(0).agg(F.count("*").alias("n")), Q.quantiles(rows.limit(0), [], "v", {"m": 0.5}), []).first().asDict() == {"n": 0, "m": None}


def test_bootstrap_interval(spark):
    """Near that of plain resampling."""
    rng = np.random.default_rng(1)
    values = rng.normal(0.3, 1.0, 400)
    rows = spark.createDataFrame([("c", f"e{i}", "m", "all", float(v)) for i, v in enumerate(values)], "condition string, example_id string, metric string, scope string, delta double")
    got = P.hashed_bootstrap(rows, 2000, 5).first()
    means = [rng.choice(values, len(values)).mean() for _ in range(2000)]
    assert got["low"] == pytest.approx(np.quantile(means, 0.025), abs=0.02) and got["high"] == pytest.approx(np.quantile(means, 0.975), abs=0.02)
