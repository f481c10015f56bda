import os
import statistics

import pytest

from gradus.queries import QUERIES, SQL
from tests.oracle import FOLDER, check

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry_point_without_the_subpackage(tmp_path):
    """The entry point still imports where llm and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/gradus", tmp_path / "gradus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr


def test_sample_means_by_any_order_of_events(spark, tmp_path):
    """A sample whose tokens' mean is off by the slack itself is told alike, however its events are stored."""
    cents = [4849, 3542, 3225, 5240, 7045, 5343]
    values = [c / 100 / 500 for c in cents]
    sample, tokens = statistics.mean(values), statistics.mean(values[1:])
    assert abs(sample - tokens) > 1e-4
    rows = [(i, 1, "view", c / 100) for i, c in enumerate(cents)]
    for at, order in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(order, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{at}/events.parquet")
        got = [tuple(r) for r in QUERIES["agg31_sample_means"](spark, f"{tmp_path}/{at}").select("example_id", "condition", "raw_js", "token_mean").collect()]
        assert got == [("1", "view", round(sample, 9), round(tokens, 9))]
