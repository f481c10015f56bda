"""Compare a query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0 if math.isfinite(value) else str(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def connect():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return out


def check(spark, query, sql):
    found = query(spark, FOLDER)
    names = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    answer = connect().sql(sql)
    assert sorted(answer.columns) == names
    want = sorted((tuple(plain(dict(zip(answer.columns, r, strict=True))[c]) for c in names) for r in answer.fetchall()), key=repr)
    assert got == want
