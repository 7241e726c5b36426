"""The queries that have SQL against it, over the smallest tables."""

import os

import duckdb
import pytest

from lexispark.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER), c.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    left = sorted(str([r[k] for k in order]) for r in got.collect())
    right = sorted(str([dict(zip(want.columns, r))[k] for k in order]) for r in want.fetchall())
    assert left == right
