"""Each registered query of the library proper against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from lexispark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    assert table(got.columns, map(tuple, got.collect())) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["C6_discriminant", "C7_stacking", "C8_cross_validation", "C10_train_and_classify", "M2_concept_similarity", "C6_nearest_neighbours", "O4_important_features", "pipeline_saved_models"])
def test_rows_alone(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
