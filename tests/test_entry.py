"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from gabarit.operators import queries_data, queries_reference

FOLDER = "/root/testdata/sf0.001"
SQL = queries_data.SQL | queries_reference.SQL
QUERIES = queries_data.QUERIES | queries_reference.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def shown(x):
    import pandas as pd

    if x is None or x is pd.NA or x != x:
        return None
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{float(x):.6f}" if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" else str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted([tuple(shown(v) for v in r) for r in pdf.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for a, b in zip(rows(got), rows(want)):
        for x, y in zip(a, b):
            assert x == y or float(x) == pytest.approx(float(y), abs=2e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
