import os

import pytest

from gabarit.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() > 0
    if name in queries.SQL:
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(FOLDER):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
        assert {tuple(r) for r in df.collect()} == set(c.execute(queries.SQL[name]).fetchall())
