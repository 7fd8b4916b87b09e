"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: str(sorted(r.items()))
    assert sorted(rows, key=key) == sorted((dict(zip(names, r, strict=True)) for r in want.fetchall()), key=key)
