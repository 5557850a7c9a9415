"""Every named query against its DuckDB twin, on the tables of the driver's comparison."""

import math

import duckdb
import pytest

from kinloom.plans import catalog

SF = "/root/testdata/sf0.01"
#: Queries whose result is empty on these tables; others like them use rules under which it isn't.
NOTHING = {"block_skipped", "conflict_flags"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    data = got.collect()
    assert data or name in NOTHING
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())
