"""Every registered query with an oracle equals DuckDB on sf0.001; the rest run."""

from decimal import Decimal

import duckdb
import pytest

from pelagia import catalog_of_queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return str(int(v)) if isinstance(v, Decimal) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(base.queries()))
def test_query_equals_oracle(spark, con, name):
    found = base.queries()[name](spark, SF)
    if name not in base.oracle_sql():
        assert found.collect() is not None
        return
    # through Arrow: pandas would turn a nullable integer into a float
    got, want = found.toArrow(), con.sql(base.oracle_sql()[name]).to_arrow_table()
    assert set(got.column_names) == set(want.column_names)
    columns = sorted(got.column_names)
    rows = lambda t: sorted(tuple(plain(r[c]) for c in columns) for r in t.to_pylist())
    assert rows(got) == rows(want)
