"""Every registered query against DuckDB at the smallest and the middle size."""

import os

import duckdb
import pytest

from stratalog import catalogue

SIZES = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names)))), names


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, size, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{size}/{t}.parquet'")
    got = rows(catalogue.queries()[name](spark, size).toArrow())
    want = rows(con.execute(catalogue.oracle_sql()[name]).to_arrow_table())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_all_have_rows(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SIZES[0]).count() > 0, name
