"""Every image query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from prismalake.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(r[c] for c in names)) for r in table.to_pylist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.queries()[name](spark, SF).toArrow()) == rows(con.sql(SQL[name]).to_arrow_table())
