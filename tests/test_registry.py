"""Registered queries against their SQL on the smallest tables, where those are present."""

import os

import pytest

import __spark_entry__ as entry
from faultlens.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["a_15_log_groups", "a_16_runtime_groups", "r_e_err_empty_catch", "i_13_env_secret_committed", "j_3_changed_line_scope"]


def test_every_query_has_sql():
    catalog.load()
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    df = entry.queries()[name](spark, SF_DIR)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
