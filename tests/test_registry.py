"""A few registered queries compared with their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of
from workload.base import TABLES

SMALL = "/root/testdata/sf0.01"
COMPARED = ["cheapest_platform", "coverage_overview", "brand_cascade", "recommend_prices", "explode_products", "diff_stats"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_delta_summary_counts_items_once(spark):
    test_against_sql(spark, "delta_summary")
