"""Registered queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from marketlake.suite.oracle import SQL
from marketlake.suite.registry import QUERIES
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "contract_gate",
    "dq_flags",
    "scd2_merge",
    "fact_intraday",
    "obt_daily",
    "training_set",
    "psi",
    "asof_join",
    "gate_calendar",
    "skew_join",
    "json_parse",
    "zorder_cluster",
    "maintained_fact",
    "ingest_layers",
    "lineage_closure",
    "ops_run_log",
    "stream_fanout",
    "late_router",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    verdict, _ = compare(spark, duck, name, FOLDER)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pct_change_1d" in df.columns
