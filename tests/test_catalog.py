"""Registered queries against their SQL in DuckDB.

All of them with TIDEMARK_ALL=1, otherwise one or two per part of the library.
"""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
FEW = (
    "claimed_ranges",
    "parsed_product_events",
    "stg_product_events",
    "dim_subscription",
    "mart_revenue_mrr",
    "stg_billing_reconciliation",
    "scd2_reconciliation",
    "drift_findings",
)
NAMES = sorted(catalog.queries()) if os.environ.get("TIDEMARK_ALL") else FEW


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')"
        )
    return connection


def shown(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    result = __spark_entry__.queries()[name](spark, FOLDER)
    expected = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(result.columns)
    want = sorted(tuple(shown(v) for v in row) for row in expected.fetchall())
    got = sorted(tuple(shown(row[c]) for c in columns) for row in result.collect())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
