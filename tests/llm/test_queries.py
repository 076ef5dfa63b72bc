"""The registered queries against their SQL, and what the entry points offer."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tidemark.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS FROM read_parquet('{FOLDER}/{table}.parquet')")
    want = connection.execute(catalog.oracles()[name])
    columns = [c[0] for c in want.description]
    found = catalog.queries()[name](spark, FOLDER)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want.fetchall())


def test_every_operator_has_one_query():
    names = set(__spark_entry__.queries())
    for number in range(1, 14):
        assert len([n for n in names if n.startswith(f"op{number}_")]) == 1
    assert "pipeline" in names
