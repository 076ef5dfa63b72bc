"""Erasure and retention over finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import Context

# Fixed value: days of raw data kept.
RAW_RETENTION_DAYS = 90


def purge_account(table: DataFrame, erasure: DataFrame) -> DataFrame:
    """A table without the rows of accounts that asked for erasure."""
    return table.join(erasure.select("account_id"), "account_id", "left_anti")


def purge_audit(tables: dict[str, DataFrame], erasure: DataFrame) -> DataFrame:
    """Rows each table holds of accounts that asked for erasure."""
    asked = erasure.select("account_id")
    counted = [
        table.join(asked, "account_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("rows_to_purge"))
        .select(F.lit(name).alias("table_name"), "rows_to_purge")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def within_retention(raw: DataFrame, ctx: Context, days: int = RAW_RETENTION_DAYS) -> DataFrame:
    """Rows young enough to keep, by the date the raw layer is partitioned on."""
    return raw.where(F.col("loaded_date") > F.date_sub(F.lit(ctx.today), days))
