"""Incremental runs: what to read again, and how to put the result back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, newest: int | None, days: int, column: str = "loaded_at") -> DataFrame:
    """Rows loaded within ``days`` of an instant in microseconds; all rows if there is none.

    The predicate is a literal: every file of a load holds one ``loaded_at``, and parquet footers
    then skip all older loads. The load date is no substitute, since a rerun keeps the date of its
    first attempt.
    """
    if newest is None:
        return df
    floor = newest - days * 86_400_000_000
    return df.where(F.col(column) >= F.timestamp_micros(F.lit(floor).cast("bigint")))


def lookback(
    df: DataFrame, built: DataFrame, days: int, column: str = "loaded_at", built_column=None
) -> DataFrame:
    """Rows loaded within ``days`` of the newest row already built; all rows if nothing is.

    The newest instant is read first, one row. A table that records it needs no such read: see
    ``since``.
    """
    newest = built.agg(F.unix_micros(F.max(built_column or column))).first()[0]
    return since(df, newest, days, column)


def affected_keys(new_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys touched by new rows; a null key touches nothing."""
    return new_rows.select(*keys).na.drop(subset=list(keys)).distinct()


def replace_by_key(built: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the keys present in ``fresh`` from what was built, then insert ``fresh``."""
    kept = built.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
