"""Collects the named queries, and puts results into a form any client compares alike."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.context import configure

MODULES = ("loading", "staging", "core", "marts", "checks", "drift", "activation", "ops", "live")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None, ts: str = "", days: str = ""):
    """Register the decorated function under its own name.

    ``ts`` and ``days`` name the SQL's timestamp and date columns, which are shown as text on both
    sides: clients differ in how they render them, and an open interval's end fits not all of them.
    """

    def register(function: Callable[[SparkSession, str], DataFrame]):
        name = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(function(configure(spark), sf_dir))

        shown = [f"CAST({c} AS VARCHAR) AS {c}" for c in (*ts.split(), *days.split())]
        text = sql
        if sql is not None and shown:
            text = f"SELECT * REPLACE ({', '.join(shown)}) FROM (\n{sql}\n) AS shown"
        if name in _ENTRIES:
            raise ValueError(f"two queries are called {name}")
        _ENTRIES[name] = Entry(run, text)
        return function

    return register


def portable(df: DataFrame) -> DataFrame:
    """Timestamps, dates and nested values as text, decimals as doubles."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType | T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            column = F.to_json(column)
        shown.append(column.alias(field.name))
    return df.select(*shown)


def _load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"tidemark.catalog.{module}")
    return _ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in _load().items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in _load().items() if entry.sql is not None}
