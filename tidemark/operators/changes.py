"""The change log: one stream out of many, redeliveries dropped, current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import first_per, latest_per


def changes_of(cdc_changes: DataFrame, source_table: str) -> DataFrame:
    """One source table's changes as delivered. The state of a delete is its before image."""
    return cdc_changes.where(F.col("source_table") == source_table).select(
        "pk",
        "op",
        "is_snapshot",
        "source_lsn",
        "source_ts",
        "effective_at",
        "loaded_at",
        "kafka_offset",
        "source_path",
        F.coalesce("after", "before").alias("row_state"),
        "before",
    )


def each_commit_once(changes: DataFrame) -> DataFrame:
    """A log position names one committed change, so two rows of a key sharing one are a redelivery;
    the first loaded is kept. Rows are sorted and shuffled here: they should be narrow by now."""
    return first_per(changes, ["pk", "source_lsn"], ["loaded_at", "kafka_offset"]).drop(
        "kafka_offset"
    )


def cdc_stream(cdc_changes: DataFrame, source_table: str) -> DataFrame:
    """One source table's changes, each commit once, with their images as text."""
    return each_commit_once(changes_of(cdc_changes, source_table))


def current_rows(changes: DataFrame, key: str) -> DataFrame:
    """The latest change per key by log position, deleted keys left out."""
    return latest_per(changes, [key], ["source_lsn"]).where(F.col("op") != "d")
