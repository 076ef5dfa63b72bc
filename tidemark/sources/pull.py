"""Pulls beside the streams: source snapshots and the provider's own event list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.functions import at
from tidemark.operators.latest import first_per

# What a snapshot photographs, how far a pull reaches back, snapshots kept.
SNAPSHOT_COLUMNS = {
    "subscriptions": (
        "id",
        "account_id",
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        "started_at",
        "ended_at",
    ),
    "accounts": ("id", "company_name", "country"),
}
PULL_OVERLAP = timedelta(hours=48)
SNAPSHOTS_KEPT = 7


def take_snapshot(
    tables: dict[str, DataFrame],
    ctx: Context,
    columns: dict[str, Sequence[str]] = SNAPSHOT_COLUMNS,
) -> DataFrame:
    """Current source rows as (instant, table, key, row), nulls written out."""
    shots = [
        tables[name].select(
            at(ctx.now).alias("snapshot_at"),
            F.lit(name).alias("source_table"),
            F.col("id").cast("string").alias("pk"),
            F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("row_data"),
        )
        for name, kept in columns.items()
        if name in tables
    ]
    taken = shots[0]
    for shot in shots[1:]:
        taken = taken.unionByName(shot)
    return taken


def prune_snapshots(snapshots: DataFrame, keep: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Rows of the newest ``keep`` instants, counted over all tables together."""
    kept = (
        snapshots.select("snapshot_at").distinct().orderBy(F.desc("snapshot_at")).limit(keep)
    )
    return snapshots.join(kept, "snapshot_at", "left_semi")


def pull_window(
    offered: DataFrame, state: DataFrame, ctx: Context, overlap: timedelta = PULL_OVERLAP
) -> DataFrame:
    """Offered events from the cursor minus the overlap on; from now minus it on a first pull."""
    cursor = state.agg(F.unix_micros(F.max("last_created_at"))).first()[0]
    reach = F.expr(f"interval {int(overlap.total_seconds())} seconds")
    if cursor is None:
        floor = at(ctx.now) - reach
    else:
        floor = F.timestamp_micros(F.lit(cursor).cast("bigint")) - reach
    return offered.where(F.col("provider_created_at") >= floor)


def new_events(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Batch rows whose provider id is not held yet, the first fetched of each id."""
    once = first_per(batch, ["provider_event_id"], ["fetch_order"])
    return once.join(held.select("provider_event_id"), "provider_event_id", "left_anti")


def merge_new_events(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Held rows untouched, new ones added."""
    return held.unionByName(new_events(batch, held).drop("fetch_order"))


def advance_cursor(batch: DataFrame, state: DataFrame, ctx: Context) -> DataFrame:
    """The state row after a pull: the newest event, the first fetched among equals.

    The cursor moves only to strictly newer events, so an equal one already held stays.
    """
    candidates = state.select(
        F.col("last_created_at").alias("created"),
        F.lit(-1).cast("bigint").alias("fetched"),
        F.col("last_event_id").alias("id"),
    ).where(F.col("created").isNotNull()).unionByName(
        batch.select(
            F.col("provider_created_at").alias("created"),
            F.col("fetch_order").cast("bigint").alias("fetched"),
            F.col("provider_event_id").alias("id"),
        )
    )
    newest = candidates.agg(
        F.max(F.struct("created", (-F.col("fetched")).alias("early"), "id")).alias("newest")
    )
    return newest.select(
        F.col("newest.created").alias("last_created_at"),
        F.col("newest.id").alias("last_event_id"),
        at(ctx.now).alias("last_pull_at"),
    )


def pull_report(batch: DataFrame, held: DataFrame) -> DataFrame:
    """How many events were fetched, how many of them were new, and how many known."""
    inserted = new_events(batch, held).agg(F.count(F.lit(1)).alias("inserted"))
    return (
        batch.agg(F.count(F.lit(1)).alias("fetched"))
        .withColumn("inserted", inserted.scalar())
        .withColumn("duplicates_skipped", F.col("fetched") - F.col("inserted"))
    )
