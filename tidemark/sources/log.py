"""Bounded reads of a message log, and the ledger that says what has been read.

A log is any DataFrame with the Kafka source's columns: topic, partition, offset, timestamp, key,
value. Ranges are half open. The ledger, not the broker, is the record of progress.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.operators.latest import latest_per
from tidemark.operators.ordered import Sliced

SLOT = ["topic", "partition"]


class LedgerGap(Exception):
    """A claim does not start where the ledger ends."""


class OffsetsExpired(Exception):
    """A range starts before the oldest record the log still holds."""


def kafka_range(spark: SparkSession, servers: str, claims: DataFrame) -> DataFrame:
    """The same bounded read from a broker. Claims are one row per topic partition."""
    starting: dict[str, dict[str, int]] = {}
    ending: dict[str, dict[str, int]] = {}
    for claim in claims.collect():
        slot = str(claim["partition"])
        starting.setdefault(claim["topic"], {})[slot] = claim["start_offset"]
        ending.setdefault(claim["topic"], {})[slot] = claim["end_offset"]
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("assign", json.dumps({t: [int(p) for p in ps] for t, ps in starting.items()}))
        .option("startingOffsets", json.dumps(starting))
        .option("endingOffsets", json.dumps(ending))
        .option("failOnDataLoss", "true")
        .load()
        .select("topic", "partition", "offset", "timestamp", "key", "value")
    )


def read_range(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records with start <= offset < end of their topic partition.

    Ranges are one row per topic partition and claimed range. They often come as rows, whose size
    Spark does not know: without the hint it shuffles and sorts the whole log by its few partitions.
    """
    held = F.broadcast(ranges.select(*SLOT, "start_offset", "end_offset"))
    inside = (F.col("offset") >= F.col("start_offset")) & (F.col("offset") < F.col("end_offset"))
    return log.join(held, SLOT).where(inside).drop("start_offset", "end_offset")


def log_bounds(log: DataFrame) -> DataFrame:
    """Earliest offset and exclusive end per topic partition."""
    return log.groupBy(*SLOT).agg(
        F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("high_water")
    )


def latest_attempts(ledger: DataFrame) -> DataFrame:
    """The ledger as it stands: the last attempt of each entry."""
    return latest_per(ledger, ["ledger_id"], ["attempt"])


def watermarks(ledger: DataFrame) -> DataFrame:
    """Highest recorded end per topic partition."""
    return (
        ledger.groupBy("topic", F.col("partition_id").cast("int").alias("partition"))
        .agg(F.max("end_offset").alias("watermark"))
    )


def claim_ranges(bounds: DataFrame, ledger: DataFrame, max_records: int) -> DataFrame:
    """The next range of each topic partition, at most ``max_records`` long; none when caught up."""
    start = F.coalesce("watermark", "earliest")
    end = F.least(F.col("high_water"), start + F.lit(max_records).cast("bigint"))
    return (
        bounds.join(watermarks(ledger), SLOT, "left")
        .select(*SLOT, start.alias("start_offset"), end.alias("end_offset"))
        .where(F.col("end_offset") > F.col("start_offset"))
    )


def rerun_ranges(ledger: DataFrame, run_id: str) -> DataFrame:
    """What a run id has already recorded: its exact ranges and load date."""
    return latest_attempts(ledger.where(F.col("dag_run_id") == run_id)).select(
        "topic",
        F.col("partition_id").cast("int").alias("partition"),
        "start_offset",
        "end_offset",
        "loaded_date",
        "attempt",
    )


def run_ranges(
    bounds: DataFrame, ledger: DataFrame, run_id: str, max_records: int, ctx: Context
) -> DataFrame:
    """A run's ranges: recorded ones where the run has been here before, fresh claims elsewhere."""
    recorded = rerun_ranges(ledger, run_id)
    fresh = (
        claim_ranges(bounds, ledger, max_records)
        .join(recorded, SLOT, "left_anti")
        .withColumns({"loaded_date": F.lit(ctx.today), "attempt": F.lit(0)})
    )
    return recorded.unionByName(fresh)


def gaps_in_claims(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims that do not start exactly at the watermark."""
    return claims.join(watermarks(ledger), SLOT).where(
        F.col("start_offset") != F.col("watermark")
    )


def assert_contiguous(claims: DataFrame, ledger: DataFrame) -> None:
    broken = gaps_in_claims(claims, ledger).take(1)
    if broken:
        row = broken[0]
        raise LedgerGap(
            f"{row['topic']}/{row['partition']}: the claim starts at {row['start_offset']}, "
            f"the ledger ends at {row['watermark']}"
        )


def expired_ranges(claims: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ranges whose first records the log no longer holds."""
    return claims.join(bounds, SLOT).where(F.col("start_offset") < F.col("earliest"))


def assert_retained(claims: DataFrame, bounds: DataFrame) -> None:
    lost = expired_ranges(claims, bounds).take(1)
    if lost:
        row = lost[0]
        raise OffsetsExpired(
            f"{row['topic']}/{row['partition']}: offset {row['start_offset']} is gone, the log "
            f"starts at {row['earliest']}"
        )


def ledger_gaps(ledger: DataFrame) -> DataFrame:
    """Entries that do not begin where the entry before them in their topic partition ends."""
    entries = latest_attempts(ledger).withColumn(
        "_at", F.struct("start_offset", "end_offset", "ledger_id")
    )

    in_slices = Sliced.by_position(entries, ["topic", "partition_id"], "_at", "start_offset")
    found = in_slices.with_previous(["end_offset"], "_prior").where(
        F.col("_prior.end_offset") != F.col("start_offset")
    )
    return found.withColumn("previous_end", F.col("_prior.end_offset")).drop("_prior", "_at")
