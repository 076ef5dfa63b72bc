"""The load as a stream: the same parsing, splitting and commit, fed by Structured Streaming.

The stream's checkpoint records what has been read, and each micro-batch is one run of the load,
named by its number. A micro-batch that Spark repeats after a failure therefore finds its earlier
attempt in the ledger and replaces it, so that every record is visible once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.context import Context
from tidemark.sources.load import LoadTarget, Warehouse, land_and_commit
from tidemark.sources.log import SLOT, assert_contiguous, latest_attempts


#: A run's clock, or one for each micro-batch by its number.
Clock = Context | Callable[[int], Context]


def load_micro_batch(
    warehouse: Warehouse,
    batch: DataFrame,
    number: int,
    target: LoadTarget,
    stream_name: str,
    ctx: Context,
    erasure: DataFrame | None = None,
) -> None:
    """Land and commit one micro-batch under its own run id.

    The batch is read once: what it covers is taken from what has landed. A batch that does not
    begin where the ledger ends is refused before its commit, so a stream whose checkpoint and
    ledger disagree stops instead of leaving a gap or counting records twice.
    """
    run_id, spark = f"{stream_name}-{number}", warehouse.spark
    recorded = latest_attempts(warehouse.ledger().where(F.col("dag_run_id") == run_id)).select(
        "topic",
        F.col("partition_id").cast("int").alias("partition"),
        F.col("attempt").alias("_attempt"),
        F.col("loaded_date").alias("_first_date"),
    )
    earlier = spark.createDataFrame(recorded.collect(), recorded.schema)  # one per topic partition

    def placed(parsed: DataFrame) -> DataFrame:
        date = F.coalesce("_first_date", F.lit(ctx.today))
        return parsed.join(F.broadcast(earlier), SLOT, "left").withColumns({"_run": F.lit(run_id), "_date": date})

    def covered(landed: DataFrame) -> DataFrame | None:
        found = (
            landed.groupBy("topic", F.col("partition_id").cast("int").alias("partition"))
            .agg(
                F.min("kafka_offset").alias("start_offset"),
                (F.max("kafka_offset") + 1).alias("end_offset"),
            )
            .join(earlier, SLOT, "left")
            .select(
                *SLOT,
                "start_offset",
                "end_offset",
                F.coalesce("_first_date", F.lit(ctx.today)).alias("loaded_date"),
                F.coalesce("_attempt", F.lit(0)).alias("attempt"),
                F.lit(run_id).alias("run"),
            )
        )
        rows = found.collect()
        if not rows:
            return None
        ranges = spark.createDataFrame(rows, found.schema)
        assert_contiguous(ranges.where(F.col("attempt") == 0), warehouse.ledger())
        return ranges

    land_and_commit(warehouse, batch, placed, covered, target, ctx, erasure=erasure)


def stream_load(
    warehouse: Warehouse,
    log: DataFrame,
    target: LoadTarget,
    stream_name: str,
    checkpoint: str,
    ctx: Clock,
    erasure: DataFrame | None = None,
) -> StreamingQuery:
    """Load everything a streaming log has to offer, in bounded micro-batches, and stop.

    How much one micro-batch takes is set on the source: ``maxOffsetsPerTrigger`` for a broker,
    ``maxFilesPerTrigger`` for files.
    """

    def land(batch: DataFrame, number: int) -> None:
        own = ctx if isinstance(ctx, Context) else ctx(number)
        load_micro_batch(warehouse, batch, number, target, stream_name, own, erasure)

    return (
        log.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_events(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """A stream of events with copies dropped while they can still arrive.

    The streaming form of the first-arrival rule. State is kept for ``lateness`` only, and the
    number of copies is not known, which the batch model reports.
    """
    return events.withWatermark("kafka_ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
