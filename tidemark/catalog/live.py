"""Queries that run the streaming forms to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import inputs, logs
from tidemark.catalog.inputs import CTX, SQL_EVENTS
from tidemark.catalog.logs import SQL_EVENT_LOG
from tidemark.catalog.registry import query
from tidemark.context import shared_folder
from tidemark.sources.load import PRODUCT_EVENTS, Warehouse
from tidemark.streaming.ingest import distinct_events, stream_load


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )
    return inputs.with_number(inputs.in_utc(files))


def _parts(messages: DataFrame, parts: int = 3) -> list[DataFrame]:
    """A log in further and further stretches of all its partitions."""
    ends = messages.agg((F.max("offset") + 1).alias("n")).first()["n"]
    at, cuts = F.col("offset"), [k * ends // parts for k in range(parts + 1)]
    return [messages.where((at >= lo) & (at < hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    f"""WITH {SQL_EVENTS}, {SQL_EVENT_LOG}
SELECT partition AS partition_id, "offset" AS kafka_offset, event_uid AS event_id, account_id,
  event_type, event_time FROM ok_messages""",
    ts="event_time",
)
def streamed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event topic loaded as a stream that goes on as the log grows, a micro-batch for each of
    three stretches in as many files as tasks wrote, read back through the ledger."""
    folder = _folder(spark)
    warehouse = Warehouse(spark, f"{folder}/warehouse")
    messages = logs.event_log(spark, sf_dir)
    for part in _parts(messages):
        part.write.mode("append").parquet(f"{folder}/log")
        arrived = spark.readStream.schema(messages.schema).parquet(f"{folder}/log")
        stream_load(
            warehouse, arrived, PRODUCT_EVENTS, "events", f"{folder}/checkpoint", CTX
        ).awaitTermination()
    return warehouse.raw(PRODUCT_EVENTS).select(
        "partition_id", "kafka_offset", "event_id", "account_id", "event_type", "event_time"
    )


@query(f"WITH {SQL_EVENTS} SELECT DISTINCT event_id, event_type FROM raw_events")
def streamed_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received copies as a stream, each event kept once."""
    folder = _folder(spark)
    copies = inputs.as_received(_event_stream(spark, sf_dir))
    (
        distinct_events(copies)
        .select("event_id", "event_type")
        .writeStream.format("parquet")
        .option("path", f"{folder}/events")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{folder}/events").select(F.col("event_id"), F.col("event_type"))
