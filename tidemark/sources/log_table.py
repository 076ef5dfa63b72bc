"""A message log kept as files by topic and partition, whose bounds are in the files' own footers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.log import SLOT, log_bounds

SCHEMA = (
    "offset BIGINT, timestamp TIMESTAMP, key BINARY, value BINARY, topic STRING, partition INT"
)

#: Parquet through the reader that answers least and greatest values from footers.
_FOOTERS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what is read or written inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@dataclass(frozen=True)
class LogTable:
    """Messages under ``path``, in folders by topic and partition, in files sorted by offset."""

    spark: SparkSession
    path: str

    def append(self, messages: DataFrame) -> LogTable:
        """Add messages. Large partitions are cut by offset, so a file holds a stretch of one."""
        cut = messages.repartitionByRange(*SLOT, "offset").sortWithinPartitions(*SLOT, "offset")
        cut.write.mode("append").partitionBy(*SLOT).parquet(self.path)
        return self

    def _ends(self, topic: str | None) -> DataFrame:
        log = self.spark.read.schema(SCHEMA).parquet(self.path)
        one = log if topic is None else log.where(F.col("topic") == topic)
        ends = F.min("offset").alias("earliest"), F.max("offset").alias("last")
        return one.groupBy(*SLOT).agg(*ends)

    def bounds(self, topic: str | None = None) -> DataFrame:
        """Earliest offset and exclusive end per topic partition, from footers: no message is read.

        The settings that allow this are the session's for this one read. What it gives is a row per
        topic partition.
        """
        with settings(self.spark, _FOOTERS):
            rows = self._ends(topic).collect()
        found = self.spark.createDataFrame(
            rows, "topic STRING, partition INT, earliest BIGINT, last BIGINT"
        )
        return found.select(*SLOT, "earliest", (F.col("last") + 1).alias("high_water"))

    def messages(self, topic: str | None = None, ranges: Sequence[Row] = ()) -> DataFrame:
        """Messages of a topic. ``ranges`` (partition, start_offset, end_offset), one a partition,
        become conditions on folders and on offsets, so other files and row groups are skipped; the
        exact ranges are up to the caller."""
        log = self.spark.read.schema(SCHEMA).parquet(self.path)
        if topic is not None:
            log = log.where(F.col("topic") == topic)
        if ranges:
            log = log.where(F.col("partition").isin(sorted({r["partition"] for r in ranges})))
        return _near(log, ranges).select(*SLOT, "offset", "timestamp", "key", "value")


#: A log as files, or as any DataFrame of messages.
Log = LogTable | DataFrame


def _near(log: DataFrame, ranges: Sequence[Row]) -> DataFrame:
    """Messages between the least start and the greatest end of all ranges, as literals."""
    if not ranges:
        return log
    low = min(r["start_offset"] for r in ranges)
    high = max(r["end_offset"] for r in ranges)
    return log.where((F.col("offset") >= low) & (F.col("offset") < high))


def bounds_of(log: Log, topic: str) -> DataFrame:
    """A topic's bounds: from footers where the log is kept as files, else from its messages."""
    if isinstance(log, LogTable):
        return log.bounds(topic)
    return log_bounds(log.where(F.col("topic") == topic))


def records_of(log: Log, topic: str, ranges: Sequence[Row]) -> DataFrame:
    """A topic's messages near some ranges."""
    if isinstance(log, LogTable):
        return log.messages(topic, ranges)
    return _near(log.where(F.col("topic") == topic), ranges)
