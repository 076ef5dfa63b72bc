"""Intermediate tables in the folder that all executors share, and other small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import shared_folder

# Text batches go to Python in small pieces, so that a worker's memory follows the size of a few
# thousand rows and not that of a partition.
BATCH_ROWS = "2000"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch for the operators that run numpy in tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text of ASCII alone takes the faster full lower-casing."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
