"""What a run is told from outside: its clock, its tolerances and its session settings.

No operator reads the wall clock. Everything time-dependent takes a ``Context``, so a run can be
repeated and a test can live in any year.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    # Hot join keys are split at run time, for outer, semi and anti joins on their left side too.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings results depend on. Safe to call any number of times."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, which the cluster names in spark.checkpoint.dir.

    Only where it is unset and there are no executors but the driver, as in tests, one is made for
    this session. A cluster must name its own: files in a local folder would be missed.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once however often it is read, and safe from
    lost executors. The table is scratch; it may be deleted once results have been read."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Context:
    """One run's clock and tolerances."""

    now: datetime
    lookback_days: int = 3
    full_refresh: bool = False
    spine_start: date = date(2025, 1, 1)
    spine_ahead_days: int = 30

    def __post_init__(self) -> None:
        if self.now.tzinfo is None:
            object.__setattr__(self, "now", self.now.replace(tzinfo=UTC))

    @property
    def today(self) -> date:
        return self.now.astimezone(UTC).date()

    @property
    def spine_end(self) -> date:
        return self.today + timedelta(days=self.spine_ahead_days)

    def with_(self, **changes) -> Context:
        return replace(self, **changes)
