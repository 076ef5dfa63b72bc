"""Tables in folders by day, of which an incremental run rewrites only the days it touches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context, kept
from tidemark.functions import at
from tidemark.sources.files import delete, exists

DAY = "_day"


@dataclass(frozen=True)
class DayTable:
    """A table under ``path`` whose rows lie in the folder of the day of ``time``.

    ``keys`` identify a row, ``loaded`` is the instant it was loaded. Beside the days the table holds
    a row per build with the newest instant it has seen, so a run knows where to look back from
    without reading the table.
    """

    spark: SparkSession
    path: str
    time: str
    keys: tuple[str, ...]
    loaded: str = "loaded_at"

    @property
    def _builds(self) -> str:
        return f"{self.path}/_builds"

    def built(self) -> bool:
        return exists(self.spark, self._builds)

    def _days(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/_schema").schema
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._days().drop(DAY)

    def newest(self) -> int | None:
        """The newest ``loaded`` of all builds in microseconds, from the table's own record."""
        if not self.built():
            return None
        builds = self.spark.read.parquet(self._builds)
        return builds.agg(F.unix_micros(F.max("newest"))).first()[0]

    def _dated(self, df: DataFrame) -> DataFrame:
        return df.withColumn(DAY, F.to_date(self.time))

    def _write(self, rows: DataFrame, mode: str) -> None:
        (
            # A day is a file or a few: large days are split, small ones share a task.
            rows.hint("rebalance", DAY)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", mode)
            .partitionBy(DAY)
            .parquet(self.path)
        )

    def _record(self, seen: DataFrame, days: int | None, ctx: Context) -> None:
        """Note a build that is done: the newest instant it has seen, and how many days it wrote."""
        newest = seen.agg(F.max(self.loaded).alias("newest"))
        record = newest.select(
            at(ctx.now).alias("built_at"), "newest", F.lit(days).cast("int").alias("days")
        )
        record.write.mode("append").parquet(self._builds)

    def overwrite(self, df: DataFrame, ctx: Context) -> DataFrame:
        """A full build."""
        dated = self._dated(df)
        self._write(dated, "static")
        dated.limit(0).write.parquet(f"{self.path}/_schema")
        self._record(self._days(), None, ctx)
        return self.read()

    def touched(self, fresh: DataFrame) -> list[date | None]:
        """Days that rows of ``fresh`` (with their day) lie on, or replace rows of.

        A row may be replaced by one of another day. To find its day only keys and folder names are
        read, and nothing if the day is part of the key. The list has an entry per day at most.
        """
        own = fresh.select(DAY).distinct()
        if DAY not in self._key_days():
            held = self._days().select(*self.keys, DAY)
            replaced = held.join(fresh.select(*self.keys).distinct(), list(self.keys), "left_semi")
            own = own.union(replaced.select(DAY)).distinct()
        return [r[DAY] for r in own.collect()]

    def _key_days(self) -> tuple[str, ...]:
        return (DAY,) if self.time in self.keys else ()

    def replace(self, df: DataFrame, ctx: Context) -> DataFrame:
        """Put rows in place by key. Files of days that are not touched stay as they are.

        Days are swapped one after the other when all are written, so a run that dies in between
        leaves whole days, old or new. The newest instant is recorded last: the next run then looks
        back as far as this one did, and puts the same rows in place again.
        """
        fresh = kept(self._dated(df))
        days = self.touched(fresh)
        if not days:
            return self.read()
        replaced = fresh.select(*self.keys).distinct()
        stay = kept(
            self._days().where(_on_days(days)).join(replaced, list(self.keys), "left_anti")
        )
        self._write(stay.unionByName(fresh), "dynamic")
        # A day that has lost all its rows is not among those written.
        filled = {r[DAY] for r in stay.select(DAY).union(fresh.select(DAY)).distinct().collect()}
        for day in set(days) - filled:
            name = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
            delete(self.spark, f"{self.path}/{DAY}={name}")
        self._record(fresh, len(days), ctx)
        return self.read()


def _on_days(days: list[date | None]) -> Column:
    """A condition on the day as a list of literals, which prunes folders."""
    found = F.col(DAY).isin([d for d in days if d is not None])
    return found | F.col(DAY).isNull() if None in days else found
