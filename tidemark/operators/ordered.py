"""Scans over the rows of keys in order, without one task holding a whole key.

A window over a key puts all its rows into one task. Here rows are cut into slices, and all that an
operator wants to know of a row's neighbours and of the rows so far is taken in one pass over each
slice. What crosses the edges of slices is summed up in one row per slice, worked out along these
few rows, and handed back to the slices. There is one plan for all sizes: nothing is counted first,
no key is treated apart, and the input is evaluated once, since it is written before it is cut.

Slices follow rows. A log position is one row, so slices by position are even by themselves. By
time they are not, so there rows are sorted by key and time into ranges of even size, and a slice is
what one range holds of a key, whether a key has one row a year or a billion on one day.

Where positions are sparse, a slice by position may hold one row, and handing over what crosses its edges
costs more than the scan. ``by_size`` therefore counts written rows by key and cuts keys with many only;
a key with few is one slice, which is handed nothing, and takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.context import kept

SLICE = "_slice"

#: Log positions per slice. A position is one row, so a slice has at most as many.
POSITIONS_PER_SLICE = 1_000_000

#: Rows of a key that one task takes whole.
ROWS_PER_KEY = 100_000


@dataclass(frozen=True)
class Sliced:
    """``rows`` with the slice each is in. Keys are not null, and ``order`` is unique in a key."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: str
    whole: bool = False

    @staticmethod
    def by_size(
        held: DataFrame,
        keys: Sequence[str],
        order: str,
        cut: Callable[[DataFrame, Sequence[str], str], Sliced],
    ) -> list[Sliced]:
        """Scans that have all rows between them: keys with few rows whole, and those with more, if there
        are any, as ``cut`` cuts them. ``held`` is read more than once and should have been written."""
        most = min(ROWS_PER_KEY, POSITIONS_PER_SLICE)
        counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        many = kept(counts.where(F.col("_rows") > most).select(*keys))
        if many.isEmpty():
            return [Sliced.of_whole_keys(held, keys, order)]
        few, rest = (held.join(F.broadcast(many), [*keys], how) for how in ("left_anti", "left_semi"))
        return [Sliced.of_whole_keys(few, keys, order), cut(rest, keys, order)]

    @staticmethod
    def of_whole_keys(df: DataFrame, keys: Sequence[str], order: str) -> Sliced:
        return Sliced(df.withColumn(SLICE, F.lit(0)), tuple(keys), order, True)

    @staticmethod
    def by_position(
        df: DataFrame, keys: Sequence[str], order: str, position: str | None = None
    ) -> Sliced:
        """Slices of a whole-number ``position``, which is or leads ``order``; nothing is written."""
        at = F.floor(F.col(position or order) / POSITIONS_PER_SLICE)
        return Sliced(df.withColumn(SLICE, at), tuple(keys), order)

    @staticmethod
    def by_range(df: DataFrame, keys: Sequence[str], order: str) -> Sliced:
        """Slices of ranges of rows, sorted by key and order. The ranges are drawn from the written
        rows, so drawing them does not evaluate ``df`` again."""
        held = kept(df)
        ranges = held.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
        return Sliced(kept(ranges.withColumn(SLICE, F.spark_partition_id())), tuple(keys), order)

    @property
    def group(self) -> list[str]:
        return [*self.keys] if self.whole else [*self.keys, SLICE]

    # ------------------------------------------------------------ within a slice

    def in_order(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.order)

    def so_far(self, current: bool = True) -> WindowSpec:
        """The rows of the slice up to a row, itself included or not."""
        last = Window.currentRow if current else -1
        return self.in_order().rowsBetween(Window.unboundedPreceding, last)

    def to_come(self) -> WindowSpec:
        """The rows of the slice after a row. They are walked backwards, so each is seen once."""
        backwards = Window.partitionBy(*self.group).orderBy(F.desc(self.order))
        return backwards.rowsBetween(Window.unboundedPreceding, -1)

    # ------------------------------------------------------------ from slice to slice

    def edges(self, rows: DataFrame, *sums: Column) -> DataFrame:
        """One row per slice. ``rows`` have passed this scan's windows, so it takes no shuffle."""
        return rows.groupBy(*self.keys, SLICE).agg(*sums)

    def slices(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def earlier(self) -> WindowSpec:
        return self.slices().rowsBetween(Window.unboundedPreceding, -1)

    def later(self) -> WindowSpec:
        """Later slices of the key, the nearest last."""
        backwards = Window.partitionBy(*self.keys).orderBy(F.desc(SLICE))
        return backwards.rowsBetween(Window.unboundedPreceding, -1)

    def handed(self, rows: DataFrame, edges: DataFrame, *carried: Column) -> DataFrame:
        """``rows`` beside what their slice is handed, which is nothing if it is a whole key."""
        handed = edges.select(*self.keys, SLICE, *carried)
        if self.whole:
            names = [f for f in handed.schema if f.name not in (*self.keys, SLICE)]
            return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in names})
        return rows.join(handed, self.group, "left")

    # ------------------------------------------------------------ whole scans

    def with_previous(self, columns: Sequence[str], name: str) -> DataFrame:
        """Rows with struct ``name`` of the preceding row's columns, null on a key's first row."""
        packed = F.struct(*columns)
        local = self.rows.withColumn(name, F.lag(packed).over(self.in_order()))
        edges = self.edges(local, F.max_by(packed, F.col(self.order)).alias("_last"))
        prior = F.lag("_last").over(self.slices()).alias("_carried")
        return (
            self.handed(local, edges, prior)
            .withColumn(name, F.coalesce(name, "_carried"))
            .drop("_carried", SLICE)
        )


def over_all(scans: Sequence[Sliced], scanned: Callable[[Sliced], DataFrame]) -> DataFrame:
    """What an operator makes of each scan, as one table."""
    return reduce(DataFrame.unionByName, map(scanned, scans))
