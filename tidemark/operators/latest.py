"""First or last row per key.

Each of these plans as a rank-limited window: every map task keeps one row per key before the
shuffle, so a key that holds a third of the input still sends only one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row that comes first under ``order`` for each key; ``order`` should be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def latest_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_ties: bool = False
) -> DataFrame:
    """The row with the greatest ``order`` per key, or all of them where ties are kept."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rank = F.rank() if keep_ties else F.row_number()
    return df.withColumn(_RANK, rank.over(window)).where(F.col(_RANK) == 1).drop(_RANK)
