"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about equal size. Time is counted in slots of one block. Block j of
a source with weight w (a share of all slots) is released at slot ``floor((j - 1) / w)`` and due at
slot ``ceil(j / w)``; in every slot the released block with the earliest deadline goes next. With
weights that sum to one no deadline is missed, so a source is at every moment less than one block
ahead of or behind its share.

Releases and deadlines are whole numbers computed from the exact weights, so nothing drifts however
long the schedule is. The driver holds a number per block and a name per source, and sorts blocks
only: slots of sources that have run out are stepped over, not listed. Blocks come from running sums
in two steps, so no task holds a source.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Slots whose rows are summed together when positions are numbered.
PERIOD = 1000
#: Blocks due beyond this slot have none, and their rows follow behind the schedule.
LAST_SLOT = 1 << 61
BLOCK_CHARS = 1 << 20
#: Rows of a source that one running sum orders, about.
CHUNK_ROWS = 20_000
NO_SOURCE = ""


def parts_of(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of the period, one at least, by largest remainders."""
    positive = {k: w for k, w in weights.items() if w > 0}
    if len(positive) > period:
        raise ValueError(f"{len(positive)} sources need a period of as many slots, not {period}")
    if not positive:
        return {}
    total = sum(positive.values())
    spare = period - len(positive)
    exact = {k: w / total * spare for k, w in positive.items()}
    parts = {k: 1 + int(x) for k, x in exact.items()}
    by_rest = sorted(positive, key=lambda k: (int(exact[k]) - exact[k], k))
    for k in by_rest[: period - sum(parts.values())]:
        parts[k] += 1
    return parts


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights above zero as whole numbers in exactly the same proportions, by name."""
    ratios = {k: w.as_integer_ratio() for k, w in sorted(weights.items()) if w > 0}
    common = lcm(*{below for _, below in ratios.values()})
    return {k: above * (common // below) for k, (above, below) in ratios.items()}


def timetable(weights: Mapping[str, int], counts: Mapping[str, int]) -> dict[str, np.ndarray]:
    """The slots of the first ``counts`` blocks of each source, earliest deadline first.

    Of two blocks due at the same slot the one whose source comes first in ``weights`` goes first.
    """
    total = sum(weights.values())
    names, parts = list(weights), list(weights.values())
    slots = [np.full(counts[k], -1, np.int64) for k in names]
    later = [(0, k) for k in range(len(names)) if len(slots[k])]
    done = [0] * len(names)
    ready: list[tuple[int, int]] = []
    slot = 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            k = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // parts[k]), k))
        due, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError(f"block {done[k]} of {names[k]} misses its deadline {due}")
        if due > LAST_SLOT:
            continue
        slots[k][done[k]] = slot
        done[k] += 1
        slot += 1
        if done[k] < len(slots[k]):
            heapq.heappush(later, (done[k] * total // parts[k], k))
    return dict(zip(names, slots, strict=True))


def schedule(parts: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, its block within the period) for each slot of one period, earliest deadline first."""
    found = timetable(dict(sorted(parts.items())), parts)
    return [(k, j) for _, k, j in sorted((t, k, j) for k in parts for j, t in enumerate(found[k].tolist()))]


def _running(df: DataFrame, group: str, order: list[str], size: str, chunks: int, name: str):
    """Adds the sum of ``size`` over the rows of ``group`` before this one, in two steps.

    ``order[0]`` is a hash of 32 bits; its value range is cut into ``chunks`` parts.
    """
    width = -(-(1 << 32) // chunks)
    placed = df.withColumn("_chunk", F.floor(F.col(order[0]) / width))
    before = (Window.unboundedPreceding, -1)
    sums = placed.groupBy(group, "_chunk").agg(F.sum(size).alias("_sum"))
    over_chunks = Window.partitionBy(group).orderBy("_chunk").rowsBetween(*before)
    offsets = sums.select(
        group, "_chunk", F.coalesce(F.sum("_sum").over(over_chunks), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(*before)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(offsets, [group, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_chunk", "_inside", "_offset")
    )


def _slot_table(df: DataFrame, slots: Mapping[str, np.ndarray]) -> DataFrame:
    """One row per block that has a slot."""
    sizes = [len(x) for x in slots.values()]
    place = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    names = pa.array(list(slots), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    flat = np.concatenate(list(slots.values()))
    table = pa.table({"_source": names, "_place": pa.array(place), "slot": pa.array(flat)})
    return df.sparkSession.createDataFrame(table).where("slot >= 0")


def default_weights(sizes: Mapping[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Sizes to a power below one: large sources keep more than small ones, but not in proportion."""
    return {k: max(n, 0) ** exponent for k, n in sizes.items()}


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, source, block, slot, position,
    on_target.

    A source's rows are taken in order of a hash of id and text, and its characters (one more per
    row) are cut into blocks; a row is in the block where it begins. ``slot`` is the block's place in
    the schedule and ``position`` the row's place in the mixture, 0 to n - 1. No row is left out:
    when a source has run out, its slots stay empty and the others go on in their proportions.
    ``on_target`` is true before the first source runs out, while the weights hold.

    Without ``weights`` a source's weight is the square root of its size. Sources that are not in
    ``weights``, or have no weight, follow behind the schedule, and so do blocks due beyond slot
    2 ** 61. Null counts as the source "". Any number of sources is placed. ``period`` slots are
    summed together when positions are numbered. Null ids and texts and repeated rows are placed
    like any other (rows equal in id and text in any order); an empty table gives no rows.
    """
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.col(text_col))))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            *keep,
            F.coalesce(source_col, F.lit(NO_SOURCE)).alias("source"),
            (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("draw"),
            key.alias("key"),
        )
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    listed = totals.select("source", "size").toArrow()
    found = dict(zip(listed["source"].to_pylist(), listed["size"].to_pylist(), strict=True))
    exact = whole(default_weights(found) if weights is None else weights)
    n_rows = totals.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, n_rows // CHUNK_ROWS)
    order = ["draw", "key", "row"]
    slim = rows.select("row", "source", "size", "draw", "key")
    begun = _running(slim, "source", order, "size", chunks, "begin")
    blocks = begun.withColumn("block", F.floor(F.col("begin") / block_chars)).drop("begin")
    # One block more than a source can have: from its slot on the source has run out.
    slots = timetable(exact, {k: -(-found.get(k, 0) // block_chars) + 1 for k in exact})
    if slots:
        in_slots = blocks.join(
            _slot_table(docs, slots),
            (F.col("source") == F.col("_source")) & (F.col("block") == F.col("_place")),
            "left",
        )
    else:
        in_slots = blocks.withColumn("slot", F.lit(None).cast("long"))
    placed = written(in_slots.select("row", "source", "block", "slot", "draw", "key"))
    # A source runs out with its last block; from the slot its next one would have, weights fail.
    used = placed.where("slot IS NOT NULL").groupBy("source").agg(F.max("block").alias("last"))
    horizon = _horizon(used, slots)
    found = _positions(placed, period).withColumn(
        "on_target", F.coalesce(F.col("slot") < F.lit(horizon), F.lit(False))
    )
    return rows.select("row", "doc_id", *keep).join(found, "row").drop("row")


def _horizon(used: DataFrame, slots: Mapping[str, np.ndarray]) -> int:
    """The first slot whose block does not exist. At most one row per source of the schedule."""
    ends = used.toArrow()
    last = dict(zip(ends["source"].to_pylist(), ends["last"].to_pylist(), strict=True))
    nexts = (int(of[last.get(k, -1) + 1]) for k, of in slots.items())
    return min((slot for slot in nexts if slot >= 0), default=LAST_SLOT if slots else 0)


def _positions(placed: DataFrame, period: int) -> DataFrame:
    """Numbers rows by slot, then by source and draw: sums per slot, per period, over all."""
    behind = F.lit((1 << 62) - 1)
    bucket = F.coalesce(F.col("slot"), behind)
    # Rows behind the schedule, and many small rows in one block, are spread by source and draw.
    spread = placed.withColumns(
        {
            "_bucket": bucket,
            "_wide": F.floor(bucket / period),
            "_part": F.when(F.col("slot").isNull(), F.shiftright("draw", 16)).otherwise(F.lit(0)),
        }
    )
    cell = ["_wide", "_bucket", "source", "_part"]
    per_cell = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.unboundedPreceding, -1)
    per_wide = per_cell.groupBy("_wide").agg(F.sum("n").alias("n"))
    wide = per_wide.select(
        "_wide",
        F.coalesce(
            F.sum("n").over(Window.orderBy("_wide").rowsBetween(*before)), F.lit(0)
        ).alias("_start"),
    )
    in_wide = Window.partitionBy("_wide").orderBy("_bucket", "source", "_part").rowsBetween(*before)
    starts = (
        per_cell.withColumn("_before", F.coalesce(F.sum("n").over(in_wide), F.lit(0)))
        .join(wide, "_wide")
        .select(*cell, (F.col("_start") + F.col("_before")).alias("_first"))
    )
    in_cell = Window.partitionBy(*cell).orderBy("draw", "key", "row")
    return (
        spread.withColumn("_nth", F.row_number().over(in_cell) - 1)
        .join(starts, cell)
        .select(
            "row",
            "source",
            "block",
            "slot",
            (F.col("_first") + F.col("_nth")).alias("position"),
        )
    )


def deviation(placed: Column, share: Column, slots: Column) -> Column:
    """Blocks of a source beyond its share after so many slots; within -1 and 1 by construction."""
    return placed - share * slots
