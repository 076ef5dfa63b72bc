"""Removal of repeated line runs by a suffix array over line ids, built by prefix doubling.

The corpus is one sequence of line ids per document. Suffixes (a line and all that follow it in its
document) are sorted by their first line, then by the first two, four, eight lines and so on: two
suffixes that agree on ``h`` lines are ordered by the ranks of the suffixes ``h`` lines on. A rank is
a pair, the id of the first line and the number of suffixes with that first line that sort before.

* A line that occurs once makes every suffix from it unique; such lines are only looked at as the
  end of a run. So the sort is over repeated lines and the line after each run of them.
* Suffixes that agree on ``h`` lines are neighbours in the array, an interval of common prefix ``h``
  or more. All but the interval's first suffix in corpus order begin a later copy of a run of ``h``
  lines. What the intervals of all depths cover, put together, are the maximal repeated runs.
* Groups of one suffix are finished and leave the sort with the rank they have. Rounds end when no
  other is left, after as many doublings as the longest repeated run has.

A line repeated very often is one large group. Its suffixes are counted by their second rank before
anything is ordered, and the order is summed up in two steps, over blocks of ids and then within
them, so no task holds the group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Second ranks are summed up in blocks by the leading bits of their line ids first.
BLOCK_BITS = 16
_SPACE = " \t\x0b\x0c\r"
_LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Depth:
    """Suffixes (row, pos) of ``lines`` lines or more whose first ``lines`` occur earlier too."""

    lines: int
    later: DataFrame


def _earlier_counts(groups: DataFrame) -> DataFrame:
    """Adds ``before``: suffixes of the same (first, sub) with a smaller second rank.

    ``groups`` has one row per (first, sub, second_first, second_sub) with its ``size``.
    """
    placed = groups.withColumn("block", F.shiftright("second_first", 64 - BLOCK_BITS))
    key = ["first", "sub"]
    earlier = (Window.unboundedPreceding, -1)
    per_block = placed.groupBy(*key, "block").agg(F.sum("size").alias("total"))
    blocks = Window.partitionBy(*key).orderBy("block").rowsBetween(*earlier)
    offsets = per_block.select(
        *key, "block", F.coalesce(F.sum("total").over(blocks), F.lit(0)).alias("offset")
    )
    in_block = Window.partitionBy(*key, "block").orderBy("second_first", "second_sub")
    inside = F.coalesce(F.sum("size").over(in_block.rowsBetween(*earlier)), F.lit(0))
    return (
        placed.withColumn("inside", inside)
        .join(offsets, [*key, "block"])
        .withColumn("before", F.col("offset") + F.col("inside"))
        .drop("block", "inside", "offset")
    )


def _depth(ranked: DataFrame, lines: int) -> Depth:
    """The intervals of one depth are groups of equal rank; each one's first suffix stays."""
    whole = ranked.where(F.col("left") >= lines)
    place = F.struct("doc", "row", "pos")
    firsts = whole.groupBy("first", "sub").agg(F.min(place).alias("at"))
    later = whole.join(firsts, ["first", "sub"]).where(place != F.col("at"))
    return Depth(lines, written(later.select("row", "pos")))


def suffix_depths(sequence: DataFrame) -> list[Depth]:
    """Depths 1, 2, 4, ... of the suffix array of ``sequence`` (row, doc, pos, left, id).

    ``doc`` orders the rows, ``pos`` counts a row's lines from 0, ``left`` is the number of lines
    from here to the row's end, and ``id`` is spread evenly over the longs.
    """
    counts = sequence.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    again = counts.where(F.col("n") > 1).select("id", F.lit(True).alias("again"))
    in_row = Window.partitionBy("row").orderBy("pos")
    # Repeated lines, and the line after each run of them, where what is shared ends.
    ranks = written(
        sequence.join(again, "id", "left")
        .withColumn("again", F.coalesce("again", F.lit(False)))
        .withColumn("after", F.lag("again", 1, False).over(in_row))
        .where(F.col("again") | F.col("after"))
        .select(
            "row", "doc", "pos", "left", "again", F.col("id").alias("first"),
            F.lit(0).cast("long").alias("sub"),
        )
    )
    live = ranks.where("again").drop("again")
    ranks = ranks.select("row", "pos", "first", "sub")
    depths, lines = [], 1
    while True:
        depths.append(_depth(live, lines))
        ahead = ranks.select(
            "row",
            (F.col("pos") - lines).alias("pos"),
            F.col("first").alias("second_first"),
            F.col("sub").alias("second_sub"),
        )
        # Where a document ends its suffix sorts before those that go on.
        paired = written(
            live.join(ahead, ["row", "pos"], "left").withColumns(
                {
                    "second_first": F.coalesce("second_first", F.lit(_LOWEST)),
                    "second_sub": F.coalesce("second_sub", F.lit(-1)),
                }
            )
        )
        key = ["first", "sub", "second_first", "second_sub"]
        groups = paired.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        placed = written(
            paired.join(_earlier_counts(groups), key).select(
                "row", "doc", "pos", "left", "first",
                (F.col("sub") + F.col("before")).alias("sub"), "size",
            )
        )
        live = placed.where((F.col("size") > 1) & (F.col("left") > lines)).drop("size")
        if live.isEmpty():
            return depths
        moved = placed.where(F.col("sub") > 0).select("row", "pos", F.col("sub").alias("now"))
        ranks = written(
            ranks.join(moved, ["row", "pos"], "left").select(
                "row", "pos", "first", F.coalesce("now", "sub").alias("sub")
            )
        )
        lines *= 2


def _lines(text: Column, min_words: int) -> Column:
    """Lines with a word: place, id, and whether the line has ``min_words`` words."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(_SPACE)).alias("line")),
    )
    return F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["at"].alias("at"),
            F.xxhash64(x["line"]).alias("id"),
            (F.size(F.split(x["line"], r"[\x20\x09-\x0D]+")) >= min_words).alias("long_line"),
        ),
    )


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = 2,
    min_words: int = 8,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns of ``keep``, n_lines, drops, shared_lines.

    ``drops`` has the numbers, from 0, of the lines in later copies of repeated runs. A run counts if
    it has ``min_lines`` lines (a power of two) or is one line of ``min_words`` words. The first
    copy, in order of id and then of place, stays; null ids come last. ``shared_lines`` is the
    largest power of two for which that many lines in a row occur earlier too, 0 if none does.

    Lines are compared by a 64-bit hash, without white space at their ends. Lines without a word are
    passed over: they neither count nor break a run. Null text has no lines. Repeated rows are copies
    like any other, in an order of their own; an empty table gives no rows.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    held = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            *keep,
            F.size(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n_lines"),
            _lines(F.col(text_col), min_words).alias("lines"),
        )
    )
    last = F.lit((1 << 63) - 1)
    sequence = held.select(
        "row",
        F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"),
        F.size("lines").alias("n"),
        F.posexplode("lines").alias("pos", "line"),
    ).select("row", "doc", "pos", (F.col("n") - F.col("pos")).alias("left"), "line.*")
    depths = suffix_depths(sequence.drop("at", "long_line"))
    marks = None
    for depth in depths:
        # Deeper intervals lie within these, so these cover all runs that are long enough.
        reach = depth.lines if depth.lines == min_lines else 1
        covered = depth.later.select(
            "row",
            F.explode(F.sequence(F.col("pos"), F.col("pos") + reach - 1)).alias("pos"),
            F.lit(depth.lines).alias("depth"),
            F.lit(depth.lines == min_lines).alias("in_run"),
        )
        marks = covered if marks is None else marks.unionByName(covered)
    drops = (
        marks.groupBy("row", "pos")
        .agg(F.max("depth").alias("depth"), F.max("in_run").alias("in_run"))
        .join(sequence.select("row", "pos", "at", "long_line"), ["row", "pos"])
        .groupBy("row")
        .agg(
            F.max("depth").alias("depth"),
            F.sort_array(
                F.collect_list(F.when(F.col("in_run") | F.col("long_line"), F.col("at")))
            ).alias("found"),
        )
    )
    return (
        held.drop("lines")
        .join(drops, "row", "left")
        .select(
            "doc_id",
            *keep,
            "n_lines",
            F.coalesce("found", F.array().cast("array<int>")).alias("drops"),
            F.coalesce("depth", F.lit(0)).alias("shared_lines"),
        )
    )


def kept_text(text: Column, drops: Column) -> Column:
    """``text`` without the lines numbered in ``drops``."""
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda line, at: ~F.array_contains(drops, at))
    return F.when(F.size(drops) == 0, text).otherwise(F.array_join(left, "\n"))
