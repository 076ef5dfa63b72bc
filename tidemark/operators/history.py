"""Validity intervals: building them from changes, reading them at an instant, laying them on days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.context import kept
from tidemark.functions import END_OF_TIME, changed
from tidemark.operators.latest import latest_per
from tidemark.operators.ordered import SLICE, Sliced, over_all

#: Tasks that lay stretches on days, for each core.
TASKS_PER_CORE = 8


def scd2(
    changes: DataFrame,
    key: str,
    order_col: str,
    time_col: str,
    tracked: Sequence[str],
) -> DataFrame:
    """Type-2 versions from a change log, ordered by log position and dated by business time.

    A change opens a version when it creates or snapshots the row or alters a tracked column, as
    compared with the change just before it. A version ends where the next *boundary* begins, so
    the end is looked up among boundaries only: a change that alters nothing must not cut the
    interval it falls into. Deletes end a version and open none.

    Both come from one pass over a key's changes, or over slices of the log where a key has many. Of a
    slice only its first change depends on earlier ones for being a boundary, so a slice hands on its
    last values and its first boundary.
    """
    scans = Sliced.by_size(kept(changes), [key], order_col, Sliced.by_position)
    return over_all(scans, lambda scan: _versions(scan, time_col, tracked))


def _versions(scan: Sliced, time_col: str, tracked: Sequence[str]) -> DataFrame:
    order_col = scan.order
    values, event = F.struct(*tracked), F.struct(time_col, "op")

    def opens(row: str, before: str) -> Column:
        """Whether a change, with columns under ``row``, is a boundary after values ``before``."""
        found = F.col(f"{row}op").isin("d", "c", "r")
        for column in tracked:
            found = found | changed(f"{row}{column}", f"{before}.{column}")
        return found

    local = scan.rows.withColumn("_before", F.lag(values).over(scan.in_order()))
    sure = F.col("_before").isNotNull() & opens("", "_before")
    edges = scan.edges(
        local,
        F.max_by(values, F.col(order_col)).alias("_last"),
        F.min_by(F.struct(*tracked, time_col, "op"), F.col(order_col)).alias("_first"),
        F.min_by(event, F.when(sure, F.col(order_col))).alias("_sure"),
    ).withColumn("_prior", F.lag("_last").over(scan.slices()))
    begins = F.when(opens("_first.", "_prior"), F.struct(f"_first.{time_col}", "_first.op"))
    edges = edges.withColumn("_begins", begins.otherwise(F.col("_sure")))
    later = F.last("_begins", ignorenulls=True).over(scan.later()).alias("_later")
    boundaries = (
        scan.handed(local, edges, F.col("_prior"), later)
        .withColumn("_before", F.coalesce("_before", "_prior"))
        .where(opens("", "_before"))
    )
    following = F.coalesce(F.lead(event).over(scan.in_order()), F.col("_later"))
    versions = boundaries.withColumn("_next", following).where(F.col("op") != "d")
    return versions.withColumns(
        {
            "valid_from": F.col(time_col),
            "valid_to": F.coalesce(f"_next.{time_col}", END_OF_TIME()),
            "is_current": F.col("_next.op").isNull(),
            "ended_by_delete": F.coalesce(F.col("_next.op") == "d", F.lit(False)),
        }
    ).drop("_before", "_prior", "_later", "_next", SLICE)


def as_of(versions: DataFrame, instant: Column) -> DataFrame:
    """Versions whose half-open interval covers one instant."""
    return versions.where((instant >= F.col("valid_from")) & (instant < F.col("valid_to")))


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    ts_col: str,
    order_col: str,
    columns: Sequence[str],
) -> DataFrame:
    """Each fact with ``columns`` of the version of its key that covers the fact's own time.

    A version covers from its start until before its end; of several the one with the latest start,
    then ``order_col``, counts. Versions that end where they start or earlier cover nothing. A fact
    that no version covers gets nulls.

    Versions and facts are laid on one time line per key, and one pass carries the latest start so
    far forwards and the next start backwards. If that version still holds, it is the answer. If it
    has ended, the answer can only be a version that outlives the start of a later one; business
    time must have run backwards for there to be any, so these few are joined by range with the
    facts that are still open.
    """
    described = F.struct("valid_from", order_col, "valid_to", *columns)
    lasting = versions.where(F.col(key).isNotNull() & (F.col("valid_to") > F.col("valid_from")))
    rank = F.struct("at", "side", "rank")
    line = (
        lasting.select(
            F.col(key).alias("_key"),
            F.col("valid_from").alias("at"),
            F.lit(0).alias("side"),
            F.col(order_col).cast("long").alias("rank"),
            described.alias("_version"),
        )
        .unionByName(
            facts.select(
                F.col(key).alias("_key"),
                F.col(ts_col).alias("at"),
                F.lit(1).alias("side"),
                F.monotonically_increasing_id().alias("rank"),
                F.struct(*facts.columns).alias("_fact"),
            ),
            allowMissingColumns=True,
        )
        .withColumn("_at", rank)
    )
    scan = Sliced.by_range(line, ["_key"], "_at")
    start = F.when(F.col("side") == 0, F.col("at"))
    local = scan.rows.withColumns(
        {
            "_covering": F.max("_version").over(scan.so_far()),
            "_next": F.min(start).over(scan.to_come()),
        }
    )
    edges = scan.edges(
        scan.rows,
        F.max("_version").alias("_own"),
        F.min(start).alias("_start"),
    )
    carried = scan.handed(
        local,
        edges,
        F.max("_own").over(scan.earlier()).alias("_earlier"),
        F.min("_start").over(scan.later()).alias("_later"),
    )
    scanned = kept(
        carried.select(
            "_key",
            "at",
            "side",
            "_version",
            "_fact",
            F.greatest("_covering", "_earlier").alias("_covering"),
            F.least("_next", "_later").alias("_next"),
        )
    )
    matched = scanned.where(F.col("side") == 1).drop("_version", "_next", "side")
    ended = F.col("at") >= F.col("_covering.valid_to")
    still_open = matched.where(ended).select(F.col("_key").alias("_k"), F.col("at").alias("_t"))
    late = scanned.where(F.col("_version.valid_to") > F.col("_next")).select(
        F.col("_key").alias("_v"), "_version"
    )
    earlier = (
        still_open.distinct()
        .join(
            late,
            (F.col("_k") == F.col("_v"))
            & (F.col("_t") >= F.col("_version.valid_from"))
            & (F.col("_t") < F.col("_version.valid_to")),
        )
        .groupBy("_k", "_t")
        .agg(F.max("_version").alias("_outlived"))
    )
    settled = matched.join(
        earlier, (F.col("_key") == F.col("_k")) & (F.col("at") == F.col("_t")), "left"
    ).withColumn(
        "_found",
        F.when(F.col("at") < F.col("_covering.valid_to"), F.col("_covering")).otherwise(
            F.col("_outlived")
        ),
    )
    return settled.select("_fact.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def _clamped_days(from_col: str, to_col: str, start: date, end: date) -> tuple[Column, Column]:
    """First and last day a version owns: days on or after its start and before its end."""
    first = F.greatest(F.to_date(from_col), F.lit(start))
    last = F.least(F.date_sub(F.to_date(to_col), 1), F.lit(end))
    return first, last


def split_by_overlap(
    versions: DataFrame, key: str, order_col: str
) -> tuple[DataFrame, DataFrame]:
    """Versions of keys that hold one state a day, and those of keys that may hold several, which
    needs business time to run backwards.

    A key is told by one pass: a version that starts before an earlier one ends, in its slice or, by
    the least start of the slice, before it.
    """
    held = kept(versions)
    scans = Sliced.by_size(held, [key], order_col, Sliced.by_position)
    clashing = kept(over_all(scans, _clashing).distinct())
    return held.join(clashing, key, "left_anti"), held.join(clashing, key, "left_semi")


def _clashing(scan: Sliced) -> DataFrame:
    start, end = F.to_date("valid_from"), F.to_date("valid_to")
    local = scan.rows.withColumn("_ends", F.max(end).over(scan.so_far(current=False)))
    within = local.where(F.col("_ends") > start).select(*scan.keys)
    if scan.whole:
        return within
    edges = scan.edges(
        scan.rows, F.min(start).alias("_start"), F.max(end).alias("_end")
    ).withColumn("_ended", F.max("_end").over(scan.earlier()))
    return within.unionByName(edges.where(F.col("_ended") > F.col("_start")).select(*scan.keys))


def _with_days(versions: DataFrame, spine_start: date, spine_end: date) -> DataFrame:
    """Versions that own a day of the spine, with their first and last."""
    first, last = _clamped_days("valid_from", "valid_to", spine_start, spine_end)
    owned = versions.withColumns({"first_day": first, "last_day": last})
    return owned.where(F.col("last_day") >= F.col("first_day"))


def _each_day(first: Column | str, last: Column | str) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def _each_day_as_text(first: str, last: str, spine_start: date, spine_end: date) -> Column:
    """The same days as a cast shows them, but taken from the spine's, which are put into words once."""
    count = (spine_end - spine_start).days + 1
    spine = ",".join((spine_start + timedelta(days=i)).isoformat() for i in range(count))
    return F.explode(
        F.slice(
            F.split(F.lit(spine), ","),
            F.datediff(first, F.lit(spine_start)) + 1,
            F.datediff(last, first) + 1,
        )
    )


def won_stretches(
    versions: DataFrame, key: str, order_col: str, spine_start: date, spine_end: date
) -> DataFrame:
    """Versions that may share days, with the days on which they count: on each day the one with the
    latest start, then log position.

    A version counts from its start until it ends or the next one starts. What it has left after that
    start counts only where all later versions so far have ended before yet another starts. Only these
    open days, and what versions have left, are laid out, so that rows do not grow with days that
    need no comparison.
    """
    rank = F.struct("valid_from", order_col)
    owned = kept(_with_days(versions, spine_start, spine_end).withColumn("_rank", rank))
    scans = Sliced.by_size(owned, [key], "_rank", Sliced.by_range)
    scanned = kept(over_all(scans, _next_and_reach))
    before_next = F.date_sub("_next", 1)
    first_open = F.date_add("last_day", 1)
    # least() passes over a null, which is what no next start should do.
    sure = scanned.withColumn("last_day", F.least("last_day", before_next))
    open_days = (
        scanned.where(F.col("_reach") > F.col("last_day"))
        .select(key, first_open.alias("_from"), F.least("_reach", before_next).alias("_until"))
        .where(F.col("_until") >= F.col("_from"))
        .select(key, _each_day("_from", "_until").alias("first_day"))
    )
    # Open days are many more than the rows they come from, by whose size Spark would broadcast them.
    left_over = (
        scanned.where(F.col("last_day") >= F.col("_next"))
        .withColumn("first_day", _each_day("_next", "last_day"))
        .join(open_days.hint("merge"), [key, "first_day"], "left_semi")
    )
    single = latest_per(left_over, [key, "first_day"], ["valid_from", order_col])
    return (
        sure.where(F.col("last_day") >= F.col("first_day"))
        .unionByName(single.withColumn("last_day", F.col("first_day")))
        .select(*versions.columns, "first_day", "last_day")
    )


def _next_and_reach(scan: Sliced) -> DataFrame:
    """The start of the version after each, and the last day that any before it reaches."""
    local = scan.rows.withColumns(
        {
            "_following": F.lead("first_day").over(scan.in_order()),
            "_reached": F.max("last_day").over(scan.so_far(current=False)),
        }
    )
    edges = scan.edges(
        scan.rows, F.min("first_day").alias("_starts"), F.max("last_day").alias("_ends")
    )
    handed = scan.handed(
        local,
        edges,
        F.last("_starts").over(scan.later()).alias("_later"),
        F.max("_ends").over(scan.earlier()).alias("_earlier"),
    )
    return handed.select(
        *[c for c in scan.rows.columns if c not in (SLICE, scan.order)],
        F.coalesce("_following", "_later").alias("_next"),
        F.greatest("_reached", "_earlier").alias("_reach"),
    )


def flatten_intervals(
    versions: DataFrame,
    key: str,
    order_col: str,
    spine_start: date,
    spine_end: date,
    day_col: str = "date_day",
    as_text: bool = False,
) -> DataFrame:
    """One row per key and day, with the state the key ended that day in. Days are dates, or text.

    Days are generated per stretch, so the work is linear in the rows produced and no join with the
    spine is planned. A stretch may have thousands of days, so a table of a few MB can make billions of
    rows; stretches are dealt to several tasks a core, so that cores end together, whatever the size
    of what is dealt.
    """
    stretches = day_stretches(versions, key, order_col, spine_start, spine_end)
    cores = versions.sparkSession.sparkContext.defaultParallelism
    dealt = stretches.repartition(TASKS_PER_CORE * cores, key, "first_day")
    if as_text:
        days = _each_day_as_text("first_day", "last_day", spine_start, spine_end)
    else:
        days = _each_day("first_day", "last_day")
    return dealt.withColumn(day_col, days).drop("first_day", "last_day")


def day_stretches(
    versions: DataFrame, key: str, order_col: str, spine_start: date, spine_end: date
) -> DataFrame:
    """Versions with ``first_day`` and ``last_day``, the days on which a key ended in their state.

    The same days as ``flatten_intervals`` gives, but in one row where they are in a row. Only keys
    whose versions may share a day are compared day by day, on days that a next start leaves open.
    """
    alone, shared = split_by_overlap(versions, key, order_col)
    return _with_days(alone, spine_start, spine_end).unionByName(
        won_stretches(shared, key, order_col, spine_start, spine_end)
    )


def interval_deltas(
    versions: DataFrame,
    group: Sequence[str],
    measures: dict[str, Column],
    spine_start: date,
    spine_end: date,
    day_col: str = "date_day",
) -> DataFrame:
    """Additive measures per day over intervals, from their changes at interval ends only.

    Each version adds its measures on its first day and takes them back on the day after its last.
    The sums of those changes are one row per group and day at most, and a running total over them
    gives the level of every day. The days in between are never generated per version.
    """
    first, last = _clamped_days("valid_from", "valid_to", spine_start, spine_end)
    ends = F.array(
        F.struct(first.alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_add(last, 1).alias("day"), F.lit(-1).alias("sign")),
    )
    steps = (
        versions.where(last >= first)
        .select(*group, *[m.alias(n) for n, m in measures.items()], F.inline(ends))
        .groupBy(*group, "day")
        .agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in measures])
    )
    return _levels(steps, group, list(measures), spine_end, day_col)


def _levels(
    steps: DataFrame, group: Sequence[str], names: list[str], spine_end: date, day_col: str
) -> DataFrame:
    """Running totals at the steps, repeated for each day until the next step.

    A group has at most one step per spine day here, so its window group is bounded by the length
    of the spine.
    """
    ordered = Window.partitionBy(*group).orderBy("day")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.date_sub(F.lead("day").over(ordered), 1), F.lit(spine_end))
    levels = steps.select(
        *group, "day", until.alias("_until"), *[F.sum(n).over(so_far).alias(n) for n in names]
    )
    return levels.where(F.col("_until") >= F.col("day")).select(
        *group,
        *names,
        F.explode(F.sequence("day", "_until", F.expr("interval 1 day"))).alias(day_col),
    )
