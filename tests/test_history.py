"""Type-2 history: scenarios, invariants, and slicing of hot keys."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import utc
from tidemark.operators.history import as_of_join, day_stretches, flatten_intervals, scd2
from tidemark.operators import ordered
from tidemark.operators.ordered import Sliced
from tidemark.plans import core, marts

CHANGES = (
    "subscription_id BIGINT, op STRING, is_snapshot BOOLEAN, source_lsn BIGINT, "
    "source_ts TIMESTAMP, effective_at TIMESTAMP, source_path STRING, account_id BIGINT, "
    "plan_code STRING, status STRING, seats INT, mrr_cents INT, started_at TIMESTAMP, "
    "ended_at TIMESTAMP"
)


def change(lsn, at, status="active", op="u", key=1, plan="pro", seats=5, mrr=100):
    return (
        key, op, op == "r", lsn, at, at, "live", key, plan, status, seats, mrr, at, None,
    )


def history(spark, ctx, *changes):
    df = core.dim_subscription(spark.createDataFrame(list(changes), CHANGES))
    return df.orderBy("source_lsn").collect()


def test_three_versions_in_one_day(spark, ctx):
    rows = history(
        spark,
        ctx,
        change(1, utc(2026, 3, 1, 8), "trial", "c"),
        change(2, utc(2026, 3, 1, 9), "active"),
        change(3, utc(2026, 3, 1, 10), "cancelled"),
    )
    assert [r["status"] for r in rows] == ["trial", "active", "cancelled"]
    assert [r["is_current"] for r in rows] == [False, False, True]


def test_change_of_nothing_leaves_no_hole(spark, ctx):
    rows = history(
        spark,
        ctx,
        change(1, utc(2026, 3, 1), op="c"),
        change(2, utc(2026, 3, 2)),
        change(3, utc(2026, 3, 5), seats=9),
        change(4, utc(2026, 3, 6), seats=9),
    )
    assert len(rows) == 2
    assert rows[0]["valid_to"] == rows[1]["valid_from"]
    assert rows[1]["is_current"] and rows[1]["ended_by_delete"] is False


def test_delete_closes_and_opens_nothing(spark, ctx):
    rows = history(
        spark,
        ctx,
        change(1, utc(2026, 3, 1), op="c"),
        change(2, utc(2026, 3, 4), op="d"),
        change(3, utc(2026, 3, 8), op="c"),
    )
    assert [(r["ended_by_delete"], r["is_current"]) for r in rows] == [(True, False), (False, True)]
    shown = core.dim_subscription(
        spark.createDataFrame(
            [change(1, utc(2026, 3, 1), op="c"), change(2, utc(2026, 3, 4), op="d")], CHANGES
        ),
    ).select(F.col("valid_to").cast("string"))
    assert shown.first()[0] == "2026-03-04 00:00:00"


def test_order_is_the_log_position_not_time(spark, ctx):
    rows = history(
        spark,
        ctx,
        change(2, utc(2026, 3, 1), "cancelled"),
        change(1, utc(2026, 3, 1), "active", "c"),
    )
    assert [r["status"] for r in rows] == ["active", "cancelled"]


def test_null_values_are_compared(spark, ctx):
    rows = history(
        spark,
        ctx,
        change(1, utc(2026, 3, 1), op="c", mrr=None),
        change(2, utc(2026, 3, 2), mrr=None),
        change(3, utc(2026, 3, 3), mrr=7),
    )
    assert [r["source_lsn"] for r in rows] == [1, 3]


def random_changes(seed, keys=6, per_key=40, backwards=False):
    rng = random.Random(seed)
    rows, lsn = [], 0
    for key in range(keys):
        # One key has most of the rows.
        at = utc(2026, 1, 1)
        for i in range(per_key * 8 if key == 0 else per_key):
            lsn += 1
            at += timedelta(hours=rng.randint(0, 20))
            moved = at - timedelta(days=30) if backwards and rng.random() < 0.1 else at
            op = "c" if i == 0 else rng.choice("uuuuuuud")
            rows.append(
                change(
                    lsn,
                    moved,
                    rng.choice(["trial", "active", "past_due", "cancelled"]),
                    op,
                    key,
                    rng.choice(["pro", "free"]),
                    rng.choice([1, 2, None]),
                    rng.choice([10, None]),
                )
            )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("backwards", [False, True])
def test_slices_give_the_same_as_whole_keys(spark, ctx, backwards, monkeypatch):
    df = spark.createDataFrame(random_changes(3, backwards=backwards), CHANGES)
    each = ctx.with_(spine_start=date(2025, 11, 1), now=utc(2026, 6, 1))
    results = []
    for positions in (1_000_000, 25):
        monkeypatch.setattr(ordered, "POSITIONS_PER_SLICE", positions)
        dim = core.dim_subscription(df)
        daily = core.fct_subscription_daily(dim, each)
        results.append(
            [
                sorted(map(str, frame.collect()))
                for frame in (
                    dim,
                    daily,
                    marts.mart_revenue_mrr(daily),
                    marts.revenue_from_versions(dim, each),
                )
            ]
        )
    assert results[0] == results[1]
    # Revenue from interval ends equals revenue from the daily fact, shared days included.
    assert results[0][2] == results[0][3]


def test_intervals_of_a_key_abut_or_end_in_a_delete(spark, ctx):
    df = spark.createDataFrame(random_changes(5), CHANGES)
    rows = core.dim_subscription(df).orderBy("subscription_id", "source_lsn").collect()
    for left, right in zip(rows, rows[1:]):
        if left["subscription_id"] == right["subscription_id"]:
            assert left["valid_to"] <= right["valid_from"]
            assert left["ended_by_delete"] or left["valid_to"] == right["valid_from"]


def test_daily_state_is_that_at_day_end(spark, ctx):
    dim = core.dim_subscription(
        spark.createDataFrame(
            [
                change(1, utc(2026, 3, 1, 8), "trial", "c"),
                change(2, utc(2026, 3, 1, 9), "active"),
                change(3, utc(2026, 3, 4, 9), "cancelled"),
                change(4, utc(2026, 3, 6, 9), op="d"),
            ],
            CHANGES,
        ),
    )
    daily = core.fct_subscription_daily(dim, ctx).orderBy("date_day").collect()
    assert [(r["date_day"].day, r["status"]) for r in daily] == [
        (1, "active"), (2, "active"), (3, "active"), (4, "cancelled"), (5, "cancelled"),
    ]


def test_open_versions_reach_the_end_of_the_spine(spark, ctx):
    df = spark.createDataFrame([change(1, utc(2026, 3, 9), op="c")], CHANGES)
    daily = core.fct_subscription_daily(core.dim_subscription(df), ctx)
    assert daily.agg(F.max("date_day")).first()[0] == date(2026, 4, 9)


def brute_force_as_of(facts, versions):
    out = {}
    for name, key, at in facts:
        covering = [v for v in versions if v[0] == key and at is not None and v[1] <= at < v[2]]
        best = max(covering, key=lambda v: (v[1], v[3]), default=None)
        out[name] = best[4] if best is not None else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_join(spark, seed):
    """Versions that abut, overlap, lie within one another, start together, or end before they
    start."""
    rng = random.Random(seed)
    day = [utc(2026, 1, 1) + timedelta(days=i / 2) for i in range(120)]
    versions = []
    for key in range(4):
        starts = sorted(rng.choices(range(100), k=12))
        for i, start in enumerate(starts):
            end = starts[i + 1] if key == 1 and i < 11 else start + rng.randint(-5, 60)
            versions.append((key, day[start], day[max(0, min(end, 119))], key * 100 + i, f"v{key}-{i}"))
    facts = [
        (i, rng.choice([0, 0, 0, 1, 2, 3, 9, None]), rng.choice([*day, None])) for i in range(400)
    ]
    joined = as_of_join(
        spark.createDataFrame(facts, "name INT, key INT, at TIMESTAMP"),
        spark.createDataFrame(
            versions,
            "key INT, valid_from TIMESTAMP, valid_to TIMESTAMP, source_lsn BIGINT, label STRING",
        ),
        "key",
        "at",
        "source_lsn",
        ["label"],
    ).collect()
    assert {r["name"]: r["label"] for r in joined} == brute_force_as_of(facts, versions)
    assert len(joined) == 400


def test_previous_across_slices(spark, monkeypatch):
    rows = [(1, i, (i * 7) % 13) for i in range(100)] + [(2, i, i % 3) for i in range(5)]
    df = spark.createDataFrame(rows, "k INT, o INT, v INT")
    want = {(k, o): v for k, o, v in rows}
    for positions in (1_000_000, 10, 1):
        monkeypatch.setattr(ordered, "POSITIONS_PER_SLICE", positions)
        for scan in (Sliced.by_position(df, ["k"], "o"), Sliced.by_range(df, ["k"], "o")):
            found = scan.with_previous(["v"], "p").collect()
            assert len(found) == len(rows)
            for r in found:
                assert (r["p"] and r["p"]["v"]) == want.get((r["k"], r["o"] - 1))


def test_ranges_cut_a_hot_key_on_one_day(spark):
    """A third of the rows are of one key and one day, and its slices are as even as the others."""
    rows = [(0, utc(2026, 1, 1) + timedelta(seconds=i)) for i in range(3000)]
    rows += [(1 + i % 50, utc(2026, 1, 1) + timedelta(hours=i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k INT, at TIMESTAMP").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        scan = Sliced.by_range(df, ["k"], "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = {tuple(r)[:2]: r["count"] for r in scan.rows.groupBy("k", "_slice").count().collect()}
    assert len([k for k in sizes if k[0] == 0]) >= 4
    assert max(sizes.values()) < 1200


def test_as_of_join_on_a_hot_key(spark):
    day = utc(2026, 1, 1)
    versions = [
        (0, day + timedelta(seconds=i * 7), day + timedelta(seconds=i * 7 + 5 + 30 * (i % 9 == 0)), i, f"v{i}")
        for i in range(150)
    ]
    facts = [(i, 0 if i % 3 == 0 else i % 40, day + timedelta(seconds=(i * 13) % 1100)) for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = as_of_join(
            spark.createDataFrame(facts, "name INT, key INT, at TIMESTAMP"),
            spark.createDataFrame(
                versions,
                "key INT, valid_from TIMESTAMP, valid_to TIMESTAMP, source_lsn BIGINT, label STRING",
            ),
            "key",
            "at",
            "source_lsn",
            ["label"],
        ).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["name"]: r["label"] for r in joined} == brute_force_as_of(facts, versions)


def evaluations(df, name="seen"):
    """``df`` with a count of how often its rows are evaluated."""
    counter = df.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(counted, df.schema), counter


def test_scans_evaluate_their_input_once(spark, ctx):
    rows = random_changes(4, backwards=True)
    df, seen = evaluations(spark.createDataFrame(rows, CHANGES))
    each = ctx.with_(spine_start=date(2025, 11, 1), now=utc(2026, 6, 1))
    dim = core.dim_subscription(df)
    marts.mart_revenue_mrr(core.fct_subscription_daily(dim, each)).collect()
    marts.revenue_from_versions(dim, each).collect()
    assert seen.value == len(rows)


def test_versions_of_other_tables(spark, ctx):
    rows = [(1, "c", 1, utc(2026, 1, 1), "a"), (1, "u", 2, utc(2026, 1, 2), "b")]
    df = spark.createDataFrame(
        rows, "id INT, op STRING, lsn BIGINT, at TIMESTAMP, name STRING"
    )
    assert scd2(df, "id", "lsn", "at", ["name"]).count() == 2


def test_revenue_through_days_equals_the_daily_fact(spark, ctx):
    """Versions alike, days shared, business time running backwards, nulls and deletes."""
    rows = []
    for key in range(40):
        plan = ("pro", "free", None)[key % 3]
        rows += [
            change(10 * key, utc(2026, 2, 1, 9), op="r" if key % 4 else "c", key=key, plan=plan),
            change(10 * key + 1, utc(2026, 3, 1 + key % 3), status="past_due", key=key, plan=plan),
            change(10 * key + 2, utc(2026, 3, 1 + key % 3, 7), status="trial", key=key, mrr=None),
        ]
        if key % 5 == 0:
            rows.append(change(10 * key + 3, utc(2026, 2, 20), status="active", key=key, seats=None))
        if key % 7 == 0:
            rows.append(change(10 * key + 4, utc(2026, 3, 6), op="d", key=key))
    dim = core.dim_subscription(spark.createDataFrame(rows, CHANGES))
    each = ctx.with_(spine_start=date(2026, 2, 10))
    want = marts.mart_revenue_mrr(core.fct_subscription_daily(dim, each))
    found = marts.revenue_through_days(dim, each)
    assert found.columns == want.columns and found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


VERSIONS = "k INT, n BIGINT, valid_from TIMESTAMP, valid_to TIMESTAMP"


def laid_out(stretches):
    return [
        (r["k"], r["first_day"] + timedelta(days=i), r["n"])
        for r in stretches.collect()
        for i in range((r["last_day"] - r["first_day"]).days + 1)
    ]


@pytest.mark.parametrize("rows_per_key", [100_000, 12])
def test_shared_days_go_to_the_latest_start(spark, monkeypatch, rows_per_key):
    """Versions nested and overlapping, alike in start, of no day, out of the spine, with gaps between
    them; keys whole or cut, with more rows in the first."""
    monkeypatch.setattr(ordered, "ROWS_PER_KEY", rows_per_key)
    rng = random.Random(7)
    rows = []
    for key in range(12):
        for i in range(60 if key == 0 else 8):
            at = utc(2026, 1, 1) + timedelta(hours=rng.randint(0, 24 * 90))
            days = rng.choice([0, 0, 1, 3, 9, 40, 200] if key % 3 else [1, 2, 80])
            rows.append((key, i, at, at + timedelta(days=days, hours=rng.randint(-30, 5))))
    rows.append((99, 1, utc(2026, 2, 1), utc(9999, 12, 31)))
    start, end = date(2026, 1, 15), date(2026, 5, 1)
    want = {}
    for key, n, since, until in rows:
        day = max(since.date(), start)
        while day < until.date() and day <= end:
            want[key, day] = max(want.get((key, day), (since, n)), (since, n))
            day += timedelta(days=1)
    versions = spark.createDataFrame(rows, VERSIONS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = laid_out(day_stretches(versions, "k", "n", start, end))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(want)
    assert {(k, day): n for k, day, n in found} == {at: n for at, (_, n) in want.items()}
    for as_text in (False, True):
        daily = flatten_intervals(versions, "k", "n", start, end, as_text=as_text).collect()
        assert sorted((r["k"], str(r["date_day"]), r["n"]) for r in daily) == sorted(
            (k, str(day), n) for k, day, n in found
        )


def test_days_are_compared_only_where_a_start_leaves_them_open(spark):
    """The second begins in the first and ends after it; the fourth lies in the third, which has the days
    after it too."""
    rows = [
        (1, 1, utc(2026, 1, 1), utc(2026, 12, 1)),
        (1, 2, utc(2026, 6, 1), utc(2027, 1, 1)),
        (2, 3, utc(2026, 1, 1), utc(2026, 12, 1)),
        (2, 4, utc(2026, 6, 1), utc(2026, 11, 26)),
    ]
    stretches = day_stretches(
        spark.createDataFrame(rows, VERSIONS), "k", "n", date(2025, 1, 1), date(2028, 1, 1)
    )
    assert stretches.count() == 4 + 5
    found = laid_out(stretches)
    assert len(found) == len(set(found)) == 365 + 334
