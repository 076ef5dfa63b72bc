"""The load: ranges, replacement, refusals, erasure, crashes."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import utc
from tests.test_envelopes import LOG, event
from tidemark.plans.ops import ledger_audit
from tidemark.sources import load
from tidemark.sources.load import PRODUCT_EVENTS, Warehouse, drain_backfill, run_load
from tidemark.sources import log_table
from tidemark.sources.log_table import LogTable
from tidemark.sources.log import LedgerGap, OffsetsExpired, assert_contiguous, ledger_gaps

TOPIC = "product.session"


def messages(spark, first, last, partitions=2, bad=(), account=1):
    rows = []
    for p in range(partitions):
        for i in range(first, last):
            name = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{p}/{i}"))
            body = event(event_id=name, account_id=account + i % 2, event_time=f"2026-03-0{1 + (i * 7) % 9}T00:00:00Z")
            text = "{broken" if i in bad else json.dumps(body)
            rows.append((TOPIC, p, i, utc(2026, 3, 1), None, text.encode()))
    return spark.createDataFrame(rows, LOG)


def entries(warehouse):
    return {
        (r["dag_run_id"], r["partition_id"], r["attempt"]): r for r in warehouse.ledger().collect()
    }


def test_ranges_are_contiguous_and_capped(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 10)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx, max_records=6)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r2", ctx, max_records=6)
    held = entries(warehouse)
    assert [(held["r1", 0, 1]["start_offset"], held["r1", 0, 1]["end_offset"])] == [(0, 6)]
    assert [(held["r2", 1, 1]["start_offset"], held["r2", 1, 1]["end_offset"])] == [(6, 10)]
    assert run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r3", ctx) is None
    assert warehouse.raw(PRODUCT_EVENTS).count() == 20
    assert warehouse.raw(PRODUCT_EVENTS).select("event_id").distinct().count() == 20
    assert ledger_gaps(warehouse.ledger()).count() == 0
    assert ledger_audit(warehouse.ledger()).count() == 0


def test_bad_messages_do_not_stall(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 6, bad=(2, 4))
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 8
    dead = warehouse.dlq(PRODUCT_EVENTS).collect()
    assert {(r["partition_id"], r["kafka_offset"]) for r in dead} == {
        (0, 2), (0, 4), (1, 2), (1, 4),
    }
    assert {r["raw_value"] for r in dead} == {"{broken"}
    assert entries(warehouse)["r1", 0, 1]["dlq_count"] == 2


def test_rerun_replaces_under_its_first_date(spark, folder, ctx):
    warehouse = Warehouse(spark, folder)
    run_load(warehouse, messages(spark, 0, 6, bad=(2,)), PRODUCT_EVENTS, TOPIC, "r1", ctx)
    later = ctx.with_(now=utc(2026, 3, 12))
    run_load(warehouse, messages(spark, 0, 9), PRODUCT_EVENTS, TOPIC, "r1", later)
    raw = warehouse.raw(PRODUCT_EVENTS)
    assert raw.count() == 12  # the recorded range, not what has arrived since
    assert {r[0] for r in raw.select("loaded_date").distinct().collect()} == {date(2026, 3, 10)}
    assert warehouse.dlq(PRODUCT_EVENTS).count() == 0
    assert entries(warehouse)["r1", 0, 2]["row_count"] == 6


def test_empty_rerun_hides_the_rows_before(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 4)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    gone = spark.createDataFrame([(1,), (2,)], "account_id BIGINT")
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx, erasure=gone)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 0
    assert entries(warehouse)["r1", 0, 2]["erased_count"] == 4
    landed = warehouse.landing(PRODUCT_EVENTS).where(F.col("disposition") == "erased")
    assert landed.where(F.col("account_id").isNotNull() | F.col("payload").isNotNull()).count() == 0


def test_crash_before_commit_leaves_no_trace(spark, folder, ctx, monkeypatch):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 4)

    def die(self, rows):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(Warehouse, "commit", die)
        with pytest.raises(RuntimeError):
            run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 0
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 8


def test_expired_offsets_are_refused(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 6)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx, max_records=3)
    with pytest.raises(OffsetsExpired):
        run_load(warehouse, messages(spark, 5, 9), PRODUCT_EVENTS, TOPIC, "r2", ctx)
    with pytest.raises(OffsetsExpired):
        run_load(warehouse, messages(spark, 1, 9), PRODUCT_EVENTS, TOPIC, "r1", ctx)


def test_gaps_are_refused(spark, folder, ctx):
    warehouse = Warehouse(spark, folder)
    run_load(warehouse, messages(spark, 0, 3), PRODUCT_EVENTS, TOPIC, "r1", ctx)
    claim = spark.createDataFrame(
        [(TOPIC, 0, 5)], "topic STRING, partition INT, start_offset BIGINT"
    )
    with pytest.raises(LedgerGap):
        assert_contiguous(claim, warehouse.ledger())


def test_backfill_drains_in_batches_and_sorts(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 10)
    batches = drain_backfill(warehouse, log, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=4)
    assert batches == 3
    raw = warehouse.raw(PRODUCT_EVENTS)
    assert raw.count() == 20
    assert {r[0] for r in raw.select("source_path").distinct().collect()} == {"backfill"}
    per_file = {}
    files = warehouse.landing(PRODUCT_EVENTS).select("_metadata.file_path", "event_time")
    for path, at in files.collect():
        per_file.setdefault(path, []).append(at)
    assert all(times == sorted(times) for times in per_file.values())


def test_overlapping_claims_are_refused_at_commit(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 6, partitions=1)
    first = run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx, max_records=4)
    late = first.withColumns({"dag_run_id": F.lit("r2"), "start_offset": F.lit(3).cast("bigint")})
    with pytest.raises(load.ClaimConflict):
        warehouse.commit(late)
    next_to = first.withColumns(
        {
            "dag_run_id": F.lit("r3"),
            "start_offset": F.lit(4).cast("bigint"),
            "end_offset": F.lit(6).cast("bigint"),
        }
    )
    warehouse.commit(next_to)
    assert warehouse.ledger().select("dag_run_id").distinct().count() == 2


def test_folders_are_by_load_date_alone(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 6, bad=(2,))
    for k in range(3):
        run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, f"r{k}", ctx, max_records=2)
    path = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    found = warehouse.landing(PRODUCT_EVENTS).select(path.alias("path")).distinct().collect()
    assert [r["path"].split("/")[-1] for r in found] == ["loaded_date=2026-03-10"]


def test_one_of_two_concurrent_commits_wins(spark, folder, ctx, monkeypatch):
    """Both runs have found the ledger free of their records when either commits."""
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 6, partitions=3)
    both_checked = threading.Barrier(2)
    claim = Warehouse._claim

    def together(self, entries):
        both_checked.wait(60)
        claim(self, entries)

    monkeypatch.setattr(Warehouse, "_claim", together)
    outcomes = {}

    def attempt(name):
        try:
            run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, name, ctx)
            outcomes[name] = "won"
        except load.ClaimConflict:
            outcomes[name] = "lost"

    racers = [threading.Thread(target=attempt, args=(n,)) for n in ("r1", "r2")]
    for racer in racers:
        racer.start()
    for racer in racers:
        racer.join()
    # Each of three partitions goes to one run, and a run that misses one gets none.
    assert sorted(outcomes.values()) in (["lost", "won"], ["lost", "lost"])
    assert warehouse.raw(PRODUCT_EVENTS).count() in (0, 18)
    monkeypatch.setattr(Warehouse, "_claim", claim)
    winner = next((n for n, o in outcomes.items() if o == "won"), "r1")
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, winner, ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 18


def test_markers_bind_a_start_to_one_run(spark, folder, ctx, monkeypatch):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 4, partitions=2)

    def die(self, entries):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(Warehouse, "_append", die)
        with pytest.raises(RuntimeError):
            run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    with pytest.raises(load.ClaimConflict, match="r1"):
        run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r2", ctx)
    warehouse.release(TOPIC, 0, 0)
    # r2 takes partition 0, finds r1 on partition 1, and gives partition 0 back.
    with pytest.raises(load.ClaimConflict):
        run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r2", ctx)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "r1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 8


def test_backfill_is_one_landing_with_an_entry_per_batch(spark, folder, ctx):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 10)
    run_load(warehouse, messages(spark, 0, 2), PRODUCT_EVENTS, TOPIC, "live", ctx)
    drain_backfill(warehouse, log, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=3)
    held = warehouse.ledger().where("dag_run_id <> 'live'").collect()
    names = ("dag_run_id", "partition_id", "start_offset", "end_offset", "row_count")
    assert {tuple(r[n] for n in names) for r in held} == {
        (f"b-batch{k}", p, 2 + 3 * k, min(5 + 3 * k, 10), min(3, 8 - 3 * k))
        for k in range(3)
        for p in (0, 1)
    }
    assert len({r["batch"] for r in held}) == 1
    assert drain_backfill(warehouse, log, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=3) == 0
    # What comes later goes on in the numbering, and a batch can be repeated by itself.
    more = messages(spark, 0, 12)
    assert drain_backfill(warehouse, more, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=3) == 1
    assert warehouse.ledger().where("dag_run_id = 'b-batch3'").count() == 2
    run_load(warehouse, more, PRODUCT_EVENTS, TOPIC, "b-batch1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 24
    assert entries(warehouse)["b-batch1", 0, 2]["row_count"] == 3


def test_sweep_and_compact_change_nothing_for_readers(spark, folder, ctx, monkeypatch):
    warehouse, log = Warehouse(spark, folder), messages(spark, 0, 10, bad=(4,))
    drain_backfill(warehouse, log, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=4)
    run_load(warehouse, log, PRODUCT_EVENTS, TOPIC, "b-batch1", ctx)  # batch b is partly replaced
    with monkeypatch.context() as patched:
        patched.setattr(Warehouse, "commit", lambda self, entries: None)
        run_load(warehouse, messages(spark, 0, 12), PRODUCT_EVENTS, TOPIC, "dead", ctx)
    raw = sorted(map(str, warehouse.raw(PRODUCT_EVENTS).collect()))
    dead = sorted(map(str, warehouse.dlq(PRODUCT_EVENTS).collect()))
    landed = warehouse.landing(PRODUCT_EVENTS).count()
    assert (len(raw), len(dead), landed) == (18, 2, 32)
    past, future = utc(2020, 1, 1), utc(2100, 1, 1)
    assert warehouse.sweep(PRODUCT_EVENTS, past)["files"] == 0
    swept = warehouse.sweep(PRODUCT_EVENTS, future)
    assert (swept["batches"], swept["rows"]) == (1, 4)  # the one that never committed
    assert warehouse.compact(PRODUCT_EVENTS, ctx, small_rows=0) == 12
    swept = warehouse.sweep(PRODUCT_EVENTS, future)
    assert (swept["batches"], swept["rows"]) == (1, 20)
    assert warehouse.compact(PRODUCT_EVENTS, ctx, small_rows=0) == 0
    assert warehouse.compact(PRODUCT_EVENTS, ctx, small_rows=100) == 20
    assert warehouse.sweep(PRODUCT_EVENTS, future)["batches"] == 2
    assert sorted(map(str, warehouse.raw(PRODUCT_EVENTS).collect())) == raw
    assert sorted(map(str, warehouse.dlq(PRODUCT_EVENTS).collect())) == dead
    assert warehouse.landing(PRODUCT_EVENTS).count() == 20
    # A compacted run is still replaced when it is repeated.
    run_load(warehouse, messages(spark, 0, 10), PRODUCT_EVENTS, TOPIC, "b-batch1", ctx)
    assert warehouse.dlq(PRODUCT_EVENTS).count() == 0 and warehouse.raw(PRODUCT_EVENTS).count() == 20
    assert ledger_audit(warehouse.ledger()).count() == 0


def test_bounds_come_from_footers(spark, folder, ctx):
    log = LogTable(spark, f"{folder}/log").append(messages(spark, 3, 40, partitions=3))
    log.append(messages(spark, 40, 50, partitions=2))
    assert {tuple(r) for r in log.bounds(TOPIC).collect()} == {
        (TOPIC, 0, 3, 50), (TOPIC, 1, 3, 50), (TOPIC, 2, 3, 40),
    }
    assert log.bounds("another").count() == 0
    with log_table._settings(spark, log_table._FOOTERS):
        plan = log._ends(TOPIC)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(offset), MAX(offset)]" in plan
    assert "PushedGroupBy: [topic, partition]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    near = log.messages(TOPIC, [{"partition": 1, "start_offset": 41, "end_offset": 44}])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(offset,41)" in plan
    assert sorted(r["offset"] for r in near.collect()) == [41, 42, 43]


def test_loads_from_files_equal_loads_from_messages(spark, folder, ctx):
    given = messages(spark, 0, 12, bad=(5,))
    log = LogTable(spark, f"{folder}/log").append(given)
    results = []
    for name, source in (("a", given), ("b", log)):
        warehouse = Warehouse(spark, f"{folder}/{name}")
        run_load(warehouse, source, PRODUCT_EVENTS, TOPIC, "r1", ctx, max_records=5)
        drain_backfill(warehouse, source, PRODUCT_EVENTS, TOPIC, "b", ctx, max_records=3)
        results.append(sorted(map(str, warehouse.raw(PRODUCT_EVENTS).collect())))
        assert ledger_gaps(warehouse.ledger()).count() == 0
    assert results[0] == results[1] and len(results[0]) == 22


def test_unknown_accounts_survive_erasure(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "account_id BIGINT, x STRING")
    gone = spark.createDataFrame([(1,)], "account_id BIGINT")
    assert {r["x"] for r in load.drop_erased(rows, gone).collect()} == {"b", "c"}
