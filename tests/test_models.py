"""Staging, facts, marts, checks, drift, activation and operations on small literal tables."""

from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import utc
from tidemark.functions import safe_rate, surrogate_key
from tidemark.operators.incremental import replace_by_key
from tidemark.plans import activation, checks, core, drift, marts, ops, staging
from tidemark.sources import pull, routing

RAW = (
    "topic STRING, partition_id SMALLINT, kafka_offset BIGINT, event_id STRING, account_id BIGINT, "
    "user_id BIGINT, event_type STRING, event_time TIMESTAMP, received_at TIMESTAMP, "
    "kafka_ts TIMESTAMP, loaded_at TIMESTAMP, source_path STRING, payload STRING"
)
CDC = (
    "source_table STRING, op STRING, pk STRING, is_snapshot BOOLEAN, source_lsn BIGINT, "
    "source_ts TIMESTAMP, effective_at TIMESTAMP, loaded_at TIMESTAMP, kafka_offset BIGINT, "
    "source_path STRING, before STRING, after STRING"
)


def raw(event_id, at, loaded=None, account=1, offset=0, path="live", payload=None, arrived=None):
    return (
        "t", 0, offset, event_id, account, 10, "feature_invoked", at, at, arrived or at,
        loaded or at + timedelta(minutes=1), path, payload or '{"feature": "export"}',
    )


def account(pk, created, op="c", lsn=1, offset=0):
    image = json.dumps({"id": pk, "company_name": f"c{pk}", "country": "SE", "created_at": created})
    at = utc(2026, 1, 1)
    return (
        "accounts", op, str(pk), False, lsn, at, at, at, offset, "live",
        image if op == "d" else None, None if op == "d" else image,
    )


@pytest.fixture
def no_accounts(spark):
    return spark.createDataFrame([], CDC)


def staged_ids(df):
    return {r["event_id"]: r["duplicate_copies"] for r in df.collect()}


def test_first_copy_wins_and_copies_are_counted(spark, ctx, no_accounts):
    at = utc(2026, 3, 9)
    rows = [
        raw("a", at, offset=5, arrived=at + timedelta(hours=2), payload='{"feature": "late"}'),
        raw("a", at, offset=9, arrived=at, payload='{"feature": "first"}'),
        raw("b", at, payload="{}"),
    ]
    out = staging.stg_product_events(spark.createDataFrame(rows, RAW), no_accounts, ctx)
    held = {r["event_id"]: r for r in out.collect()}
    assert (held["a"]["feature"], held["a"]["duplicate_copies"]) == ("first", 1)
    assert (held["b"]["feature"], held["b"]["duplicate_copies"]) == (None, 0)


def test_rows_of_other_ids_are_neither_shuffled_nor_sorted(spark, folder):
    at = utc(2026, 3, 9)
    rows = [raw(f"e{k % 90}", at, offset=k, arrived=at + timedelta(hours=k % 7)) for k in range(100)]
    rows += [raw(None, at, offset=k) for k in (201, 200)]
    spark.createDataFrame(rows, RAW).write.parquet(folder)
    out = staging.first_arrival(spark.read.parquet(folder))
    held = {r["event_id"]: r for r in out.collect()}
    assert len(held) == 91 and sum(r["duplicate_copies"] for r in held.values()) == 11
    assert held[None]["kafka_offset"] == 200
    first = {k: min((k, k + 90), key=lambda n: (n % 7, n)) for k in range(10)}
    assert all(held[f"e{k}"]["kafka_offset"] == n for k, n in first.items())
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # The branch of ids that occur once comes first; only the other one aggregates.
    once = plan[: plan.index("SortAggregate")]
    assert "BroadcastHashJoin" in once and "LeftAnti" in once
    assert "Sort" not in once and "Exchange" not in once


def test_cutoff_quarantine_and_full_refresh(spark, ctx, no_accounts):
    early, late = utc(2026, 3, 1), utc(2026, 3, 9)
    rows = [
        raw("old", early),
        raw("late", early, loaded=late),
        raw("replayed", early, loaded=late, path="backfill"),
        raw("edge", late - timedelta(days=3), loaded=late),
    ]
    events = spark.createDataFrame(rows, RAW)
    built = staging.stg_product_events(events.where("event_id = 'old'"), no_accounts, ctx)
    fresh = staging.stg_product_events(events, no_accounts, ctx, built)
    merged = replace_by_key(built, fresh, ["event_id"])
    assert set(staged_ids(merged)) == {"old", "replayed", "edge"}
    held = staging.quarantined(events, merged, ctx).collect()
    assert [(r["event_id"], r["load_lag_days"]) for r in held] == [("late", 8.0)]
    again = ctx.with_(full_refresh=True)
    absorbed = staging.stg_product_events(events, no_accounts, again, built)
    assert set(staged_ids(absorbed)) == {"old", "late", "replayed", "edge"}
    assert staging.quarantined(events, absorbed, again).count() == 0


def test_events_before_their_account(spark, ctx):
    changes = spark.createDataFrame([account(1, "2026-03-05T00:00:00Z")], CDC)
    rows = [
        raw("before", utc(2026, 3, 4)),
        raw("at", utc(2026, 3, 5)),
        raw("unknown", utc(2026, 3, 1), account=99),
        raw("none", utc(2026, 3, 1), account=None),
    ]
    events = spark.createDataFrame(rows, RAW)
    out = staging.stg_product_events(events, changes, ctx)
    assert set(staged_ids(out)) == {"at", "unknown", "none"}
    listed = staging.unreconciled(events, out, changes).collect()
    assert [(r["event_id"], r["reason"]) for r in listed] == [("before", "event predates account")]


def test_late_event_updates_its_own_day(spark, ctx, no_accounts):
    rows = [raw("a", utc(2026, 3, 5)), raw("b", utc(2026, 3, 6)), raw("x", utc(2026, 2, 1))]
    built = staging.stg_product_events(spark.createDataFrame(rows, RAW), no_accounts, ctx)
    fact = core.fct_account_activity_daily(built, ctx)
    rows.append(raw("c", utc(2026, 3, 5, 1), loaded=utc(2026, 3, 7)))
    events = staging.stg_product_events(spark.createDataFrame(rows, RAW), no_accounts, ctx)
    fresh = core.fct_account_activity_daily(events, ctx, fact)
    merged = replace_by_key(fact, fresh, ["account_id", "activity_date"])
    counts = {r["activity_date"]: r["events"] for r in merged.collect()}
    assert counts == {date(2026, 3, 5): 2, date(2026, 3, 6): 1, date(2026, 2, 1): 1}
    assert date(2026, 2, 1) not in {r["activity_date"] for r in fresh.collect()}


def test_deleted_and_returning_accounts(spark):
    rows = [
        account(1, "2026-01-01T00:00:00Z"),
        account(2, "2026-01-01T00:00:00Z"),
        account(2, "2026-01-01T00:00:00Z", "d", 2),
        account(3, "2026-01-01T00:00:00Z"),
        account(3, "2026-01-01T00:00:00Z", "d", 2),
        account(3, "2026-01-01T00:00:00Z", "c", 3),
        account(1, "2026-01-01T00:00:00Z", offset=7),
    ]
    dim = core.dim_account(staging.stg_account_changes(spark.createDataFrame(rows, CDC)))
    assert {(r["account_id"], r["is_deleted"]) for r in dim.collect()} == {(1, False), (3, True)}


def test_failures_are_transitions(spark):
    schema = (
        "invoice_id BIGINT, op STRING, source_lsn BIGINT, effective_at TIMESTAMP, status STRING, "
        "previous_status STRING"
    )
    at = utc(2026, 1, 1)
    rows = [
        (1, "c", 1, at, "payment_failed", None),
        (1, "u", 2, at, "payment_failed", "payment_failed"),
        (1, "u", 3, at, "open", "payment_failed"),
        (1, "u", 4, at, "payment_failed", "open"),
        (1, "u", 5, at, "paid", "payment_failed"),
    ]
    found = core.invoice_failures(spark.createDataFrame(rows, schema)).collect()
    assert [(r["invoice_id"], r["failure_count"]) for r in found] == [(1, 2)]


def test_billing_paths(spark):
    at = utc(2026, 3, 1)
    hooks = spark.createDataFrame(
        [("a", "paid", 1, at, at), ("a", "paid", 1, at, at), ("w", "paid", 1, at, at)],
        "provider_event_id STRING, event_type STRING, account_id BIGINT, "
        "provider_created_at TIMESTAMP, received_at TIMESTAMP",
    )
    batch = spark.createDataFrame(
        [("a", "paid", 1, at, at, "{}"), ("b", "paid", 1, at, at, "{}")],
        "provider_event_id STRING, event_type STRING, account_id BIGINT, "
        "provider_created_at TIMESTAMP, pulled_at TIMESTAMP, payload STRING",
    )
    merged = staging.stg_billing_events(hooks, batch)
    arrived = {r["provider_event_id"]: r["arrived_by"] for r in merged.collect()}
    assert arrived == {"a": "both", "b": "batch_only", "w": "webhook_only"}
    day = staging.stg_billing_reconciliation(merged).collect()[0]
    assert (day["events"], day["webhook_missed"], float(day["webhook_miss_rate"])) == (2, 1, 0.5)
    assert day["duplicate_deliveries"] == 1


def test_score_components(spark):
    def points(column):
        return spark.range(1).select(column).first()[0]

    lit = F.lit
    drops = [(0, 0, 0), (0, 5, 35), (39, 100, 25), (40, 100, 12), (69, 100, 12), (70, 100, 0)]
    for recent, prior, expected in drops:
        assert points(marts.usage_drop_points(lit(recent), lit(prior))) == expected
    for days, expected in [(None, 20), (22, 20), (21, 12), (14, 5), (7, 0)]:
        assert points(marts.dormancy_points(lit(days).cast("int"))) == expected
    for used, seats, expected in [(0, None, 0), (0, 0, 0), (1, 10, 15), (2, 10, 8), (5, 10, 0)]:
        assert points(marts.seat_points(lit(used), lit(seats).cast("int"))) == expected
    for score, gone, band in [(60, False, "critical"), (35, False, "high"), (15, False, "medium"),
                              (14, False, "low"), (90, True, "churned")]:
        assert points(marts.churn_band(lit(score), lit(gone))) == band
    ranked = marts.ranked_reasons([("a", lit(5)), ("b", lit(0)), ("c", lit(20)), ("d", lit(5))])
    assert points(ranked) == ["c", "a", "d"]


def test_rates_and_keys(spark):
    row = spark.createDataFrame([(1, 3, None)], "a INT, b INT, c STRING").select(
        safe_rate("a", "b"), safe_rate(F.col("a"), F.lit(0)), surrogate_key("a", "c")
    ).first()
    assert float(row[0]) == 0.3333 and row[1] is None
    assert row[2] == spark.sql("select md5('1|<null>')").first()[0]


# ------------------------------------------------------------------ checks


def activity(spark, counts, copies=0):
    rows = [(1, day, n, copies) for day, n in counts.items()]
    return spark.createDataFrame(
        rows, "account_id BIGINT, activity_date DATE, events BIGINT, duplicate_copies BIGINT"
    )


def test_volume_against_the_median(spark, ctx):
    usual = {date(2026, 3, d): n for d, n in zip(range(2, 9), [100, 100, 5000, 100, 90, 110, 100])}
    verdict = checks.volume_anomaly(activity(spark, {**usual, date(2026, 3, 9): 100}), ctx).first()
    assert (verdict["status"], verdict["observed"]) == ("pass", 1.0)
    verdict = checks.volume_anomaly(activity(spark, {**usual, date(2026, 3, 9): 10}), ctx).first()
    assert verdict["status"] == "fail"
    assert checks.volume_anomaly(activity(spark, usual), ctx).first()["status"] == "fail"
    young = checks.volume_anomaly(activity(spark, {date(2026, 3, 9): 5}), ctx).first()
    assert young["status"] == "warn" and "insufficient" in young["details"]


def test_duplicates_and_freshness(spark, ctx):
    noisy = activity(spark, {date(2026, 3, 10): 100}, copies=3)
    assert checks.duplicate_rate(noisy, ctx).first()["status"] == "fail"
    quiet = activity(spark, {date(2026, 3, 1): 100}, copies=50)
    assert checks.duplicate_rate(quiet, ctx).first()["observed"] == 0.0
    slo = spark.createDataFrame(list(checks.FRESHNESS_SLO), checks.SLO_SCHEMA)
    layers = {
        "raw_cdc": spark.createDataFrame([(utc(2026, 3, 10, 11, 55),)], "t TIMESTAMP"),
        "staging": spark.createDataFrame([(utc(2026, 3, 10, 10, 59),)], "t TIMESTAMP"),
        "marts": spark.createDataFrame([], "t TIMESTAMP"),
        "unheard_of": spark.createDataFrame([], "t TIMESTAMP"),
    }
    found = {r["target"]: r["status"] for r in checks.freshness(layers, slo, ctx).collect()}
    assert found == {"raw_cdc": "pass", "staging": "fail", "marts": "fail"}


def test_a_layer_that_cannot_be_read_fails_alone(spark, ctx, folder):
    slo = spark.createDataFrame(list(checks.FRESHNESS_SLO), checks.SLO_SCHEMA)
    layers = {
        "raw_cdc": spark.createDataFrame([(utc(2026, 3, 10, 11, 55),)], "t TIMESTAMP"),
        "marts": lambda: spark.read.parquet(f"{folder}/missing"),
    }
    verdicts = checks.freshness(layers, slo, ctx)
    found = {r["target"]: r for r in verdicts.collect()}
    assert (found["raw_cdc"]["status"], found["marts"]["status"]) == ("pass", "fail")
    assert "missing" in found["marts"]["details"]
    checks.append_results(verdicts, f"{folder}/history")
    checks.append_results(verdicts, f"{folder}/history")
    assert spark.read.parquet(f"{folder}/history").count() == 4


def test_reconciliation_is_silent_without_snapshot_or_in_a_gap(spark):
    dim = spark.createDataFrame(
        [(1, "active", 5, "pro", utc(2026, 1, 1), utc(2026, 2, 1)),
         (1, "cancelled", 5, "pro", utc(2026, 2, 1), utc(9999, 12, 31))],
        "subscription_id BIGINT, status STRING, seats INT, plan_code STRING, valid_from TIMESTAMP, "
        "valid_to TIMESTAMP",
    )
    shot_schema = "snapshot_at TIMESTAMP, source_table STRING, pk STRING, row_data STRING"
    gap_schema = "detected_at TIMESTAMP, resolved_at TIMESTAMP"

    def failures(shots, gaps):
        return checks.reconcile_scd2(
            dim,
            spark.createDataFrame(shots, shot_schema),
            spark.createDataFrame(gaps, gap_schema),
        ).count()

    agrees = json.dumps({"status": "active", "seats": 5, "plan_code": "pro"})
    differs = json.dumps({"status": "trial", "seats": 5, "plan_code": "pro"})
    then = utc(2026, 1, 15)
    assert failures([(then, "subscriptions", "1", agrees)], []) == 0
    assert failures([(then, "subscriptions", "1", differs)], []) == 1
    assert failures([(then, "subscriptions", "2", agrees)], []) == 2
    assert failures([(then, "subscriptions", "1", differs)], [(then, None)]) == 0
    assert failures([(then, "subscriptions", "1", differs)], [(then, then)]) == 1
    assert failures([], []) == 0


# ------------------------------------------------------------------ drift


def test_drift_findings(spark, ctx):
    old, new = utc(2026, 3, 10, 1), utc(2026, 3, 10, 11, 30)
    before = '{"feature": "x", "n": 1, "gone": true, "deep": {"a": 1, "b": {"c": 1}}}'
    after = '{"feature": "x", "n": "1", "extra": [], "deep": {"a": null}}'
    rows = [("use", old, before)] * 25 + [("use", new, after)] * 3
    rows += [("quiet", old, before)] * 25 + [("rare", old, '{"once": 1}')] * 5
    rows += [("rare", new, '{"once": 1}'), ("use", new, '{"feature": null, "n": "1"}')]
    events = spark.createDataFrame(rows, "event_type STRING, loaded_at TIMESTAMP, payload STRING")
    paths = {r["json_path"] for r in drift.payload_paths(events).collect()}
    assert "deep.b" in paths and "deep.b.c" not in paths
    start = utc(2026, 3, 10, 0)
    state = drift.merge_shapes(
        spark.createDataFrame(
            [],
            "event_type STRING, json_path STRING, json_type STRING, first_seen TIMESTAMP, "
            "last_seen TIMESTAMP, occurrences BIGINT",
        ),
        drift.observe_shapes(events, start, utc(2026, 3, 10, 11)),
        start,
        utc(2026, 3, 10, 11),
    )
    merged, findings = drift.run_detection(events, state, ctx)
    found = {
        (r["event_type"], r["json_path"]): (r["change"], r["blocking"]) for r in findings.collect()
    }
    assert found == {
        ("use", "n"): ("type_changed", False),
        ("use", "extra"): ("field_added", False),
        ("use", "gone"): ("field_removed", False),
        ("use", "deep.a"): ("type_changed", False),
        ("use", "deep.b"): ("field_removed", False),
        ("rare", "once"): ("field_added", False),
    }
    seen = merged.where("event_type = 'use' and json_path = 'feature' and json_type = 'string'")
    assert seen.first()["occurrences"] == 28


def test_required_fields_block(spark):
    shape = "event_type STRING, json_path STRING, json_type STRING, occurrences BIGINT"
    now = spark.createDataFrame([("use", "plan", "number", 5)], shape)
    was = spark.createDataFrame([("use", "plan", "string", 50), ("use", "p.feature", "string", 50)],
                                shape)
    found = drift.detect_drift(now, was, drift.required_fields(spark)).collect()
    assert {(r["json_path"], r["change"], r["blocking"]) for r in found} == {
        ("plan", "type_changed", True), ("p.feature", "field_removed", True),
    }


# ------------------------------------------------------------------ activation


def test_sync_round_trip(spark, ctx):
    health = spark.createDataFrame(
        [(i, 10 * i, "low", "rules-v1", ["dormant"], date(2026, 3, 9)) for i in range(1, 5)],
        "account_id BIGINT, churn_score BIGINT, churn_band STRING, score_version STRING, "
        "reasons ARRAY<STRING>, as_of_date DATE",
    )
    payloads = activation.sync_payloads(health)
    first = payloads.orderBy("account_id").first()
    assert json.loads(first["payload"])["as_of_date"] == "2026-03-09"
    assert first["idempotency_key"] == f"1:rules-v1:{first['digest'][:16]}"
    nothing = spark.createDataFrame(
        [],
        "account_id BIGINT, payload_hash STRING, score_version STRING, status STRING, "
        "attempts INT, last_attempt_at TIMESTAMP, last_success_at TIMESTAMP, "
        "last_status_code INT, last_error STRING",
    )
    due = activation.sync_candidates(payloads, nothing)
    assert [r["account_id"] for r in due.collect()] == [4, 3, 2, 1]
    replies = spark.createDataFrame(
        [(1, 200, "ok"), (2, 404, "x" * 500), (3, 503, "down"), (4, 429, "slow")],
        "account_id BIGINT, status_code INT, body STRING",
    )
    outcomes = activation.classify_responses(due, replies)
    status = {r["account_id"]: r["status"] for r in outcomes.collect()}
    assert status == {1: "synced", 2: "skipped_client_error", 3: "failed",
                      4: "skipped_client_error"}
    state = activation.merge_sync_state(nothing, outcomes, ctx)
    assert {len(r["last_error"] or "") for r in state.where("account_id = 2").collect()} == {205}
    # Only the failed one is due again; a refusal waits for new content.
    again = activation.with_sync_decision(payloads, state)
    assert [r["account_id"] for r in again.where("not unchanged").collect()] == [3]
    verdict = activation.sync_verdict(
        activation.with_sync_decision(payloads, nothing), outcomes
    ).first()
    assert (verdict["sent"], verdict["server_errors"], verdict["failed"]) == (4, 1, True)
    assert checks.reverse_etl_health(state).first()["observed"] == 0.5
    merged = activation.merge_sync_state(state, outcomes.where("account_id = 3"), ctx)
    assert merged.where("account_id = 3").first()["attempts"] == 2


# ------------------------------------------------------------------ operations


def samples(spark, *series):
    rows = []
    for metric, labels, values in series:
        for minute, value in enumerate(values):
            if value is not None:
                rows.append((utc(2026, 3, 1) + timedelta(minutes=minute), metric, labels,
                             float(value)))
    return spark.createDataFrame(
        rows, "ts TIMESTAMP, metric STRING, labels MAP<STRING,STRING>, value DOUBLE"
    )


def firing(spark, alert, minute, *series):
    at = utc(2026, 3, 1) + timedelta(minutes=minute)
    states = ops.alert_states(samples(spark, *series), ops.alert_rules(spark))
    return states.where(
        F.col("firing") & (F.col("alert") == alert) & (F.col("ts") == F.lit(at))
    ).count()


LAG = "redpanda_kafka_consumer_group_lag_max"
LABELS = {"group": "g", "topic": "t"}


def test_an_alert_needs_its_duration(spark):
    steady = (LAG, LABELS, [7000] * 20)
    assert firing(spark, "ConsumerLagHigh", 5, steady) == 0
    assert firing(spark, "ConsumerLagHigh", 12, steady) == 1
    gap = (LAG, LABELS, [7000] + [None] * 359 + [7000])
    assert firing(spark, "ConsumerLagHigh", 360, gap) == 0
    short_gap = (LAG, LABELS, [7000] * 6 + [None] * 3 + [7000] * 6)
    assert firing(spark, "ConsumerLagHigh", 12, short_gap) == 1
    saw = (LAG, LABELS, [0, 2000, 4000, 6500, 7000] * 4)
    assert firing(spark, "ConsumerLagHigh", 12, saw) == 0
    two = [(LAG, {**LABELS, "partition": str(p)}, [7000] * 20) for p in range(2)]
    assert firing(spark, "ConsumerLagHigh", 12, *two) == 1


def test_guards_thresholds_and_increases(spark):
    stalled = ("analytics_seconds_since_last_cdc_change", {}, [700] * 20)
    busy = ("analytics_oltp_writes_per_minute", {}, [40] * 20)
    idle = ("analytics_oltp_writes_per_minute", {}, [0] * 20)
    assert firing(spark, "CdcStalled", 10, stalled, busy) == 1
    assert firing(spark, "CdcStalled", 10, stalled, idle) == 0
    assert firing(spark, "CdcStalled", 10, stalled) == 0
    late = [
        ("analytics_freshness_seconds", {"layer": "staging"}, [7200] * 20),
        ("analytics_freshness_slo_seconds", {"layer": "staging"}, [3600] * 20),
        ("analytics_freshness_seconds", {"layer": "marts"}, [21600] * 20),
        ("analytics_freshness_slo_seconds", {"layer": "marts"}, [86400] * 20),
    ]
    assert firing(spark, "FreshnessSloBreach", 12, *late) == 1
    failed = ("airflow_dagrun_failed_total", {"dag_id": "d"}, [0, 0, 0] + [1] * 17)
    assert firing(spark, "DagFailure", 8, failed) == 1
    assert firing(spark, "DagFailure", 15, failed) == 0


def test_paging_is_muted(spark, ctx):
    slot = {"slot_name": "s"}
    windows = spark.createDataFrame(
        [("x", utc(2026, 3, 1, 0, 9), utc(2026, 3, 1, 0, 12))],
        "scenario STRING, opened_at TIMESTAMP, closed_at TIMESTAMP",
    )
    taken = samples(
        spark,
        ("pg_replication_slots_pg_wal_lsn_diff", slot, [2.5e9] * 15 + [4.5e9] * 5),
    ).unionByName(ops.window_samples(windows, ctx))
    muted = ops.suppress_paging(ops.alert_states(taken, ops.alert_rules(spark)))
    shown = {
        (r["alert"], r["ts"].minute): r["muted"]
        for r in muted.withColumn("ts", F.col("ts")).collect()
    }
    assert shown["SlotWalRetainedWarning", 8] is False
    assert shown["SlotWalRetainedWarning", 11] is True
    assert shown["SlotWalRetainedWarning", 14] is False
    assert shown["SlotWalRetainedWarning", 18] is True
    assert shown["SlotWalRetainedCritical", 18] is False


def test_latest_checks_keep_ties(spark):
    at = utc(2026, 3, 1)
    rows = [("a", "t", "pass", at), ("a", "t", "odd", at + timedelta(1)),
            ("a", "t", "warn", at + timedelta(1)), ("b", "t", "fail", at)]
    df = spark.createDataFrame(
        rows, "check_name STRING, target STRING, status STRING, checked_at TIMESTAMP"
    )
    found = {(r["check_name"], r["status_value"]) for r in ops.latest_checks(df).collect()}
    assert found == {("a", 2), ("a", 1), ("b", 2)}


def test_pull_merges_once_and_moves_on_only(spark, ctx):
    schema = "provider_event_id STRING, provider_created_at TIMESTAMP, payload STRING"
    t = [utc(2026, 3, d) for d in range(1, 10)]
    held = spark.createDataFrame([("a", t[0], "old"), ("b", t[5], "old")], schema)
    state = spark.createDataFrame(
        [(t[5], "b")], "last_created_at TIMESTAMP, last_event_id STRING"
    )
    offered = spark.createDataFrame(
        [("a", t[0], "new", 0), ("b", t[5], "new", 1), ("c", t[4], "new", 2),
         ("d", t[5], "new", 3), ("d", t[5], "again", 4)],
        schema + ", fetch_order INT",
    )
    fetched = pull.pull_window(offered, state, ctx)
    assert {r[0] for r in fetched.collect()} == {"b", "c", "d"}
    merged = {r["provider_event_id"]: r["payload"] for r in
              pull.merge_new_events(fetched, held).collect()}
    assert merged == {"a": "old", "b": "old", "c": "new", "d": "new"}
    assert pull.advance_cursor(fetched, state, ctx).first()["last_event_id"] == "b"
    report = pull.pull_report(fetched, held).first()
    assert (report["fetched"], report["inserted"], report["duplicates_skipped"]) == (4, 2, 2)


def test_routing(spark):
    df = spark.createDataFrame([("page_view",), ("nope",), (None,)], "event_type STRING")
    assert [r["topic"] for r in routing.route_events(df).collect()] == [
        "product.session", None, None,
    ]
    assert routing.rejected_events(df).count() == 2


def test_paths_take_one_scan_and_no_union(spark, folder):
    rows = [("e", '{"a": {"b": 1, "c": "x"}, "d": [1], "f": {}, "g": null}'), ("e", "[1]"), ("e", None)]
    spark.createDataFrame(rows, "event_type STRING, payload STRING").write.parquet(folder)
    paths = drift.payload_paths(spark.read.parquet(folder))
    assert sorted((r["json_path"], r["json_type"]) for r in paths.collect()) == [
        ("a", "object"), ("a.b", "number"), ("a.c", "string"), ("d", "array"), ("f", "object"),
        ("g", "null"),
    ]
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
