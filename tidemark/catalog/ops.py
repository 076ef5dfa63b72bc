"""Operational queries: verdict history, gauges, windows and alerts, all kept by the hour."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import drift, inputs, staging
from tidemark.catalog.inputs import CTX, SQL_BILLING
from tidemark.catalog.registry import query
from tidemark.plans import checks, ops
from tidemark.plans import staging as staging_plans

# ------------------------------------------------------------------ verdict history

SQL_HOURLY = """hourly AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    date_trunc('hour', ts) AS hour FROM events
)"""

SQL_RESULTS = f"""{SQL_HOURLY}, results AS (
  SELECT hour AS checked_at, 'quarantine_rate' AS check_name, event_type AS target,
    CASE WHEN count(*) FILTER (WHERE k >= 97) = 0 THEN 'pass'
      WHEN count(*) FILTER (WHERE k >= 97) * 10 < count(*) THEN 'warn' ELSE 'fail' END AS status,
    CAST(count(*) FILTER (WHERE k >= 97) AS DOUBLE) / count(*) AS observed,
    CAST(0.01 AS DOUBLE) AS threshold
  FROM hourly GROUP BY hour, event_type
  UNION ALL
  SELECT hour, 'freshness',
    CASE event_type WHEN 'view' THEN 'raw_product_events' WHEN 'click' THEN 'raw_cdc'
      WHEN 'error' THEN 'raw_billing' WHEN 'signup' THEN 'staging' ELSE 'marts' END,
    CASE WHEN max(k) >= 90 THEN 'fail' ELSE 'pass' END, CAST(max(k) * 60 AS DOUBLE),
    CAST(600 AS DOUBLE)
  FROM hourly GROUP BY hour, event_type
)"""


def dq_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts once an hour, from the events of that hour."""
    late = F.count_if(F.col("k") >= 97)
    total = F.count(F.lit(1))
    by_hour = inputs.events(spark, sf_dir).groupBy(
        F.date_trunc("hour", "ts").alias("checked_at"), "event_type"
    )
    summed = by_hour.agg(late.alias("late"), total.alias("total"), F.max("k").alias("oldest"))
    held = summed.select(
        "checked_at",
        F.lit("quarantine_rate").alias("check_name"),
        F.col("event_type").alias("target"),
        F.when(F.col("late") == 0, "pass")
        .when(F.col("late") * 10 < F.col("total"), "warn")
        .otherwise("fail")
        .alias("status"),
        (F.col("late").cast("double") / F.col("total")).alias("observed"),
        F.lit(0.01).alias("threshold"),
    )
    layer = (
        F.when(F.col("event_type") == "view", "raw_product_events")
        .when(F.col("event_type") == "click", "raw_cdc")
        .when(F.col("event_type") == "error", "raw_billing")
        .when(F.col("event_type") == "signup", "staging")
        .otherwise("marts")
    )
    aged = summed.select(
        "checked_at",
        F.lit("freshness").alias("check_name"),
        layer.alias("target"),
        F.when(F.col("oldest") >= 90, "fail").otherwise("pass").alias("status"),
        (F.col("oldest") * 60).cast("double").alias("observed"),
        F.lit(600.0).alias("threshold"),
    )
    return held.unionByName(aged)


@query(
    f"""WITH {SQL_RESULTS}
SELECT r.check_name, r.target, r.status,
  CASE r.status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS status_value, r.checked_at
FROM results r JOIN (
  SELECT check_name, target, max(checked_at) AS latest FROM results GROUP BY 1, 2
) l ON l.check_name = r.check_name AND l.target = r.target AND l.latest = r.checked_at""",
    ts="checked_at",
)
def latest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_checks(dq_results(spark, sf_dir))


@query(
    f"""WITH {SQL_RESULTS}, slo AS (
  SELECT * FROM (VALUES ('raw_product_events', 600), ('raw_cdc', 300), ('raw_billing', 1800),
    ('staging', 3600), ('marts', 86400), ('reverse_etl', 86400)) AS s(layer, target_seconds)
)
SELECT s.layer, r.observed AS age_seconds, s.target_seconds,
  r.observed - s.target_seconds AS breach_seconds, r.status, r.checked_at
FROM results r JOIN slo s ON s.layer = r.target JOIN (
  SELECT target, max(checked_at) AS latest FROM results WHERE check_name = 'freshness' GROUP BY 1
) l ON l.target = r.target AND l.latest = r.checked_at
WHERE r.check_name = 'freshness'""",
    ts="checked_at",
)
def freshness_vs_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    slo = spark.createDataFrame(list(checks.FRESHNESS_SLO), checks.SLO_SCHEMA)
    return ops.freshness_vs_slo(dq_results(spark, sf_dir), slo)


# ------------------------------------------------------------------ windows

SQL_WINDOWS = """windows AS (
  SELECT
    CASE WHEN k < 25 THEN 'connector_outage' WHEN k < 50 THEN 'poison_message'
      WHEN k < 75 THEN 'schema_drift' ELSE 'late_duplicate_storm' END AS scenario,
    ts AS opened_at,
    CASE WHEN value >= 5
      THEN ts + CAST(floor(value) AS BIGINT) * INTERVAL 1 MINUTE END AS closed_at,
    CASE WHEN user_id < 10 THEN 'console' ELSE 'schedule' END AS opened_by
  FROM hourly WHERE event_type = 'error'
)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident windows opened by error events; those of little value were never closed."""
    k, at = F.col("k"), F.col("ts")
    return (
        inputs.events(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .select(
            F.when(k < 25, "connector_outage")
            .when(k < 50, "poison_message")
            .when(k < 75, "schema_drift")
            .otherwise("late_duplicate_storm")
            .alias("scenario"),
            at.alias("opened_at"),
            F.when(
                F.col("value") >= 5,
                at + F.make_dt_interval(mins=F.floor("value").cast("int")),
            ).alias("closed_at"),
            F.when(F.col("user_id") < 10, "console").otherwise("schedule").alias("opened_by"),
            F.lit(None).cast("string").alias("notes"),
        )
    )


LAST_EVENING = datetime(2024, 1, 30, 12, 0, tzinfo=UTC)


@query(
    f"""WITH {SQL_HOURLY}, {SQL_WINDOWS}
SELECT scenario, opened_at, opened_by FROM windows WHERE closed_at IS NULL""",
    ts="opened_at",
)
def open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.open_windows(windows(spark, sf_dir))


@query(
    f"""WITH {SQL_HOURLY}, {SQL_WINDOWS}, aged AS (
  SELECT *, closed_at IS NULL AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(opened_at)
    > CASE scenario WHEN 'connector_outage' THEN 45 WHEN 'poison_message' THEN 15 ELSE 30 END
      * CAST(60000000 AS BIGINT) AS stale
  FROM windows
)
SELECT scenario, opened_at, opened_by,
  CASE WHEN stale THEN TIMESTAMP '2024-01-30 12:00:00' ELSE closed_at END AS closed_at,
  CASE WHEN stale THEN 'expired automatically' END AS notes
FROM aged""",
    ts="opened_at closed_at",
)
def expired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expire_windows(windows(spark, sf_dir), CTX.with_(now=LAST_EVENING))


# ------------------------------------------------------------------ gauges


@query(f"""WITH {SQL_RESULTS}, {SQL_WINDOWS}, {SQL_BILLING}, {drift.SQL_SHAPES}
SELECT 'quarantine_rate' AS gauge, coalesce(max(observed), 0) AS value FROM results
WHERE check_name = 'quarantine_rate' AND checked_at > TIMESTAMP '2024-01-30'
UNION ALL SELECT 'reverse_etl_error_rate', coalesce(max(observed), 0) FROM results
WHERE check_name = 'reverse_etl_error_rate'
UNION ALL SELECT 'cdc_gap_open', 0
UNION ALL SELECT 'chaos_window_active', count(*) FROM windows WHERE closed_at IS NULL
UNION ALL SELECT 'drift_blocking_models', count(*) FROM findings WHERE blocking
UNION ALL SELECT 'billing_webhook_miss_rate', coalesce(avg(webhook_miss_rate), 0)
FROM reconciliation WHERE billing_day > DATE '2024-01-24'""")
def platform_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "dq_results": dq_results(spark, sf_dir),
        "cdc_gaps": inputs.cdc_gaps(spark, sf_dir),
        "windows": windows(spark, sf_dir),
        "drift_findings": drift.detection(spark, sf_dir)[1],
        "stg_billing_reconciliation": staging_plans.stg_billing_reconciliation(
            staging.billing_events(spark, sf_dir)
        ),
    }
    return ops.platform_gauges(tables, CTX).withColumn("value", F.round("value", 9))


# ------------------------------------------------------------------ alerts

# Scrapes every ten minutes, from the events of those ten minutes.
SQL_TICKS = """ticks AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, event_type,
    max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k, count(*) AS n,
    max(value) AS value
  FROM events GROUP BY 1, 2
), samples AS (
  SELECT ts, 'analytics_quarantine_rate' AS metric, '' AS label, max(k) / 5000.0 AS value
  FROM ticks GROUP BY ts
  UNION ALL SELECT ts, 'analytics_seconds_since_last_load', event_type, k * 12.0 FROM ticks
  UNION ALL SELECT ts, 'analytics_dq_check_status', event_type, CASE WHEN k >= 40 THEN 2 ELSE 0 END
  FROM ticks
  UNION ALL SELECT ts, 'analytics_cdc_gap_open', '', CASE WHEN max(k) >= 97 THEN 1 ELSE 0 END
  FROM ticks GROUP BY ts
  UNION ALL SELECT ts, 'analytics_chaos_window_active', '',
    CASE WHEN max(k) >= 80 THEN 1 ELSE 0 END
  FROM ticks GROUP BY ts
  UNION ALL SELECT ts, 'pg_replication_slots_pg_wal_lsn_diff', event_type, k * 5e7 FROM ticks
  UNION ALL SELECT ts, 'analytics_seconds_since_last_cdc_change', '', max(k) * 10.0
  FROM ticks GROUP BY ts
  UNION ALL SELECT ts, 'analytics_oltp_writes_per_minute', '', min(k) - 20.0
  FROM ticks GROUP BY ts
  UNION ALL SELECT ts, 'analytics_freshness_seconds', event_type, k * 60.0 FROM ticks
  UNION ALL SELECT ts, 'analytics_freshness_slo_seconds', event_type, n * 600.0 FROM ticks
), rules AS (
  SELECT * FROM (VALUES
    ('LoaderStalled', 'analytics_seconds_since_last_load', 900.0, 300, 'critical'),
    ('SlotWalRetainedWarning', 'pg_replication_slots_pg_wal_lsn_diff', 2e9, 300, 'warning'),
    ('SlotWalRetainedCritical', 'pg_replication_slots_pg_wal_lsn_diff', 4e9, 120, 'critical'),
    ('CdcGapOpen', 'analytics_cdc_gap_open', 0.0, 0, 'warning'),
    ('QuarantineRateHigh', 'analytics_quarantine_rate', 0.01, 3600, 'warning'),
    ('DqCheckFailing', 'analytics_dq_check_status', 1.5, 900, 'warning'),
    ('CdcStalled', 'analytics_seconds_since_last_cdc_change', 600.0, 300, 'critical'),
    ('FreshnessSloBreach', 'analytics_freshness_seconds', NULL, 600, 'warning'),
    ('ChaosWindowOpen', 'analytics_chaos_window_active', 0.0, 0, 'info')
  ) AS r(alert, metric, threshold, held, severity)
), tested AS (
  SELECT r.alert, r.severity, r.held, s.label, s.ts, s.value,
    CASE WHEN alert = 'CdcStalled' THEN s.value > 600 AND coalesce(o.value, 0) > 0
      WHEN alert = 'FreshnessSloBreach' THEN coalesce(s.value > o.value, false)
      ELSE s.value > r.threshold END AS holds
  FROM samples s JOIN rules r USING (metric) LEFT JOIN samples o ON o.ts = s.ts
    AND o.label = s.label AND o.metric = CASE alert
      WHEN 'CdcStalled' THEN 'analytics_oltp_writes_per_minute'
      WHEN 'FreshnessSloBreach' THEN 'analytics_freshness_slo_seconds' END
), spaced AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY alert, label ORDER BY ts)
    > INTERVAL 15 MINUTE, false) AS after_gap FROM tested
), islands AS (
  SELECT *, count(*) FILTER (WHERE NOT holds OR after_gap)
    OVER (PARTITION BY alert, label ORDER BY ts) AS breaks FROM spaced
), states AS (
  SELECT alert, severity, label, ts, value,
    min(ts) OVER (PARTITION BY alert, label, breaks) AS since,
    epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY alert, label, breaks)) >= held * CAST(1000000 AS BIGINT)
      AS firing
  FROM islands WHERE holds
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples every ten minutes."""
    ticks = (
        inputs.events(spark, sf_dir)
        .groupBy(
            F.timestamp_seconds(F.expr("(unix_seconds(ts) div 600) * 600")).alias("ts"),
            "event_type",
        )
        .agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n"))
    )
    name = F.col("event_type")
    per_type = {
        "analytics_seconds_since_last_load": ("topic", F.col("k") * 12.0),
        "analytics_dq_check_status": ("check", F.when(F.col("k") >= 40, 2.0).otherwise(0.0)),
        "pg_replication_slots_pg_wal_lsn_diff": ("slot_name", F.col("k") * 5e7),
        "analytics_freshness_seconds": ("layer", F.col("k") * 60.0),
        "analytics_freshness_slo_seconds": ("layer", F.col("n") * 600.0),
    }
    overall = {
        "analytics_quarantine_rate": F.max("k") / F.lit(5000.0),
        "analytics_cdc_gap_open": F.when(F.max("k") >= 97, 1.0).otherwise(0.0),
        "analytics_chaos_window_active": F.when(F.max("k") >= 80, 1.0).otherwise(0.0),
        "analytics_seconds_since_last_cdc_change": F.max("k") * 10.0,
        "analytics_oltp_writes_per_minute": F.min("k") - 20.0,
    }

    def sample(metric: str, labels, value):
        return F.struct(F.lit(metric).alias("metric"), labels.alias("labels"), value.alias("value"))

    none = F.create_map().cast("map<string,string>")
    typed = ticks.select(
        "ts",
        F.inline(
            F.array(
                *[
                    sample(m, F.create_map(F.lit(label), name), v.cast("double"))
                    for m, (label, v) in per_type.items()
                ]
            )
        ),
    )
    summed = ticks.groupBy("ts").agg(*[v.cast("double").alias(m) for m, v in overall.items()])
    plain = summed.select(
        "ts", F.inline(F.array(*[sample(m, none, F.col(m)) for m in overall]))
    )
    return typed.unionByName(plain)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = 600
    return ops.alert_states(
        samples(spark, sf_dir), ops.alert_rules(spark), stale_seconds=every * 3 // 2
    )


def _label(df: DataFrame) -> DataFrame:
    """The series by the value of its one label, if any."""
    shown = F.coalesce(F.regexp_extract("series", r':"(.*)"\}$', 1), F.lit(""))
    return df.withColumn("label", shown).drop("series", "labels")


@query(f"WITH {SQL_TICKS} SELECT * FROM states", ts="ts since")
def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label(states(spark, sf_dir))


@query(
    f"""WITH {SQL_TICKS}
SELECT alert, severity, label, since, min(ts) AS fired_at, max(ts) AS last_at
FROM states WHERE firing GROUP BY ALL""",
    ts="since fired_at last_at",
)
def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label(ops.alert_intervals(states(spark, sf_dir)))


@query(
    f"""WITH {SQL_TICKS}, firing AS (SELECT * FROM states WHERE firing)
SELECT f.alert, f.severity, f.label, f.ts, f.value, f.since,
  (f.severity IN ('warning', 'critical') AND f.ts IN (
    SELECT ts FROM firing WHERE alert = 'ChaosWindowOpen'))
  OR (f.alert = 'SlotWalRetainedWarning' AND (f.ts, f.label) IN (
    SELECT (ts, label) FROM firing WHERE alert = 'SlotWalRetainedCritical')) AS muted
FROM firing f""",
    ts="ts since",
)
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firing alerts and which of them are muted."""
    return _label(ops.suppress_paging(states(spark, sf_dir)))
