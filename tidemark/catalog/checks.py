"""Queries of the data-quality layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import activation, core, inputs, marts, staging
from tidemark.catalog.activation import SQL_STATE
from tidemark.catalog.core import SQL_ACTIVITY, SQL_VERSIONS
from tidemark.catalog.inputs import (
    CTX,
    SQL_ACCOUNT_CHANGES,
    SQL_BILLING,
    SQL_EVENTS,
    SQL_INVOICE_CHANGES,
    SQL_SNAPSHOT,
    SQL_SUBSCRIPTION_CHANGES,
)
from tidemark.catalog.marts import SQL_HEALTH, SQL_MRR
from tidemark.catalog.registry import query
from tidemark.catalog.staging import SQL_INCREMENTAL, SQL_STAGED
from tidemark.context import kept
from tidemark.plans import checks
from tidemark.plans import marts as mart_plans
from tidemark.plans import staging as staging_plans
from tidemark.plans.activation import sync_payloads


@query(f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}
SELECT event_id, user_id FROM staged WHERE account_id IS NULL""")
def not_null_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged events without an account."""
    return checks.not_null(staging.staged(spark, sf_dir), "account_id").select(
        "event_id", "user_id"
    )


@query(f"""WITH {SQL_EVENTS}
SELECT event_id, count(*) AS occurrences FROM raw_events GROUP BY 1 HAVING count(*) > 1""")
def unique_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids that arrived more than once."""
    return checks.unique(inputs.product_events(spark, sf_dir), ["event_id"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def unique_combination_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique(
        inputs.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query(f"""WITH {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}
SELECT subscription_version_key, status FROM versions
WHERE status NOT IN ('active', 'past_due', 'cancelled')""")
def accepted_values_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with a status outside a narrower set than the declared one."""
    return checks.accepted_values(
        core.subscriptions(spark, sf_dir), "status", ["active", "past_due", "cancelled"]
    ).select("subscription_version_key", "status")


@query(f"{SQL_HEALTH} SELECT account_id, churn_score FROM health WHERE churn_score NOT BETWEEN 10 AND 40")
def accepted_range_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores outside narrower bounds than the declared ones."""
    return checks.accepted_range(
        marts.health(spark, sf_dir), "churn_score", 10, 40
    ).select("account_id", "churn_score")


SQL_MODEL_TESTS = f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED},
{SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}, {SQL_BILLING}
SELECT 'stg_product_events' AS model, 'not_null:event_id' AS test,
  count(*) FILTER (WHERE event_id IS NULL) AS failures FROM staged
UNION ALL SELECT 'stg_product_events', 'not_null:account_id',
  count(*) FILTER (WHERE account_id IS NULL) FROM staged
UNION ALL SELECT 'stg_product_events', 'not_null:event_type',
  count(*) FILTER (WHERE event_type IS NULL) FROM staged
UNION ALL SELECT 'stg_product_events', 'not_null:event_time',
  count(*) FILTER (WHERE event_time IS NULL) FROM staged
UNION ALL SELECT 'stg_product_events', 'unique:event_id', count(*) FROM (
  SELECT event_id FROM staged GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dim_subscription', 'not_null:' || name, failures FROM (
  SELECT count(*) FILTER (WHERE subscription_version_key IS NULL) AS subscription_version_key,
    count(*) FILTER (WHERE subscription_id IS NULL) AS subscription_id,
    count(*) FILTER (WHERE status IS NULL) AS status,
    count(*) FILTER (WHERE valid_from IS NULL) AS valid_from,
    count(*) FILTER (WHERE valid_to IS NULL) AS valid_to FROM versions
) UNPIVOT (failures FOR name IN (subscription_version_key, subscription_id, status, valid_from,
  valid_to))
UNION ALL SELECT 'dim_subscription', 'accepted_values:status', count(*) FILTER (
  WHERE status NOT IN ('trial', 'active', 'past_due', 'cancelled')) FROM versions
UNION ALL SELECT 'dim_subscription', 'unique:subscription_version_key', count(*) FROM (
  SELECT subscription_version_key FROM versions GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'stg_billing_events', 'not_null:provider_event_id',
  count(*) FILTER (WHERE provider_event_id IS NULL) FROM billing
UNION ALL SELECT 'stg_billing_events', 'accepted_values:arrived_by',
  count(*) FILTER (WHERE arrived_by NOT IN ('both', 'webhook_only', 'batch_only')) FROM billing
UNION ALL SELECT 'stg_billing_events', 'unique:provider_event_id', count(*) FROM (
  SELECT provider_event_id FROM billing GROUP BY 1 HAVING count(*) > 1)"""


@query(SQL_MODEL_TESTS)
def model_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared tests of three models, as how many rows fail each."""
    models = {
        "stg_product_events": staging.staged(spark, sf_dir),
        "dim_subscription": core.subscriptions(spark, sf_dir),
        "stg_billing_events": staging.billing_events(spark, sf_dir),
    }
    return reduce(
        DataFrame.unionByName,
        [checks.model_test_failures(name, df) for name, df in models.items()],
    )


@query(f"""WITH {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}, {SQL_SNAPSHOT}, then_valid AS (
  SELECT * FROM versions
  WHERE TIMESTAMP '2024-03-01' >= valid_from AND TIMESTAMP '2024-03-01' < valid_to
)
SELECT coalesce(s.subscription_id, c.subscription_id) AS subscription_id,
  s.status AS snapshot_status, c.status AS scd2_status, s.seats AS snapshot_seats,
  c.seats AS scd2_seats, s.plan_code AS snapshot_plan_code, c.plan_code AS scd2_plan_code
FROM photographed s FULL OUTER JOIN then_valid c ON s.subscription_id = c.subscription_id
WHERE s.subscription_id IS NULL OR c.subscription_id IS NULL
  OR s.status IS DISTINCT FROM c.status OR s.seats IS DISTINCT FROM c.seats
  OR s.plan_code IS DISTINCT FROM c.plan_code""")
def scd2_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.reconcile_scd2(
        core.subscriptions(spark, sf_dir),
        inputs.oltp_snapshots(spark, sf_dir),
        inputs.cdc_gaps(spark, sf_dir),
    )


@query(
    f"""WITH {SQL_BILLING}
SELECT billing_day, events, webhook_missed, webhook_miss_rate FROM reconciliation
WHERE events >= 5 AND webhook_miss_rate > 0.10""",
    days="billing_day",
)
def miss_rate_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with five events or more of which a tenth were missed."""
    days = staging_plans.stg_billing_reconciliation(staging.billing_events(spark, sf_dir))
    return checks.miss_rate_breaches(days, min_events=5, max_rate=0.10)


SQL_VOLUME = f"""daily AS (
  SELECT activity_date, CAST(sum(events) AS BIGINT) AS events FROM activity
  WHERE activity_date > DATE '2024-01-22' AND activity_date <= DATE '2024-01-30' GROUP BY 1
), volume AS (
  SELECT coalesce(max(events) FILTER (WHERE activity_date = DATE '2024-01-30'), 0) AS observed,
    median(events) FILTER (WHERE activity_date < DATE '2024-01-30') AS usual
  FROM daily
), copies AS (
  SELECT CAST(coalesce(sum(duplicate_copies), 0) AS BIGINT) AS copies,
    CAST(coalesce(sum(events), 0) AS BIGINT) AS events
  FROM activity WHERE activity_date > DATE '2024-01-30' - 1
)"""


def _tested(df: DataFrame) -> DataFrame:
    return df.drop("details")


@query(f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}, {SQL_ACTIVITY}, {SQL_VOLUME}
SELECT 'volume_anomaly' AS check_name, 'core.fct_account_activity_daily' AS target,
  CASE WHEN observed / usual BETWEEN 0.5 AND 1.5 THEN 'pass' ELSE 'fail' END AS status,
  observed / usual AS observed, CAST(0.5 AS DOUBLE) AS threshold FROM volume""")
def volume_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(checks.volume_anomaly(core.activity(spark, sf_dir), CTX))


@query(f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}, {SQL_ACTIVITY}, {SQL_VOLUME}
SELECT 'duplicate_rate' AS check_name, 'core.fct_account_activity_daily' AS target,
  CASE WHEN CAST(copies AS DOUBLE) / events <= 0.02 THEN 'pass' ELSE 'fail' END AS status,
  CAST(copies AS DOUBLE) / events AS observed, CAST(0.02 AS DOUBLE) AS threshold FROM copies""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate on 30 January."""
    ctx = CTX.with_(now=CTX.now.replace(day=30))
    return _tested(checks.duplicate_rate(core.activity(spark, sf_dir), ctx))


SQL_QUARANTINE_RATE = f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_INCREMENTAL}, held AS (
  SELECT count(*) AS n FROM raw_events
  WHERE source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY
    AND event_id NOT IN (SELECT event_id FROM merged)
    AND loaded_at > TIMESTAMP '2024-01-30'
), kept AS (
  SELECT count(*) AS n FROM merged WHERE loaded_at > TIMESTAMP '2024-01-30'
)"""


@query(f"""{SQL_QUARANTINE_RATE}
SELECT 'quarantine_rate' AS check_name, 'staging.stg_product_events' AS target,
  CASE WHEN CAST(held.n AS DOUBLE) / (held.n + kept.n) <= 0.01 THEN 'pass' ELSE 'fail' END
    AS status,
  CAST(held.n AS DOUBLE) / (held.n + kept.n) AS observed, CAST(0.01 AS DOUBLE) AS threshold
FROM held, kept""")
def quarantine_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = staging.merged(spark, sf_dir)
    held = staging_plans.quarantined(inputs.product_events(spark, sf_dir), merged, CTX)
    return _tested(checks.quarantine_rate(merged, held, CTX))


@query(f"""{SQL_STATE}
SELECT 'reverse_etl_error_rate' AS check_name, 'ops.reverse_etl_sync_state' AS target,
  CASE WHEN CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE)
    / count(*) FILTER (WHERE status <> 'skipped_client_error') <= 0.02 THEN 'pass' ELSE 'fail' END
    AS status,
  CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE)
    / count(*) FILTER (WHERE status <> 'skipped_client_error') AS observed,
  CAST(0.02 AS DOUBLE) AS threshold
FROM state""")
def reverse_etl_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(checks.reverse_etl_health(activation.sync_state(spark, sf_dir)))


@query(f"""WITH {SQL_EVENTS}, {SQL_SUBSCRIPTION_CHANGES}, {SQL_INVOICE_CHANGES}, {SQL_BILLING},
clocks AS (
  SELECT 'raw_product_events' AS layer, max(loaded_at) AS latest, 600 AS slo FROM raw_events
  WHERE source_path = 'live'
  UNION ALL SELECT 'raw_cdc', max(l_shipdate) + INTERVAL 8216 DAY + INTERVAL 1 HOUR, 300
  FROM lineitem
  UNION ALL SELECT 'raw_billing', max(received_at), 1800 FROM hooks
)
SELECT 'freshness' AS check_name, layer AS target,
  CASE WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(latest)) / 1e6 <= slo THEN 'pass'
    ELSE 'fail' END AS status,
  (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(latest)) / 1e6 AS observed,
  CAST(slo AS DOUBLE) AS threshold
FROM clocks""")
def layer_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the three raw layers on 1 February."""
    live = inputs.product_events(spark, sf_dir).where(F.col("source_path") == "live")
    layers = {
        "raw_product_events": live.select("loaded_at"),
        "raw_cdc": inputs.cdc_changes(spark, sf_dir).select("loaded_at"),
        "raw_billing": inputs.billing_webhooks(spark, sf_dir).select("received_at"),
    }
    slo = spark.createDataFrame(list(checks.FRESHNESS_SLO), checks.SLO_SCHEMA)
    later = CTX.with_(now=CTX.now.replace(month=2, day=1))
    return _tested(checks.freshness(layers, slo, later))


@query(f"""WITH {SQL_EVENTS}, {SQL_BILLING}, clocks AS (
  SELECT 'product_events' AS source, max(loaded_at) AS latest, 900 AS warn_seconds,
    3600 AS error_seconds FROM raw_events
  UNION ALL SELECT 'billing_webhook_events', max(received_at), 1800, 7200 FROM hooks
  UNION ALL SELECT 'billing_events_batch', max(pulled_at), 108000, 172800 FROM pulled
), aged AS (
  SELECT *, (epoch_us(TIMESTAMP '2024-02-04 23:30:00') - epoch_us(latest)) / 1e6 AS age_seconds
  FROM clocks
)
SELECT source, age_seconds, warn_seconds, error_seconds,
  CASE WHEN age_seconds > error_seconds THEN 'error' WHEN age_seconds > warn_seconds THEN 'warn'
    ELSE 'pass' END AS status
FROM aged""")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "product_events": inputs.product_events(spark, sf_dir).select("loaded_at"),
        "billing_webhook_events": inputs.billing_webhooks(spark, sf_dir).select("received_at"),
        "billing_events_batch": inputs.billing_batch(spark, sf_dir).select("pulled_at"),
    }
    later = CTX.with_(now=CTX.now.replace(month=2, day=4, hour=23, minute=30))
    return checks.source_freshness(sources, later)


@query(
    f"""SELECT date_day, plan_code, mrr_cents FROM ({SQL_MRR}) WHERE mrr_cents < 100000""",
    days="date_day",
)
def low_revenue_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range test of the revenue mart, with a bound that some days fail."""
    revenue = mart_plans.revenue_from_versions(core.subscriptions(spark, sf_dir), CTX)
    return checks.accepted_range(revenue, "mrr_cents", 100_000).select(
        "date_day", "plan_code", "mrr_cents"
    )


@query(f"""{SQL_STATE}, {SQL_INCREMENTAL}, {SQL_BILLING}, {SQL_VOLUME}, held AS (
  SELECT count(*) AS n FROM raw_events
  WHERE source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY
    AND event_id NOT IN (SELECT event_id FROM merged)
    AND loaded_at > TIMESTAMP '2024-01-30'
), kept AS (
  SELECT count(*) AS n FROM merged WHERE loaded_at > TIMESTAMP '2024-01-30'
), clocks AS (
  SELECT 'raw_product_events' AS layer, max(loaded_at) AS latest, 600 AS slo FROM raw_events
  WHERE source_path = 'live'
  UNION ALL SELECT 'raw_cdc', max(base_at + INTERVAL 13 HOUR
    + CASE WHEN o_totalprice > 400000 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END), 300
  FROM sub_rows
  UNION ALL SELECT 'raw_billing', max(received_at), 1800 FROM hooks
  UNION ALL SELECT 'staging', max(loaded_at), 3600 FROM merged
  UNION ALL SELECT 'marts', max(CAST(as_of_date AS TIMESTAMP)), 86400 FROM health
  UNION ALL SELECT 'reverse_etl', max(last_success_at), 86400 FROM state
)
SELECT 'quarantine_rate' AS check_name, 'staging.stg_product_events' AS target,
  CASE WHEN CAST(held.n AS DOUBLE) / (held.n + kept.n) <= 0.01 THEN 'pass' ELSE 'fail' END
    AS status FROM held, kept
UNION ALL SELECT 'volume_anomaly', 'core.fct_account_activity_daily',
  CASE WHEN observed / usual BETWEEN 0.5 AND 1.5 THEN 'pass' ELSE 'fail' END FROM volume
UNION ALL SELECT 'duplicate_rate', 'core.fct_account_activity_daily',
  CASE WHEN events = 0 OR CAST(copies AS DOUBLE) / events <= 0.02 THEN 'pass' ELSE 'fail' END
  FROM (SELECT CAST(coalesce(sum(duplicate_copies), 0) AS BIGINT) AS copies,
    CAST(coalesce(sum(events), 0) AS BIGINT) AS events FROM activity
    WHERE activity_date > DATE '2024-01-31' - 1)
UNION ALL SELECT 'reverse_etl_error_rate', 'ops.reverse_etl_sync_state',
  CASE WHEN CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE)
    / count(*) FILTER (WHERE status <> 'skipped_client_error') <= 0.02 THEN 'pass' ELSE 'fail' END
  FROM state
UNION ALL SELECT 'freshness', layer,
  CASE WHEN (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(latest)) / 1e6 <= slo THEN 'pass'
    ELSE 'fail' END FROM clocks""")
def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict of one run on 31 January, in the form the history keeps."""
    merged = staging.merged(spark, sf_dir)
    raw = inputs.product_events(spark, sf_dir)
    health, activity = kept(marts.health(spark, sf_dir)), kept(core.activity(spark, sf_dir))
    tables = {
        "product_events": raw,
        "cdc_changes": inputs.subscription_changes_raw(spark, sf_dir),
        "billing_webhook_events": inputs.billing_webhooks(spark, sf_dir),
        "stg_product_events": merged,
        "stg_product_events_quarantined": staging_plans.quarantined(raw, merged, CTX),
        "fct_account_activity_daily": activity,
        "mart_account_health": health,
        "reverse_etl_sync_state": activation.state_from(sync_payloads(health)),
    }
    slo = spark.createDataFrame(list(checks.FRESHNESS_SLO), checks.SLO_SCHEMA)
    return checks.run_checks(tables, slo, CTX).select("check_name", "target", "status")
