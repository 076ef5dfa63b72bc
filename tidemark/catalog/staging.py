"""Queries of the staging layer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import inputs
from tidemark.catalog.inputs import (
    CTX,
    SQL_ACCOUNT_CHANGES,
    SQL_BILLING,
    SQL_EVENTS,
    SQL_INVOICE_CHANGES,
    SQL_SUBSCRIPTION_CHANGES,
    SQL_TICKET_CHANGES,
    SQL_USER_CHANGES,
)
from tidemark.catalog.registry import query
from tidemark.context import shared_folder
from tidemark.operators.changes import cdc_stream, current_rows
from tidemark.operators.incremental import lookback, replace_by_key
from tidemark.plans import ops, staging
from tidemark.plans.build import Layer
from tidemark.sources.days import DayTable

# What a build made before 20 January would hold.
BUILT_BEFORE = "2024-01-20"

SQL_STAGED = """ranked AS (
  SELECT *, count(*) OVER (PARTITION BY event_id) - 1 AS duplicate_copies
  FROM raw_events
  QUALIFY row_number() OVER (PARTITION BY event_id
    ORDER BY kafka_ts, topic, partition_id, kafka_offset) = 1
), staged AS (
  SELECT r.event_id, r.account_id, r.user_id, r.event_type, r.topic, r.event_time, r.received_at,
    r.kafka_ts, r.loaded_at, r.source_path, r.duplicate_copies,
    (epoch_us(r.received_at) - epoch_us(r.event_time)) / 1e6 AS client_lag_seconds,
    (epoch_us(r.loaded_at) - epoch_us(r.event_time)) / 1e6 AS load_lag_seconds,
    r.loaded_at - r.event_time > INTERVAL 3 DAY AS is_late_beyond_tolerance,
    r.feature, r.surface, r.plan, r.duration_ms
  FROM ranked r
  WHERE NOT EXISTS (SELECT 1 FROM account_exists a
    WHERE a.account_id = r.account_id AND r.event_time < a.created_at)
)"""

# An incremental run: rows of the lookback ranked among themselves, cut off, and put in place.
SQL_INCREMENTAL = """built AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY event_id) - 1 AS duplicate_copies
    FROM raw_events WHERE loaded_at < TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY event_id
      ORDER BY kafka_ts, topic, partition_id, kafka_offset) = 1
  ) r WHERE NOT EXISTS (SELECT 1 FROM account_exists a
    WHERE a.account_id = r.account_id AND r.event_time < a.created_at)
), fresh AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY event_id) - 1 AS duplicate_copies
    FROM raw_events
    WHERE loaded_at >= (SELECT max(loaded_at) FROM built) - INTERVAL 3 DAY
    QUALIFY row_number() OVER (PARTITION BY event_id
      ORDER BY kafka_ts, topic, partition_id, kafka_offset) = 1
  ) r WHERE NOT EXISTS (SELECT 1 FROM account_exists a
    WHERE a.account_id = r.account_id AND r.event_time < a.created_at)
    AND NOT (source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY)
), merged AS (
  SELECT * FROM built WHERE event_id NOT IN (SELECT event_id FROM fresh)
  UNION ALL SELECT * FROM fresh
)"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events staged in full, which absorbs late ones."""
    return staging.stg_product_events(
        inputs.product_events(spark, sf_dir), inputs.account_changes_raw(spark, sf_dir), CTX
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier build with one incremental run put in place, which holds late ones back."""
    raw = inputs.product_events(spark, sf_dir)
    accounts = inputs.account_changes_raw(spark, sf_dir)
    before = raw.where(F.col("loaded_at") < F.lit(BUILT_BEFORE).cast("timestamp"))
    built = staging.stg_product_events(before, accounts, CTX)
    fresh = staging.stg_product_events(raw, accounts, CTX, built)
    return replace_by_key(built, fresh, ["event_id"])


def merged_by_day(spark: SparkSession, sf_dir: str) -> DayTable:
    """The same by way of a table kept by day, of which the run rewrites the days it touches."""
    raw = inputs.product_events(spark, sf_dir)
    accounts = inputs.account_changes_raw(spark, sf_dir)
    before = raw.where(F.col("loaded_at") < F.lit(BUILT_BEFORE).cast("timestamp"))
    table = Layer(spark, f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}").events()
    table.overwrite(staging.stg_product_events(before, accounts, CTX), CTX)
    fresh = staging.stg_product_events(raw, accounts, CTX, newest=table.newest())
    table.replace(fresh, CTX)
    return table


@query(
    f"WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED} SELECT * FROM staged",
    ts="event_time received_at kafka_ts loaded_at",
)
def stg_product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).drop("payload")


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_INCREMENTAL}
SELECT event_id, account_id, event_type, event_time, loaded_at, source_path, duplicate_copies
FROM merged""",
    ts="event_time loaded_at",
)
def stg_product_events_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier build with an incremental run put in place, on a table kept by day."""
    return merged_by_day(spark, sf_dir).read().select(
        "event_id",
        "account_id",
        "event_type",
        "event_time",
        "loaded_at",
        "source_path",
        "duplicate_copies",
    )


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_INCREMENTAL}
SELECT event_id, account_id, event_type, topic, event_time, received_at, loaded_at, source_path,
  (epoch_us(loaded_at) - epoch_us(event_time)) / 1e6 / 86400 AS load_lag_days,
  CAST(event_time AS DATE) AS would_have_landed_on
FROM raw_events
WHERE source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY
  AND event_id NOT IN (SELECT event_id FROM merged)""",
    ts="event_time received_at loaded_at",
    days="would_have_landed_on",
)
def stg_product_events_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.quarantined(
        inputs.product_events(spark, sf_dir), merged(spark, sf_dir), CTX
    )


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_INCREMENTAL}
SELECT CAST(event_time AS DATE) AS would_have_landed_on, count(*) AS events,
  round(avg((epoch_us(loaded_at) - epoch_us(event_time)) / 1e6 / 86400), 1) AS avg_lag_days
FROM raw_events
WHERE source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY
  AND event_id NOT IN (SELECT event_id FROM merged)
GROUP BY 1""",
    days="would_have_landed_on",
)
def quarantine_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.quarantine_histogram(
        staging.quarantined(inputs.product_events(spark, sf_dir), merged(spark, sf_dir), CTX)
    )


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}
SELECT r.event_id, r.account_id, r.event_type, r.topic, r.event_time, r.loaded_at, r.source_path,
  a.created_at AS account_created_at, 'event predates account' AS reason
FROM raw_events r JOIN account_exists a ON a.account_id = r.account_id
WHERE r.event_time < a.created_at AND r.event_id NOT IN (SELECT event_id FROM staged)""",
    ts="event_time loaded_at account_created_at",
)
def stg_product_events_unreconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.unreconciled(
        inputs.product_events(spark, sf_dir),
        staged(spark, sf_dir),
        inputs.account_changes_raw(spark, sf_dir),
    )


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}
SELECT event_id, topic, partition_id, kafka_offset, kafka_ts, duplicate_copies FROM ranked""",
    ts="kafka_ts",
)
def first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.first_arrival(inputs.product_events(spark, sf_dir)).select(
        "event_id", "topic", "partition_id", "kafka_offset", "kafka_ts", "duplicate_copies"
    )


@query(f"""WITH {SQL_EVENTS}
SELECT event_id, kafka_offset, (epoch_us(received_at) - epoch_us(event_time)) / 1e6
    AS client_lag_seconds,
  (epoch_us(loaded_at) - epoch_us(event_time)) / 1e6 AS load_lag_seconds,
  loaded_at - event_time > INTERVAL 3 DAY AS is_late_beyond_tolerance
FROM raw_events""")
def event_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.with_lags(inputs.product_events(spark, sf_dir), CTX.lookback_days).select(
        "event_id",
        "kafka_offset",
        "client_lag_seconds",
        "load_lag_seconds",
        "is_late_beyond_tolerance",
    )


@query(f"""WITH {SQL_EVENTS}
SELECT event_id, kafka_offset FROM raw_events
WHERE loaded_at >= (SELECT max(loaded_at) FROM raw_events WHERE loaded_at < TIMESTAMP '2024-01-20')
  - INTERVAL 3 DAY""")
def lookback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run reads when everything before 20 January is built."""
    raw = inputs.product_events(spark, sf_dir)
    built = raw.where(F.col("loaded_at") < F.lit(BUILT_BEFORE).cast("timestamp"))
    return lookback(raw, built, CTX.lookback_days).select("event_id", "kafka_offset")


@query(f"""WITH {SQL_EVENTS}
SELECT event_id, kafka_offset, source_path FROM raw_events
WHERE NOT (source_path = 'live' AND loaded_at - event_time > INTERVAL 3 DAY)""")
def cutoff_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.apply_cutoff(inputs.product_events(spark, sf_dir), CTX.lookback_days).select(
        "event_id", "kafka_offset", "source_path"
    )


@query(f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}
SELECT event_id, kafka_offset, account_id FROM raw_events r
WHERE NOT EXISTS (SELECT 1 FROM account_exists a
  WHERE a.account_id = r.account_id AND r.event_time < a.created_at)""")
def events_not_predating(spark: SparkSession, sf_dir: str) -> DataFrame:
    exists = staging.account_exists(inputs.account_changes_raw(spark, sf_dir))
    return staging.drop_predating(inputs.product_events(spark, sf_dir), exists).select(
        "event_id", "kafka_offset", "account_id"
    )


@query(f"WITH {SQL_ACCOUNT_CHANGES} SELECT * FROM account_exists", ts="created_at")
def account_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.account_exists(inputs.account_changes_raw(spark, sf_dir))


# ------------------------------------------------------------------ the change log


@query(
    f"""WITH {SQL_SUBSCRIPTION_CHANGES}
SELECT CAST(subscription_id AS VARCHAR) AS pk, op, is_snapshot, source_lsn, source_ts,
  effective_at, loaded_at, source_path FROM sub_changes""",
    ts="source_ts effective_at loaded_at",
)
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table's changes out of the log of all, each commit once."""
    stream = cdc_stream(inputs.cdc_changes(spark, sf_dir), "subscriptions")
    return stream.drop("row_state", "before")


@query(
    f"""WITH {SQL_SUBSCRIPTION_CHANGES}
SELECT * FROM sub_changes""",
    ts="source_ts effective_at loaded_at started_at ended_at",
)
def stg_subscription_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_subscription_changes(inputs.cdc_changes(spark, sf_dir, "subscriptions"))


@query(
    f"""WITH {SQL_ACCOUNT_CHANGES} SELECT * FROM acc_changes""",
    ts="source_ts effective_at loaded_at created_at",
)
def stg_account_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_account_changes(inputs.cdc_changes(spark, sf_dir, "accounts"))


@query(
    f"""WITH {SQL_USER_CHANGES} SELECT * FROM user_changes""",
    ts="effective_at loaded_at last_login_at created_at",
)
def stg_user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_user_changes(inputs.cdc_changes(spark, sf_dir, "users"))


@query(
    f"""WITH {SQL_INVOICE_CHANGES} SELECT * FROM inv_changes""",
    ts="effective_at loaded_at issued_at paid_at",
)
def stg_invoice_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_invoice_changes(inputs.cdc_changes(spark, sf_dir, "invoices"))


@query(
    f"""WITH {SQL_EVENTS}, {SQL_TICKET_CHANGES} SELECT * FROM ticket_changes""",
    ts="effective_at loaded_at opened_at closed_at",
)
def stg_support_ticket_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_support_ticket_changes(inputs.cdc_changes(spark, sf_dir, "support_tickets"))


@query(f"""WITH {SQL_SUBSCRIPTION_CHANGES}
SELECT subscription_id, op, source_lsn, status, plan_code FROM (
  SELECT * FROM sub_changes
  QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY source_lsn DESC) = 1
) WHERE op <> 'd'""")
def current_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = staging.stg_subscription_changes(inputs.cdc_changes(spark, sf_dir, "subscriptions"))
    return current_rows(changes, "subscription_id").select(
        "subscription_id", "op", "source_lsn", "status", "plan_code"
    )


# ------------------------------------------------------------------ billing


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_billing_events(
        inputs.billing_webhooks(spark, sf_dir), inputs.billing_batch(spark, sf_dir)
    )


@query(
    f"WITH {SQL_BILLING} SELECT * FROM billing",
    ts="provider_created_at webhook_received_at batch_pulled_at",
)
def stg_billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_events(spark, sf_dir)


@query(f"WITH {SQL_BILLING} SELECT * FROM reconciliation", days="billing_day")
def stg_billing_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_billing_reconciliation(billing_events(spark, sf_dir))
