"""Queries of the core layer and of the interval operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import inputs
from tidemark.catalog.inputs import (
    CTX,
    SQL_ACCOUNT_CHANGES,
    SQL_EVENTS,
    SQL_INVOICE_CHANGES,
    SQL_SUBSCRIPTION_CHANGES,
)
from tidemark.catalog.registry import query
from tidemark.catalog.staging import SQL_INCREMENTAL, SQL_STAGED, merged_by_day, staged
from tidemark.context import shared_folder
from tidemark.functions import at
from tidemark.operators.history import as_of, as_of_join, scd2
from tidemark.operators.incremental import affected_keys, lookback
from tidemark.plans import core, staging
from tidemark.plans.build import Layer

SQL_VERSIONS = """classified AS (
  SELECT *, lag(status) OVER w AS s0, lag(plan_code) OVER w AS p0, lag(seats) OVER w AS n0,
    lag(mrr_cents) OVER w AS m0
  FROM sub_changes WINDOW w AS (PARTITION BY subscription_id ORDER BY source_lsn)
), boundaries AS (
  SELECT * FROM classified
  WHERE op IN ('d', 'c', 'r') OR status IS DISTINCT FROM s0 OR plan_code IS DISTINCT FROM p0
    OR seats IS DISTINCT FROM n0 OR mrr_cents IS DISTINCT FROM m0
), opened AS (
  SELECT *, lead(effective_at) OVER w AS next_at, lead(op) OVER w AS next_op
  FROM boundaries WINDOW w AS (PARTITION BY subscription_id ORDER BY source_lsn)
), versions AS (
  SELECT md5(CAST(subscription_id AS VARCHAR) || '|' || CAST(source_lsn AS VARCHAR))
      AS subscription_version_key,
    subscription_id, account_id, plan_code, status, seats, mrr_cents, started_at, ended_at,
    effective_at AS valid_from, coalesce(next_at, TIMESTAMP '9999-12-31') AS valid_to,
    next_op IS NULL AS is_current, coalesce(next_op = 'd', false) AS ended_by_delete,
    is_snapshot AS is_initial_snapshot, source_lsn, source_ts, source_path
  FROM opened WHERE op <> 'd'
)"""

SQL_SUB_DAILY = """spine AS (
  SELECT CAST(unnest(generate_series(TIMESTAMP '2017-06-01', TIMESTAMP '2024-03-01',
    INTERVAL 1 DAY)) AS DATE) AS date_day
), sub_daily AS (
  SELECT d.date_day, s.subscription_id, s.account_id, s.plan_code, s.status, s.seats, s.mrr_cents,
    s.is_initial_snapshot, s.valid_from AS version_started_at
  FROM spine d JOIN versions s
    ON d.date_day >= CAST(s.valid_from AS DATE) AND d.date_day < CAST(s.valid_to AS DATE)
  QUALIFY row_number() OVER (PARTITION BY d.date_day, s.subscription_id
    ORDER BY s.valid_from DESC, s.source_lsn DESC) = 1
)"""

_ACTIVITY_COLUMNS = """count(*) AS events, count(DISTINCT user_id) AS active_users,
    count(DISTINCT feature) AS distinct_features,
    count(*) FILTER (WHERE event_type = 'session_start') AS sessions,
    count(*) FILTER (WHERE event_type = 'feature_invoked') AS feature_invocations,
    count(*) FILTER (WHERE loaded_at - event_time > INTERVAL 3 DAY) AS late_events,
    CAST(sum(duplicate_copies) AS BIGINT) AS duplicate_copies, min(event_time) AS first_event_at,
    max(event_time) AS last_event_at, max(loaded_at) AS last_loaded_at"""

SQL_ACTIVITY = f"""activity AS (
  SELECT account_id, CAST(event_time AS DATE) AS activity_date, {_ACTIVITY_COLUMNS}
  FROM staged WHERE account_id IS NOT NULL GROUP BY 1, 2
)"""

SQL_DIM_ACCOUNT = """dim_account AS (
  SELECT a.account_id, a.company_name, a.country, a.created_at,
    a.effective_at AS last_changed_at, a.is_snapshot AS from_initial_snapshot, d.deleted_at,
    d.account_id IS NOT NULL AS is_deleted
  FROM (
    SELECT * FROM acc_changes
    QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY source_lsn DESC) = 1
  ) a LEFT JOIN (
    SELECT account_id, min(effective_at) AS deleted_at FROM acc_changes WHERE op = 'd' GROUP BY 1
  ) d USING (account_id)
  WHERE a.op <> 'd'
)"""

SQL_INVOICES = """invoices AS (
  SELECT i.invoice_id, i.account_id, i.provider_invoice_id, i.amount_cents, i.status, i.issued_at,
    i.paid_at, coalesce(f.failure_count, 0) AS failure_count, f.last_failed_at,
    i.paid_at IS NOT NULL AS is_paid
  FROM (
    SELECT * FROM inv_changes
    QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY source_lsn DESC) = 1
  ) i LEFT JOIN (
    SELECT invoice_id, count(*) AS failure_count, max(effective_at) AS last_failed_at
    FROM inv_changes
    WHERE status = 'payment_failed' AND previous_status IS DISTINCT FROM 'payment_failed'
    GROUP BY 1
  ) f USING (invoice_id)
  WHERE i.op <> 'd'
)"""


def subscriptions(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    changes = staging.stg_subscription_changes(inputs.cdc_changes(spark, sf_dir, "subscriptions"))
    return core.dim_subscription(changes, columns)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.dim_account(staging.stg_account_changes(inputs.cdc_changes(spark, sf_dir, "accounts")))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.fct_account_activity_daily(staged(spark, sf_dir), CTX)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.fct_invoices(staging.stg_invoice_changes(inputs.cdc_changes(spark, sf_dir, "invoices")))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_support_ticket_changes(inputs.cdc_changes(spark, sf_dir, "support_tickets"))


@query(
    """SELECT CAST(d AS DATE) AS date_day, CAST(isodow(d) AS INTEGER) AS day_of_week,
  CAST(date_trunc('week', d) AS DATE) AS week_start,
  CAST(date_trunc('month', d) AS DATE) AS month_start, isodow(d) >= 6 AS is_weekend
FROM (
  SELECT unnest(generate_series(lo, hi + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS d
  FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)
)""",
    days="date_day week_start month_start",
)
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine from the first order to a month past the last."""
    span = inputs.table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))
    )
    first, last = span.first()
    newest = CTX.now.replace(year=last.year, month=last.month, day=last.day)
    return core.dim_date(spark, CTX.with_(spine_start=first, now=newest))


@query(
    f"WITH {SQL_ACCOUNT_CHANGES}, {SQL_DIM_ACCOUNT} SELECT * FROM dim_account",
    ts="created_at last_changed_at deleted_at",
)
def dim_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir)


@query(
    f"WITH {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS} SELECT * FROM versions",
    ts="started_at ended_at valid_from valid_to source_ts",
)
def dim_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark, sf_dir)


@query(
    f"WITH {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}, {SQL_SUB_DAILY} SELECT * FROM sub_daily",
    ts="version_started_at",
    days="date_day",
)
def fct_subscription_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.col("valid_from").cast("string")
    versions = subscriptions(spark, sf_dir, core.DAILY_COLUMNS)
    return core.fct_subscription_daily(versions, CTX, started, days_as_text=True)


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}, {SQL_ACTIVITY}
SELECT * FROM activity""",
    ts="first_event_at last_event_at last_loaded_at",
    days="activity_date",
)
def fct_account_activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir)


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_INCREMENTAL}, before AS (
  SELECT account_id, CAST(event_time AS DATE) AS activity_date, {_ACTIVITY_COLUMNS}
  FROM built WHERE account_id IS NOT NULL GROUP BY 1, 2
), reopened AS (
  SELECT DISTINCT account_id, CAST(event_time AS DATE) AS activity_date FROM merged
  WHERE loaded_at >= (SELECT max(last_loaded_at) FROM before) - INTERVAL 3 DAY
    AND account_id IS NOT NULL
), again AS (
  SELECT account_id, CAST(event_time AS DATE) AS activity_date, {_ACTIVITY_COLUMNS}
  FROM merged WHERE (account_id, CAST(event_time AS DATE)) IN (
    SELECT (account_id, activity_date) FROM reopened)
  GROUP BY 1, 2
)
SELECT * FROM before WHERE (account_id, activity_date) NOT IN (
  SELECT (account_id, activity_date) FROM reopened)
UNION ALL SELECT * FROM again""",
    ts="first_event_at last_event_at last_loaded_at",
    days="activity_date",
)
def fct_account_activity_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier build of the daily fact with the days reopened since put in place, on tables kept
    by day."""
    raw = inputs.product_events(spark, sf_dir)
    early = raw.where(F.col("loaded_at") < F.lit("2024-01-20").cast("timestamp"))
    before = staging.stg_product_events(early, inputs.account_changes_raw(spark, sf_dir), CTX)
    table = Layer(spark, f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}").activity()
    table.overwrite(core.fct_account_activity_daily(before, CTX), CTX)
    events = merged_by_day(spark, sf_dir).read()
    fresh = core.fct_account_activity_daily(events, CTX, newest=table.newest())
    return table.replace(fresh, CTX)


@query(
    f"""WITH {SQL_EVENTS}, {SQL_ACCOUNT_CHANGES}, {SQL_STAGED}
SELECT DISTINCT account_id, CAST(event_time AS DATE) AS activity_date FROM staged
WHERE account_id IS NOT NULL AND loaded_at >=
  (SELECT max(loaded_at) FROM staged WHERE loaded_at < TIMESTAMP '2024-01-20') - INTERVAL 3 DAY""",
    days="activity_date",
)
def reopened_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account days touched by what was loaded since a build on 20 January."""
    events = staged(spark, sf_dir)
    built = events.where(F.col("loaded_at") < F.lit("2024-01-20").cast("timestamp"))
    recent = lookback(events, built, CTX.lookback_days)
    return affected_keys(
        recent.withColumn("activity_date", F.to_date("event_time")),
        ["account_id", "activity_date"],
    )


@query(
    f"WITH {SQL_INVOICE_CHANGES}, {SQL_INVOICES} SELECT * FROM invoices",
    ts="issued_at paid_at last_failed_at",
)
def fct_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(spark, sf_dir)


@query(
    f"""WITH {SQL_INVOICE_CHANGES}
SELECT invoice_id, count(*) AS failure_count, max(effective_at) AS last_failed_at
FROM inv_changes
WHERE status = 'payment_failed' AND previous_status IS DISTINCT FROM 'payment_failed'
GROUP BY 1""",
    ts="last_failed_at",
)
def invoice_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.invoice_failures(
        staging.stg_invoice_changes(inputs.cdc_changes(spark, sf_dir, "invoices"))
    )


@query(
    f"""WITH {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}
SELECT subscription_id, status, seats, plan_code, valid_from FROM versions
WHERE TIMESTAMP '2024-01-31' >= valid_from AND TIMESTAMP '2024-01-31' < valid_to""",
    ts="valid_from",
)
def versions_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(subscriptions(spark, sf_dir), at(CTX.now)).select(
        "subscription_id", "status", "seats", "plan_code", "valid_from"
    )


@query(f"""WITH {SQL_EVENTS}, {SQL_SUBSCRIPTION_CHANGES}, {SQL_VERSIONS}
SELECT r.event_id, r.kafka_offset, r.account_id, v.plan_code, v.status
FROM raw_events r LEFT JOIN (
  SELECT r.kafka_offset, v.plan_code, v.status
  FROM raw_events r JOIN versions v ON v.subscription_id = r.account_id
    AND r.event_time >= v.valid_from AND r.event_time < v.valid_to
  QUALIFY row_number() OVER (PARTITION BY r.kafka_offset
    ORDER BY v.valid_from DESC, v.source_lsn DESC) = 1
) v ON v.kafka_offset = r.kafka_offset""")
def events_as_of_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the plan and status its account had when it happened."""
    facts = inputs.product_events(spark, sf_dir).select(
        "event_id", "kafka_offset", "account_id", "event_time"
    )
    versions = subscriptions(spark, sf_dir).drop("account_id").withColumnRenamed(
        "subscription_id", "account_id"
    )
    return as_of_join(
        facts,
        versions,
        "account_id",
        "event_time",
        "source_lsn",
        ["plan_code", "status"],
    ).drop("event_time")


@query(
    f"""WITH {SQL_ACCOUNT_CHANGES}, classified AS (
  SELECT *, lag(company_name) OVER w AS n0, lag(country) OVER w AS c0
  FROM acc_changes WINDOW w AS (PARTITION BY account_id ORDER BY source_lsn)
), boundaries AS (
  SELECT * FROM classified WHERE op IN ('d', 'c', 'r')
    OR company_name IS DISTINCT FROM n0 OR country IS DISTINCT FROM c0
), opened AS (
  SELECT *, lead(effective_at) OVER w AS next_at, lead(op) OVER w AS next_op
  FROM boundaries WINDOW w AS (PARTITION BY account_id ORDER BY source_lsn)
)
SELECT account_id, company_name, country, effective_at AS valid_from,
  coalesce(next_at, TIMESTAMP '9999-12-31') AS valid_to, next_op IS NULL AS is_current,
  coalesce(next_op = 'd', false) AS ended_by_delete
FROM opened WHERE op <> 'd'""",
    ts="valid_from valid_to",
)
def account_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type-2 history of accounts, by the same operator as that of subscriptions."""
    changes = staging.stg_account_changes(inputs.cdc_changes(spark, sf_dir, "accounts"))
    versions = scd2(
        changes,
        "account_id",
        "source_lsn",
        "effective_at",
        ["company_name", "country"],
    )
    return versions.select(
        "account_id",
        "company_name",
        "country",
        "valid_from",
        "valid_to",
        "is_current",
        "ended_by_delete",
    )
