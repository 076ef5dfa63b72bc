"""Staging models: typed, deduplicated views of the raw layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.context import Context, kept
from tidemark.functions import json_record, safe_rate, seconds_between
from tidemark.operators.changes import changes_of, each_commit_once
from tidemark.operators.incremental import lookback, since

# Payload and row members the models below depend on; drift in them is blocking.
REQUIRED_FIELDS = {
    "stg_product_events": ("feature", "surface", "plan", "duration_ms"),
    "stg_subscription_changes": ("status", "plan_code", "seats", "mrr_cents"),
}

_LOG_COLUMNS = ("op", "source_lsn", "effective_at", "loaded_at")


def _typed(cdc_changes: DataFrame, table: str, key: str, state: str, **more: Column) -> DataFrame:
    """One source table's changes, each commit once: log columns, and typed members of the state.

    Members are taken out before redeliveries are compared, so that what is sorted and shuffled is
    the columns in use and not two JSON texts a row.
    """
    members = T.StructType.fromDDL(state)
    parsed = changes_of(cdc_changes, table).withColumn(
        "_row", json_record("row_state", *members.names)
    )
    typed = [F.col(f"_row.{m.name}").cast(m.dataType).alias(m.name) for m in members]
    log = [c for c in parsed.columns if c not in ("row_state", "before", "_row")]
    rows = parsed.select(*log, *typed, *[c.alias(name) for name, c in more.items()])
    return each_commit_once(rows).withColumn(key, F.col("pk").cast("bigint"))


def _previous_status() -> Column:
    """The transition, which the state afterwards no longer shows."""
    return json_record("before", "status")["status"]


def stg_subscription_changes(cdc_changes: DataFrame) -> DataFrame:
    return _typed(
        cdc_changes,
        "subscriptions",
        "subscription_id",
        "account_id BIGINT, plan_code STRING, status STRING, seats INT, mrr_cents INT, "
        "started_at TIMESTAMP, ended_at TIMESTAMP",
        previous_status=_previous_status(),
    ).select(
        "subscription_id",
        "op",
        "is_snapshot",
        "source_lsn",
        "source_ts",
        "effective_at",
        "loaded_at",
        "source_path",
        "account_id",
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        "started_at",
        "ended_at",
        "previous_status",
    )


def stg_account_changes(cdc_changes: DataFrame) -> DataFrame:
    state = "company_name STRING, country STRING, created_at TIMESTAMP"
    return _typed(cdc_changes, "accounts", "account_id", state).select(
        "account_id",
        "op",
        "is_snapshot",
        "source_lsn",
        "source_ts",
        "effective_at",
        "loaded_at",
        "company_name",
        "country",
        "created_at",
    )


def stg_user_changes(cdc_changes: DataFrame) -> DataFrame:
    state = "account_id BIGINT, role STRING, last_login_at TIMESTAMP, created_at TIMESTAMP"
    return _typed(cdc_changes, "users", "user_id", state).select(
        "user_id", *_LOG_COLUMNS, "account_id", "role", "last_login_at", "created_at"
    )


def stg_invoice_changes(cdc_changes: DataFrame) -> DataFrame:
    return _typed(
        cdc_changes,
        "invoices",
        "invoice_id",
        "account_id BIGINT, provider_invoice_id STRING, amount_cents INT, status STRING, "
        "issued_at TIMESTAMP, paid_at TIMESTAMP",
        previous_status=_previous_status(),
    ).select(
        "invoice_id",
        *_LOG_COLUMNS,
        "account_id",
        "provider_invoice_id",
        "amount_cents",
        "status",
        "issued_at",
        "paid_at",
        "previous_status",
    )


def stg_support_ticket_changes(cdc_changes: DataFrame) -> DataFrame:
    state = "account_id BIGINT, severity STRING, opened_at TIMESTAMP, closed_at TIMESTAMP"
    return _typed(cdc_changes, "support_tickets", "ticket_id", state).select(
        "ticket_id", *_LOG_COLUMNS, "account_id", "severity", "opened_at", "closed_at"
    )


def account_exists(cdc_changes: DataFrame) -> DataFrame:
    """Earliest creation time known per account, one row each."""
    rows = _typed(cdc_changes, "accounts", "account_id", "created_at TIMESTAMP")
    return (
        rows.where(F.col("created_at").isNotNull())
        .groupBy("account_id")
        .agg(F.min("created_at").alias("created_at"))
    )


def first_arrival(raw_events: DataFrame) -> DataFrame:
    """One row per event id, the first copy to arrive, with the number of further copies.

    Ids are counted alone, combined before the shuffle, and those that repeat are written. They are
    few, and where they are, Spark broadcasts them by the size of what was written: then rows of all
    other ids pass without being shuffled or sorted, and only repeated ones are compared by arrival.
    These are an aggregate rather than a window, so an id with very many copies does not gather them
    in one task.
    """
    columns = [c for c in raw_events.columns if c != "event_id"]
    arrival = F.struct("kafka_ts", "topic", "partition_id", "kafka_offset")
    further = (F.count(F.lit(1)) - 1).alias("duplicate_copies")
    copies = raw_events.groupBy("event_id").agg(further).where(F.col("duplicate_copies") > 0)
    repeated = kept(copies.select(F.col("event_id").alias("_id")))
    same = F.col("event_id").eqNullSafe(F.col("_id"))
    once = raw_events.join(repeated, same, "left_anti").select(
        "event_id", *columns, F.lit(0).cast("bigint").alias("duplicate_copies")
    )
    first = (
        raw_events.join(repeated, same, "left_semi")
        .groupBy("event_id")
        .agg(F.min_by(F.struct(*columns), arrival).alias("_first"), further)
        .select("event_id", "_first.*", "duplicate_copies")
    )
    return once.unionByName(first)


def _days(count: int):
    return F.expr(f"interval {int(count)} days")


def is_late(days: int):
    return (F.col("loaded_at") - F.col("event_time")) > _days(days)


def with_lags(events: DataFrame, tolerance_days: int) -> DataFrame:
    """How long the client held the event, and how old it was when loaded."""
    return events.withColumns(
        {
            "client_lag_seconds": seconds_between("event_time", "received_at"),
            "load_lag_seconds": seconds_between("event_time", "loaded_at"),
            "is_late_beyond_tolerance": is_late(tolerance_days),
        }
    )


def apply_cutoff(events: DataFrame, days: int) -> DataFrame:
    """Hold back live events loaded too long after they happened; replayed history is exempt."""
    return events.where(~((F.col("source_path") == "live") & is_late(days)))


def drop_predating(events: DataFrame, exists: DataFrame) -> DataFrame:
    """Drop events dated before their account existed. An unknown account proves nothing."""
    held = exists.select(
        F.col("account_id").alias("_account"), F.col("created_at").alias("_created")
    )
    contradiction = (F.col("account_id") == F.col("_account")) & (
        F.col("event_time") < F.col("_created")
    )
    return events.join(held, contradiction, "left_anti")


def stg_product_events(
    raw_events: DataFrame,
    cdc_changes: DataFrame,
    ctx: Context,
    built: DataFrame | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Typed events, one per id. With ``built``, or the ``newest`` instant built, and no full
    refresh, only the fresh rows of an incremental run, to be put in place by event id.

    An incremental run ranks and counts copies among the rows it looks back on.
    """
    incremental = (built is not None or newest is not None) and not ctx.full_refresh
    source = raw_events
    if incremental and newest is not None:
        source = since(raw_events, newest, ctx.lookback_days)
    elif incremental:
        source = lookback(raw_events, built, ctx.lookback_days)
    arrived = with_lags(first_arrival(source), ctx.lookback_days)
    dated = drop_predating(arrived, account_exists(cdc_changes))
    if incremental:
        dated = apply_cutoff(dated, ctx.lookback_days)
    payload = json_record("payload", "feature", "surface", "plan", "duration_ms")
    return dated.withColumn("_payload", payload).select(
        "event_id",
        "account_id",
        "user_id",
        "event_type",
        "topic",
        "event_time",
        "received_at",
        "kafka_ts",
        "loaded_at",
        "source_path",
        "duplicate_copies",
        "client_lag_seconds",
        "load_lag_seconds",
        "is_late_beyond_tolerance",
        "_payload.feature",
        "_payload.surface",
        "_payload.plan",
        F.col("_payload.duration_ms").cast("bigint").alias("duration_ms"),
        "payload",
    )


def quarantined(raw_events: DataFrame, staged: DataFrame, ctx: Context) -> DataFrame:
    """Live events beyond tolerance that are in fact absent from what was built, copy by copy."""
    late = raw_events.where((F.col("source_path") == "live") & is_late(ctx.lookback_days))
    return late.join(staged.select("event_id"), "event_id", "left_anti").select(
        "event_id",
        "account_id",
        "event_type",
        "topic",
        "event_time",
        "received_at",
        "loaded_at",
        "source_path",
        (seconds_between("event_time", "loaded_at") / F.lit(86400)).alias("load_lag_days"),
        F.to_date("event_time").alias("would_have_landed_on"),
    )


def unreconciled(raw_events: DataFrame, staged: DataFrame, cdc_changes: DataFrame) -> DataFrame:
    """Withheld events dated before their account was created; no refresh lets them in."""
    exists = account_exists(cdc_changes).withColumnRenamed("created_at", "account_created_at")
    contradicting = raw_events.join(exists, "account_id").where(
        F.col("event_time") < F.col("account_created_at")
    )
    return contradicting.join(staged.select("event_id"), "event_id", "left_anti").select(
        "event_id",
        "account_id",
        "event_type",
        "topic",
        "event_time",
        "loaded_at",
        "source_path",
        "account_created_at",
        F.lit("event predates account").alias("reason"),
    )


def stg_billing_events(webhooks: DataFrame, batch: DataFrame) -> DataFrame:
    """Both billing paths on the provider's id, with how each event arrived."""
    fast = webhooks.groupBy("provider_event_id").agg(
        F.min("event_type").alias("_type"),
        F.min("account_id").alias("_account"),
        F.min("provider_created_at").alias("_created"),
        F.min("received_at").alias("webhook_received_at"),
        F.count(F.lit(1)).alias("_deliveries"),
    )
    slow = batch.select(
        "provider_event_id",
        "event_type",
        "account_id",
        "provider_created_at",
        F.col("pulled_at").alias("batch_pulled_at"),
        "payload",
        F.lit(True).alias("_pulled"),
    )
    by_webhook, by_batch = F.col("_deliveries").isNotNull(), F.col("_pulled").isNotNull()
    return fast.join(slow, "provider_event_id", "full_outer").select(
        "provider_event_id",
        F.coalesce("_type", "event_type").alias("event_type"),
        F.coalesce("_account", "account_id").alias("account_id"),
        F.coalesce("_created", "provider_created_at").alias("provider_created_at"),
        "webhook_received_at",
        "batch_pulled_at",
        F.coalesce("_deliveries", F.lit(0).cast("bigint")).alias("webhook_deliveries"),
        F.when(by_webhook & by_batch, "both")
        .when(by_webhook, "webhook_only")
        .otherwise("batch_only")
        .alias("arrived_by"),
        (~by_webhook).alias("webhook_missed"),
        (~by_batch).alias("not_yet_reconciled"),
        "payload",
    )


def stg_billing_reconciliation(billing_events: DataFrame) -> DataFrame:
    """Per day, how many reconciled events the webhook path missed."""
    return (
        billing_events.where(~F.col("not_yet_reconciled"))
        .groupBy(F.to_date("provider_created_at").alias("billing_day"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("arrived_by") == "both").alias("both_paths"),
            F.count_if("webhook_missed").alias("webhook_missed"),
            F.count_if(F.col("webhook_deliveries") > 1).alias("duplicate_deliveries"),
        )
        .withColumn("webhook_miss_rate", safe_rate("webhook_missed", "events", 4))
    )
