"""Core models: dimensions and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.functions import changed, surrogate_key
from tidemark.operators.history import flatten_intervals, scd2
from tidemark.operators.incremental import affected_keys, lookback, since

# Fixed values.
REQUIRED_FIELDS = {
    "dim_subscription": ("status", "plan_code", "seats", "mrr_cents", "effective_at"),
}

# Columns whose change opens a new version.
TRACKED = ("status", "plan_code", "seats", "mrr_cents")


def dim_date(spark: SparkSession, ctx: Context) -> DataFrame:
    """One row per day of the spine, which the run's context bounds."""
    days = F.sequence(F.lit(ctx.spine_start), F.lit(ctx.spine_end), F.expr("interval 1 day"))
    iso_day = (F.weekday("date_day") + 1).cast("int")
    return spark.range(1).select(F.explode(days).alias("date_day")).select(
        "date_day",
        iso_day.alias("day_of_week"),
        F.to_date(F.date_trunc("week", "date_day")).alias("week_start"),
        F.to_date(F.date_trunc("month", "date_day")).alias("month_start"),
        (iso_day >= 6).alias("is_weekend"),
    )


def _folded(changes: DataFrame, key: str, columns: Sequence[str], **history: Column) -> DataFrame:
    """Each key's latest state, beside aggregates over all its changes: one pass and one shuffle,
    combined before it. Keys whose latest change is a delete are left out."""
    state = F.max_by(F.struct("op", *columns), F.col("source_lsn")).alias("_state")
    return (
        changes.groupBy(key)
        .agg(state, *[c.alias(name) for name, c in history.items()])
        .where(F.col("_state.op") != "d")
        .select(key, *[f"_state.{c}" for c in columns], *history)
    )


def dim_account(account_changes: DataFrame) -> DataFrame:
    """Accounts as they are now. Deleted is true only for one deleted and inserted again."""
    return _folded(
        account_changes,
        "account_id",
        ["company_name", "country", "created_at", "effective_at", "is_snapshot"],
        deleted_at=F.min(F.when(F.col("op") == "d", F.col("effective_at"))),
    ).select(
        "account_id",
        "company_name",
        "country",
        "created_at",
        F.col("effective_at").alias("last_changed_at"),
        F.col("is_snapshot").alias("from_initial_snapshot"),
        "deleted_at",
        F.col("deleted_at").isNotNull().alias("is_deleted"),
    )


# What versions carry besides, under the names they are shown by.
_CARRIED = {
    "account_id": "account_id",
    "started_at": "started_at",
    "ended_at": "ended_at",
    "is_initial_snapshot": "is_snapshot",
    "source_ts": "source_ts",
    "source_path": "source_path",
}


def dim_subscription(
    subscription_changes: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Type-2 history of subscriptions, one row per version.

    Given ``columns``, only these are shown. Changes are written and sorted on the way, so what is not
    shown is left out before.
    """
    carried = [c for name, c in _CARRIED.items() if columns is None or name in columns]
    versions = scd2(
        subscription_changes.select(
            "subscription_id", "op", "source_lsn", "effective_at", *TRACKED, *carried
        ),
        "subscription_id",
        "source_lsn",
        "effective_at",
        TRACKED,
    )
    shown = {
        "subscription_version_key": surrogate_key("subscription_id", "source_lsn"),
        "is_initial_snapshot": F.col("is_snapshot"),
    }
    names = columns or (
        "subscription_version_key",
        "subscription_id",
        "account_id",
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        "started_at",
        "ended_at",
        "valid_from",
        "valid_to",
        "is_current",
        "ended_by_delete",
        "is_initial_snapshot",
        "source_lsn",
        "source_ts",
        "source_path",
    )
    return versions.select(*[shown.get(name, F.col(name)).alias(name) for name in names])


# What the daily fact takes from versions.
DAILY_COLUMNS = (
    "subscription_id",
    "account_id",
    "plan_code",
    "status",
    "seats",
    "mrr_cents",
    "is_initial_snapshot",
    "valid_from",
    "valid_to",
    "source_lsn",
)


def fct_subscription_daily(
    dim_subscription: DataFrame,
    ctx: Context,
    started: Column | None = None,
    days_as_text: bool = False,
) -> DataFrame:
    """One row per day and subscription, with the state it ended that day in.

    ``started`` is how a version's start is shown, its instant if not given. It is worked out per
    version, before versions are laid out on their days, of which each may have thousands. Days are
    dates, or text that is worked out once per day of the spine.
    """
    versions = dim_subscription.select(
        *DAILY_COLUMNS,
        (F.col("valid_from") if started is None else started).alias("version_started_at"),
    )
    daily = flatten_intervals(
        versions,
        "subscription_id",
        "source_lsn",
        ctx.spine_start,
        ctx.spine_end,
        as_text=days_as_text,
    )
    return daily.select(
        "date_day",
        "subscription_id",
        "account_id",
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        "is_initial_snapshot",
        "version_started_at",
    )


def daily_activity(events: DataFrame) -> DataFrame:
    """Usage per account and day the events happened on, over all given events."""
    return (
        events.withColumn("activity_date", F.to_date("event_time"))
        .where(F.col("account_id").isNotNull() & F.col("activity_date").isNotNull())
        .groupBy("account_id", "activity_date")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.countDistinct("user_id").alias("active_users"),
            F.countDistinct("feature").alias("distinct_features"),
            F.count_if(F.col("event_type") == "session_start").alias("sessions"),
            F.count_if(F.col("event_type") == "feature_invoked").alias("feature_invocations"),
            F.count_if("is_late_beyond_tolerance").alias("late_events"),
            F.sum("duplicate_copies").alias("duplicate_copies"),
            F.min("event_time").alias("first_event_at"),
            F.max("event_time").alias("last_event_at"),
            F.max("loaded_at").alias("last_loaded_at"),
        )
    )


def fct_account_activity_daily(
    staged: DataFrame,
    ctx: Context,
    built: DataFrame | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Daily usage per account. With ``built``, or the ``newest`` load it has counted, and no full
    refresh, only the reopened days.

    A late event reopens the day it happened on, and that day is counted again as a whole from all
    its events, so that a rerun cannot count anything twice.
    """
    if (built is None and newest is None) or ctx.full_refresh:
        return daily_activity(staged)
    days = ["account_id", "activity_date"]
    if newest is not None:
        recent = since(staged, newest, ctx.lookback_days)
    else:
        recent = lookback(staged, built, ctx.lookback_days, "loaded_at", "last_loaded_at")
    reopened = affected_keys(recent.withColumn("activity_date", F.to_date("event_time")), days)
    # Reopened days are few and recent. Their range, one row, becomes a literal that lets the scan
    # of all events skip everything outside it.
    span = reopened.agg(F.min("activity_date").alias("lo"), F.max("activity_date").alias("hi"))
    lo, hi = span.first()
    if lo is None:
        return daily_activity(staged.limit(0))
    near = staged.where(
        (F.col("event_time") >= F.lit(lo).cast("timestamp"))
        & (F.col("event_time") < F.date_add(F.lit(hi), 1).cast("timestamp"))
    )
    of_reopened = near.withColumn("activity_date", F.to_date("event_time")).join(
        reopened, days, "left_semi"
    )
    return daily_activity(of_reopened.drop("activity_date"))


def _into_failure() -> Column:
    return (F.col("status") == "payment_failed") & changed(
        "previous_status", F.lit("payment_failed")
    )


def invoice_failures(invoice_changes: DataFrame) -> DataFrame:
    """Transitions into failure per invoice, which the current state forgets."""
    return (
        invoice_changes.where(_into_failure())
        .groupBy("invoice_id")
        .agg(
            F.count(F.lit(1)).alias("failure_count"),
            F.max("effective_at").alias("last_failed_at"),
        )
    )


def fct_invoices(invoice_changes: DataFrame) -> DataFrame:
    """Invoices as they are now, with their failure history."""
    failed = _into_failure()
    return _folded(
        invoice_changes,
        "invoice_id",
        ["account_id", "provider_invoice_id", "amount_cents", "status", "issued_at", "paid_at"],
        failure_count=F.count_if(failed),
        last_failed_at=F.max(F.when(failed, F.col("effective_at"))),
    ).withColumn("is_paid", F.col("paid_at").isNotNull())
