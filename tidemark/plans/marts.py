"""Marts: revenue, activation and account health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.context import Context, kept
from tidemark.functions import day_start
from tidemark.operators.history import (
    day_stretches,
    interval_deltas,
    split_by_overlap,
    won_stretches,
)

REQUIRED_FIELDS = {
    "mart_account_health": ("churn_score", "churn_band", "score_version", "reasons"),
}

# The scoring rules' version and window.
SCORE_VERSION = "rules-v1"
WINDOW_DAYS = 28

# Statuses that pay.
PAYING = ("active", "past_due")

_MRR_SUMS = {
    "paying_subscriptions": "paying",
    "trial_subscriptions": "trial",
    "past_due_subscriptions": "past_due",
    "cancelled_subscriptions": "cancelled",
}


def mart_revenue_mrr(subscription_daily: DataFrame) -> DataFrame:
    """Recurring revenue and subscription counts per day and plan, from the daily fact."""
    return subscription_daily.groupBy("date_day", "plan_code").agg(*_mrr_aggregates())


def _mrr_aggregates() -> list[Column]:
    paying = F.col("status").isin(*PAYING)
    return [
        F.count_if(paying).alias("paying_subscriptions"),
        F.count_if(F.col("status") == "trial").alias("trial_subscriptions"),
        F.count_if(F.col("status") == "past_due").alias("past_due_subscriptions"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_subscriptions"),
        F.sum(F.when(paying, F.col("mrr_cents"))).alias("mrr_cents"),
        F.sum(F.when(paying, F.col("seats"))).alias("paid_seats"),
        F.bool_and("is_initial_snapshot").alias("all_from_initial_snapshot"),
    ]


def revenue_through_days(dim_subscription: DataFrame, ctx: Context) -> DataFrame:
    """The same mart through every day of every version, as the daily fact has them.

    The mart's measures are sums, so versions that hold the same plan from the same first to the
    same last day are summed before they are laid out on these days. There are as many such
    stretches as pairs of days at most, however many subscriptions there are.
    """
    stretches = day_stretches(
        dim_subscription.select(
            "subscription_id",
            "plan_code",
            "status",
            "seats",
            "mrr_cents",
            "is_initial_snapshot",
            "valid_from",
            "valid_to",
            "source_lsn",
        ),
        "subscription_id",
        "source_lsn",
        ctx.spine_start,
        ctx.spine_end,
    )
    summed = stretches.groupBy("plan_code", "first_day", "last_day").agg(*_mrr_aggregates())
    days = F.sequence("first_day", "last_day", F.expr("interval 1 day"))
    daily = summed.withColumn("date_day", F.explode(days))
    sums = [*_MRR_SUMS, "mrr_cents", "paid_seats"]
    return daily.groupBy("date_day", "plan_code").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.bool_and("all_from_initial_snapshot").alias("all_from_initial_snapshot"),
    )


def revenue_from_versions(dim_subscription: DataFrame, ctx: Context) -> DataFrame:
    """The same mart straight from versions, without a row per subscription and day.

    Every measure is a count or a sum, so a version only matters on the day it starts to count and
    the day it stops: what is shuffled is a partial sum per day and plan, however many
    subscriptions there are. Versions of keys that may hold two states on one day enter as the
    stretches of days on which they count.
    """
    versions = dim_subscription.select(
        "subscription_id",
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        "is_initial_snapshot",
        "valid_from",
        "valid_to",
        "source_lsn",
    )
    key, order = "subscription_id", "source_lsn"
    alone, shared = split_by_overlap(versions, key, order)
    won = won_stretches(shared, key, order, ctx.spine_start, ctx.spine_end).withColumns(
        {
            "valid_from": day_start("first_day"),
            "valid_to": day_start(F.date_add("last_day", 1)),
        }
    )
    intervals = alone.unionByName(won.drop("first_day", "last_day"))
    levels = interval_deltas(
        intervals, ["plan_code"], _mrr_measures(), ctx.spine_start, ctx.spine_end
    )
    return levels.where(F.col("rows_here") > 0).select(
        "date_day",
        "plan_code",
        *[F.col(source).alias(name) for name, source in _MRR_SUMS.items()],
        F.when(F.col("mrr_rows") > 0, F.col("mrr")).alias("mrr_cents"),
        F.when(F.col("seat_rows") > 0, F.col("seats_paid")).alias("paid_seats"),
        (F.col("not_snapshot") == 0).alias("all_from_initial_snapshot"),
    )


def _mrr_measures() -> dict[str, Column]:
    paying = F.coalesce(F.col("status").isin(*PAYING), F.lit(False))

    def one_if(condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0).cast("bigint")

    def amount_if(condition: Column, column: str) -> Column:
        value = F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))
        return F.when(condition, value).otherwise(F.lit(0).cast("bigint"))

    return {
        "rows_here": F.lit(1).cast("bigint"),
        "paying": one_if(paying),
        "trial": one_if(F.col("status") == "trial"),
        "past_due": one_if(F.col("status") == "past_due"),
        "cancelled": one_if(F.col("status") == "cancelled"),
        "mrr": amount_if(paying, "mrr_cents"),
        "mrr_rows": one_if(paying & F.col("mrr_cents").isNotNull()),
        "seats_paid": amount_if(paying, "seats"),
        "seat_rows": one_if(paying & F.col("seats").isNotNull()),
        "not_snapshot": one_if(~F.col("is_initial_snapshot")),
    }


def first_feature_use(activity: DataFrame) -> DataFrame:
    return (
        activity.where(F.col("feature_invocations") > 0)
        .groupBy("account_id")
        .agg(F.min("activity_date").alias("first_active_date"))
    )


def first_active_subscription(dim_subscription: DataFrame) -> DataFrame:
    return (
        dim_subscription.where(F.col("status") == "active")
        .groupBy("account_id")
        .agg(F.min("valid_from").alias("first_active_subscription_at"))
    )


def mart_activation_funnel(
    dim_account: DataFrame, activity: DataFrame, dim_subscription: DataFrame
) -> DataFrame:
    """Signup cohorts by week: who used the product, and who converted."""
    accounts = dim_account.where(~F.col("from_initial_snapshot")).select(
        "account_id",
        "created_at",
        F.to_date(F.date_trunc("week", "created_at")).alias("cohort_week"),
    )
    active_by = F.to_date(F.col("created_at") + F.expr("interval 14 days"))
    paid_by = F.col("created_at") + F.expr("interval 30 days")
    return (
        accounts.join(first_feature_use(activity), "account_id", "left")
        .join(first_active_subscription(dim_subscription), "account_id", "left")
        .groupBy("cohort_week")
        .agg(
            F.count(F.lit(1)).alias("signups"),
            F.count("first_active_date").alias("ever_active"),
            F.count_if(F.col("first_active_date") <= active_by).alias("activated_within_14d"),
            F.count("first_active_subscription_at").alias("ever_converted"),
            F.count_if(F.col("first_active_subscription_at") <= paid_by).alias(
                "converted_within_30d"
            ),
        )
    )


def reference_date(activity: DataFrame, ctx: Context) -> DataFrame:
    """One row: the newest day with activity, the run's own day where there is none."""
    return activity.agg(
        F.coalesce(F.max("activity_date"), F.lit(ctx.today)).alias("as_of_date")
    )


def subscription_rollup(dim_subscription: DataFrame) -> DataFrame:
    """Per account: what its current versions say, and the status of its latest version."""
    current = F.col("is_current")
    return dim_subscription.groupBy("account_id").agg(
        F.max(F.when(current, F.col("mrr_cents"))).alias("mrr_cents"),
        F.max(F.when(current, F.col("seats"))).alias("seats"),
        # Equal starts are decided by key and log position, so that a rerun agrees with itself.
        F.max_by("status", F.struct("valid_from", "source_lsn", "subscription_id")).alias(
            "subscription_status"
        ),
        F.bool_or((F.col("status") == "past_due") & current).alias("is_past_due"),
        F.bool_or((F.col("status") == "cancelled") & current).alias("is_cancelled"),
    )


def usage_windows(activity: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per account: the last window and the one before it, in one pass over the daily fact."""
    day, today = F.col("activity_date"), as_of.scalar()
    recent = F.col("_recent")
    return (
        activity.where(day > F.date_sub(today, 2 * WINDOW_DAYS))
        .withColumn("_recent", day > F.date_sub(today, WINDOW_DAYS))
        .groupBy("account_id")
        .agg(
            F.sum(F.when(recent, F.col("events"))).alias("events_recent"),
            F.max(F.when(recent, F.col("active_users"))).alias("peak_active_users_recent"),
            F.max(F.when(recent, day)).alias("last_active_date"),
            F.sum(F.when(recent, F.col("feature_invocations"))).alias(
                "feature_invocations_recent"
            ),
            F.sum(F.when(~recent, F.col("events"))).alias("events_prior"),
        )
    )


def payment_rollup(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("account_id").agg(
        F.sum("failure_count").alias("payment_failures"),
        F.count_if(F.col("status") == "payment_failed").alias("unpaid_invoices"),
    )


def ticket_rollup(ticket_changes: DataFrame, as_of: DataFrame) -> DataFrame:
    """Recent tickets per account. Every change but a delete counts, as the score defines it."""
    since = day_start(F.date_sub(as_of.scalar(), WINDOW_DAYS))
    return (
        ticket_changes.where((F.col("op") != "d") & (F.col("opened_at") > since))
        .groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("tickets_recent"),
            F.count_if(F.col("severity") == "high").alias("high_severity_recent"),
        )
    )


def usage_drop_points(recent: Column, prior: Column) -> Column:
    """35 / 25 / 12 for gone, below 0.4, below 0.7 of the prior window."""
    return (
        F.when(prior == 0, 0)
        .when(recent == 0, 35)
        .when(10 * recent < 4 * prior, 25)
        .when(10 * recent < 7 * prior, 12)
        .otherwise(0)
    )


def dormancy_points(days: Column) -> Column:
    """20 / 12 / 5 beyond 21, 14 and 7 days; never active counts as longest."""
    return (
        F.when(days.isNull(), 20)
        .when(days > 21, 20)
        .when(days > 14, 12)
        .when(days > 7, 5)
        .otherwise(0)
    )


def seat_points(active: Column, seats: Column) -> Column:
    """15 / 8 below a fifth and a half of the seats; none without seats."""
    return (
        F.when(seats.isNull() | (seats == 0), 0)
        .when(5 * active < seats, 15)
        .when(2 * active < seats, 8)
        .otherwise(0)
    )


def churn_band(score: Column, cancelled: Column) -> Column:
    """Bands from 60, 35 and 15; a cancelled account is churned whatever its score."""
    return (
        F.when(cancelled, "churned")
        .when(score >= 60, "critical")
        .when(score >= 35, "high")
        .when(score >= 15, "medium")
        .otherwise("low")
    )


def ranked_reasons(named_points: Sequence[tuple[str, Column]]) -> Column:
    """Names whose points are positive, most points first, ties in the order given."""
    entries = F.array(
        *[
            F.struct((-points).alias("weight"), F.lit(i).alias("place"), F.lit(name).alias("name"))
            for i, (name, points) in enumerate(named_points)
        ]
    )
    given = F.array_sort(F.filter(entries, lambda e: e["weight"] < 0))
    return F.transform(given, lambda e: e["name"])


def assemble_health(
    dim_account: DataFrame,
    dim_subscription: DataFrame,
    activity: DataFrame,
    invoices: DataFrame,
    ticket_changes: DataFrame,
    ctx: Context,
) -> DataFrame:
    """Every live account beside its signals. All joined sides have one row per account.

    The daily fact is read for its newest day, its windows and the tickets of these days. It is
    written first, so events are staged once for all of them.
    """
    activity = kept(activity)
    as_of = reference_date(activity, ctx)
    zero = F.lit(0).cast("bigint")
    joined = (
        dim_account.where(~F.col("is_deleted"))
        .select("account_id", "company_name", as_of.scalar().alias("as_of_date"))
        .join(subscription_rollup(dim_subscription), "account_id", "left")
        .join(usage_windows(activity, as_of), "account_id", "left")
        .join(payment_rollup(invoices), "account_id", "left")
        .join(ticket_rollup(ticket_changes, as_of), "account_id", "left")
    )
    active = F.coalesce("peak_active_users_recent", zero)
    seats = F.col("seats")
    return joined.select(
        "account_id",
        "company_name",
        "as_of_date",
        "subscription_status",
        "mrr_cents",
        "seats",
        F.coalesce("events_recent", zero).alias("events_recent"),
        F.coalesce("events_prior", zero).alias("events_prior"),
        "last_active_date",
        F.datediff("as_of_date", "last_active_date").alias("days_since_active"),
        active.alias("active_users"),
        F.coalesce("payment_failures", zero).alias("payment_failures"),
        F.coalesce("tickets_recent", zero).alias("tickets_recent"),
        F.coalesce("high_severity_recent", zero).alias("high_severity_tickets"),
        F.coalesce("is_past_due", F.lit(False)).alias("is_past_due"),
        F.coalesce("is_cancelled", F.lit(False)).alias("is_cancelled"),
        F.when(seats != 0, active.cast("double") / seats).alias("seat_utilisation"),
    )


def mart_account_health(
    dim_account: DataFrame,
    dim_subscription: DataFrame,
    activity: DataFrame,
    invoices: DataFrame,
    ticket_changes: DataFrame,
    ctx: Context,
) -> DataFrame:
    """Churn risk per live account: score, band, rules version, and the reasons for the score."""
    assembled = assemble_health(
        dim_account, dim_subscription, activity, invoices, ticket_changes, ctx
    )
    support = 6 * F.col("high_severity_tickets") + 2 * F.col("tickets_recent")
    scored = assembled.withColumns(
        {
            "usage_drop": usage_drop_points(F.col("events_recent"), F.col("events_prior")),
            "dormant": dormancy_points(F.col("days_since_active")),
            "seats_unused": seat_points(F.col("active_users"), F.col("seats")),
            # Weights and caps of the remaining components.
            "payment_failures_points": F.least(8 * F.col("payment_failures"), F.lit(20)),
            "support_load": F.least(support, F.lit(15)),
            "past_due": F.when(F.col("is_past_due"), 10).otherwise(0),
        }
    )
    components = (
        ("usage_drop", F.col("usage_drop")),
        ("dormant", F.col("dormant")),
        ("seats_unused", F.col("seats_unused")),
        ("payment_failures", F.col("payment_failures_points")),
        ("support_load", F.col("support_load")),
        ("past_due", F.col("past_due")),
    )
    total = F.lit(0).cast("bigint")
    for _, points in components:
        total = total + points
    return scored.withColumn("churn_score", F.least(total, F.lit(100).cast("bigint"))).select(
        "account_id",
        "company_name",
        "as_of_date",
        "subscription_status",
        "mrr_cents",
        "seats",
        "seat_utilisation",
        "events_recent",
        "events_prior",
        "days_since_active",
        "payment_failures",
        "tickets_recent",
        "churn_score",
        churn_band(F.col("churn_score"), F.col("is_cancelled")).alias("churn_band"),
        F.lit(SCORE_VERSION).alias("score_version"),
        ranked_reasons(components).alias("reasons"),
    )
