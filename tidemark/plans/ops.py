"""Operational reads: latest verdicts, gauges, load activity, windows, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context, kept
from tidemark.functions import at
from tidemark.operators.latest import first_per, latest_per
from tidemark.operators.ordered import Sliced
from tidemark.sources.log import latest_attempts

# Verdicts as numbers, an unknown one counting as failed.
STATUS_VALUE = {"pass": 0, "warn": 1, "fail": 2}
# Fixed value: seconds reported when no change was ever loaded.
NEVER_SECONDS = 1e9
# How long a scenario's window may stay open, in minutes; 30 where not named.
WINDOW_MINUTES = {"connector_outage": 45, "poison_message": 15}
DEFAULT_WINDOW_MINUTES = 30

# Alert rules as (alert, metric, comparison, threshold, held for seconds, severity,
# guard metric that must be above zero, metric holding the threshold per layer, labels the metric
# is reduced to by its maximum).
ALERT_RULES = (
    ("ConsumerLagHigh", "redpanda_kafka_consumer_group_lag_max", ">", 6000.0, 600, "warning",
     None, None, ["group", "topic"]),
    ("LoaderStalled", "analytics_seconds_since_last_load", ">", 900.0, 300, "critical",
     None, None, None),
    ("CdcStalled", "analytics_seconds_since_last_cdc_change", ">", 600.0, 300, "critical",
     "analytics_oltp_writes_per_minute", None, None),
    ("SlotWalRetainedWarning", "pg_replication_slots_pg_wal_lsn_diff", ">", 2e9, 300, "warning",
     None, None, None),
    ("SlotWalRetainedCritical", "pg_replication_slots_pg_wal_lsn_diff", ">", 4e9, 120, "critical",
     None, None, None),
    ("CdcGapOpen", "analytics_cdc_gap_open", ">", 0.0, 0, "warning", None, None, None),
    ("FreshnessSloBreach", "analytics_freshness_seconds", ">", None, 600, "warning",
     None, "analytics_freshness_slo_seconds", None),
    ("DqCheckFailing", "analytics_dq_check_status", "=", 2.0, 900, "warning", None, None, None),
    ("QuarantineRateHigh", "analytics_quarantine_rate", ">", 0.01, 3600, "warning",
     None, None, None),
    ("DriftBlocking", "analytics_drift_blocking_models", ">", 0.0, 0, "critical",
     None, None, None),
    ("DagFailure", "airflow_dagrun_failed_total", "increase", 0.0, 0, "warning",
     None, None, None),
    ("ReverseEtlErrorRate", "analytics_reverse_etl_error_rate", ">", 0.02, 600, "warning",
     None, None, None),
    ("BillingWebhookMissRateHigh", "analytics_billing_webhook_miss_rate", ">", 0.25, 1800,
     "warning", None, None, None),
    ("ChaosWindowOpen", "analytics_chaos_window_active", ">", 0.0, 0, "info", None, None, None),
)
RULE_SCHEMA = (
    "alert STRING, metric STRING, comparison STRING, threshold DOUBLE, held_seconds BIGINT, "
    "severity STRING, guard STRING, threshold_metric STRING, by_labels ARRAY<STRING>"
)
# Fixed value: seconds an increase is measured over.
INCREASE_SECONDS = 600
# The marker that mutes paging, what it mutes, and a critical alert that mutes the
# warning about the same label.
WINDOW_MARKER = "ChaosWindowOpen"
PAGING_SEVERITIES = ("warning", "critical")
WEAKER, STRONGER, SHARED_LABEL = (
    "SlotWalRetainedWarning",
    "SlotWalRetainedCritical",
    "slot_name",
)


# ------------------------------------------------------------------ latest verdicts


def latest_checks(dq_results: DataFrame) -> DataFrame:
    """Last verdict per check and target as a number; verdicts of the same instant all stay."""
    value = F.lit(2)
    for name, number in STATUS_VALUE.items():
        value = F.when(F.col("status") == name, number).otherwise(value)
    return latest_per(
        dq_results, ["check_name", "target"], ["checked_at"], keep_ties=True
    ).select("check_name", "target", "status", value.alias("status_value"), "checked_at")


def freshness_vs_slo(dq_results: DataFrame, slo: DataFrame) -> DataFrame:
    """Last observed age per layer beside its target."""
    newest = latest_per(
        dq_results.where(F.col("check_name") == "freshness"),
        ["target"],
        ["checked_at"],
        keep_ties=True,
    )
    return newest.join(slo, newest["target"] == slo["layer"]).select(
        "layer",
        F.col("observed").alias("age_seconds"),
        "target_seconds",
        (F.col("observed") - F.col("target_seconds")).alias("breach_seconds"),
        "status",
        "checked_at",
    )


# ------------------------------------------------------------------ loads


def load_activity(ledger: DataFrame, ctx: Context) -> DataFrame:
    """Per topic: last load, rows of the last hour, dead letters of the last day."""
    created = F.col("created_at")
    hour_ago = at(ctx.now) - F.expr("interval 1 hour")
    day_ago = at(ctx.now) - F.expr("interval 1 day")
    return latest_attempts(ledger).groupBy("topic").agg(
        F.max("created_at").alias("last_load_at"),
        F.sum(F.when(created > hour_ago, F.col("row_count"))).alias("rows_last_hour"),
        F.sum(F.when(created > day_ago, F.col("dlq_count"))).alias("dlq_last_day"),
    )


def _seconds_since(newest: Column, ctx: Context) -> Column:
    return (F.unix_micros(at(ctx.now)) - F.unix_micros(newest)) / F.lit(1e6)


def seconds_since_last_load(ledger: DataFrame, ctx: Context) -> DataFrame:
    return ledger.groupBy("topic").agg(
        _seconds_since(F.max("created_at"), ctx).alias("seconds_since_last_load")
    )


def cdc_activity(cdc_changes: DataFrame, ctx: Context) -> DataFrame:
    """Seconds since a change was loaded, and source writes per minute over five minutes."""
    recent = F.col("source_ts") > at(ctx.now) - F.expr("interval 5 minutes")
    return cdc_changes.agg(
        F.coalesce(_seconds_since(F.max("loaded_at"), ctx), F.lit(NEVER_SECONDS)).alias(
            "seconds_since_last_cdc_change"
        ),
        (F.count_if(recent) / F.lit(5.0)).alias("oltp_writes_per_minute"),
    )


def dlq_by_reason(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def ledger_audit(ledger: DataFrame) -> DataFrame:
    """Entries whose range length is not the sum of what became of its records."""
    accounted = (
        F.col("row_count") + F.col("dlq_count") + F.col("erased_count") + F.col("skipped_count")
    )
    return (
        latest_attempts(ledger)
        .withColumn("range_length", F.col("end_offset") - F.col("start_offset"))
        .withColumn("accounted", accounted)
        .where(F.col("range_length") != F.col("accounted"))
    )


def quarantine_histogram(held: DataFrame) -> DataFrame:
    """Held events per day they would have landed on, with their mean lag in days."""
    return held.groupBy("would_have_landed_on").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.avg("load_lag_days"), 1).alias("avg_lag_days"),
    )


# ------------------------------------------------------------------ gauges and lists


def platform_gauges(tables: dict[str, DataFrame], ctx: Context) -> DataFrame:
    """The platform's one-number gauges, one row each."""
    day_ago = at(ctx.now) - F.expr("interval 1 day")
    results = tables["dq_results"].where(F.col("checked_at") > day_ago)

    def gauge(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(
            F.lit(name).alias("gauge"), "value"
        )

    def worst(check: str) -> DataFrame:
        return results.where(F.col("check_name") == check)

    week = F.date_sub(F.lit(ctx.today), 7)
    rows = F.count(F.lit(1))
    gauges = [
        gauge("quarantine_rate", worst("quarantine_rate"), F.max("observed")),
        gauge("reverse_etl_error_rate", worst("reverse_etl_error_rate"), F.max("observed")),
        gauge("cdc_gap_open", tables["cdc_gaps"].where(F.col("resolved_at").isNull()), rows),
        gauge("chaos_window_active", tables["windows"].where(F.col("closed_at").isNull()), rows),
        gauge(
            "drift_blocking_models",
            tables["drift_findings"].where(F.col("resolved_at").isNull() & F.col("blocking")),
            rows,
        ),
        gauge(
            "billing_webhook_miss_rate",
            tables["stg_billing_reconciliation"].where(F.col("billing_day") > week),
            F.avg(F.col("webhook_miss_rate").cast("double")),
        ),
    ]
    return reduce(DataFrame.unionByName, gauges)


def open_drift_findings(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Open findings, blocking ones first, then newest. Equal instants go by type and path."""
    return (
        findings.where(F.col("resolved_at").isNull())
        .orderBy(F.desc("blocking"), F.desc("detected_at"), "event_type", "json_path")
        .limit(limit)
        .select("event_type", "json_path", "change", "blocking", "detected_at")
    )


def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """Newest subscription per account by business time."""
    return first_per(
        subscriptions, ["account_id"], [F.desc("effective_at"), F.desc("source_lsn")]
    )


def account_directory(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every account with its newest plan and seats, free with two seats where it has none."""
    newest = latest_subscription(subscriptions).select("account_id", "plan_code", "seats")
    return (
        accounts.select("account_id")
        .join(newest, "account_id", "left")
        .select(
            "account_id",
            F.coalesce("plan_code", F.lit("free")).alias("plan_code"),
            F.coalesce("seats", F.lit(2)).alias("seats"),
        )
    )


def top_accounts(
    accounts: DataFrame, health: DataFrame, subscriptions: DataFrame, limit: int = 50
) -> DataFrame:
    """Riskiest accounts, unscored ones last.

    The list is cut before the subscription lookup, so that join sees only the accounts shown.
    """
    scored = accounts.select("account_id", "company_name").join(
        health.select("account_id", "churn_band", "churn_score"), "account_id", "left"
    )
    shown = scored.orderBy(F.desc_nulls_last("churn_score"), "account_id").limit(limit)
    newest = latest_subscription(
        subscriptions.join(shown.select("account_id"), "account_id", "left_semi")
    ).select("account_id", "status")
    return shown.join(newest, "account_id", "left").orderBy(
        F.desc_nulls_last("churn_score"), "account_id"
    )


# ------------------------------------------------------------------ windows


def _allowed_minutes() -> Column:
    allowed = F.lit(DEFAULT_WINDOW_MINUTES)
    for scenario, minutes in WINDOW_MINUTES.items():
        allowed = F.when(F.col("scenario") == scenario, minutes).otherwise(allowed)
    return allowed


def open_windows(windows: DataFrame) -> DataFrame:
    return windows.where(F.col("closed_at").isNull()).select("scenario", "opened_at", "opened_by")


def expire_windows(windows: DataFrame, ctx: Context) -> DataFrame:
    """Windows nobody closed in time, closed now."""
    over = F.col("closed_at").isNull() & (
        F.unix_micros(at(ctx.now)) - F.unix_micros("opened_at")
        > _allowed_minutes() * F.lit(60_000_000).cast("bigint")
    )
    return windows.withColumns(
        {
            "closed_at": F.when(over, at(ctx.now)).otherwise(F.col("closed_at")),
            "notes": F.when(over, "expired automatically").otherwise(F.col("notes")),
        }
    )


# ------------------------------------------------------------------ alerts


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALERT_RULES), RULE_SCHEMA)


def _series(labels: Column) -> Column:
    """Labels as one text, the same for equal labels."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def alert_readings(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """One reading per rule, series and instant, with the guard's or the threshold's own value.

    A rule that reduces labels reads the greatest value among the samples it then sees alike. One
    that reads all labels sees each sample alone, so both are one aggregate. Another metric is met
    at the same instant, and per layer where it holds a threshold.
    """
    other = F.coalesce("guard", "threshold_metric").alias("metric")
    read = rules.select("metric").union(rules.select(other)).distinct()
    samples = kept(samples.join(read, "metric", "left_semi"))
    kept_labels = F.map_filter("labels", lambda n, _: F.array_contains(F.col("by_labels"), n))
    seen = F.when(F.col("by_labels").isNull(), F.col("labels")).otherwise(kept_labels)
    readings = (
        samples.join(rules.select("alert", "metric", "by_labels"), "metric")
        .select("alert", "ts", "value", seen.alias("labels"))
        .withColumn("series", _series(F.col("labels")))
        .groupBy("alert", "series", "ts")
        .agg(F.max("value").alias("value"), F.first("labels").alias("labels"))
        .join(rules.drop("by_labels"), "alert")
        .withColumn("_other", F.coalesce("guard", "threshold_metric"))
    )
    others = samples.join(rules.select(other).distinct(), "metric", "left_semi").select(
        F.col("ts").alias("_ts"),
        F.col("metric").alias("_metric"),
        F.col("labels")["layer"].alias("_layer"),
        F.col("value").alias("other_value"),
    )
    layer = F.when(F.col("threshold_metric").isNotNull(), F.col("labels")["layer"])
    met = (
        (F.col("ts") == F.col("_ts"))
        & (F.col("_other") == F.col("_metric"))
        & layer.eqNullSafe(F.col("_layer"))
    )
    return readings.join(others, met, "left").drop("_ts", "_metric", "_layer", "_other")


#: A series without a sample for longer than this has ended; what comes later begins anew.
STALE_SECONDS = 300


def alert_states(
    samples: DataFrame, rules: DataFrame, stale_seconds: int = STALE_SECONDS
) -> DataFrame:
    """Every sample on which an alert's condition holds, since when, and whether it fires.

    ``samples`` are (ts, metric, labels, value), labels a map, one value per instant and labels. An
    alert fires once its condition has held without a break for the rule's duration. A stretch is
    broken by a sample on which the condition does not hold, and by a gap of more than
    ``stale_seconds`` between samples. The latest beginning of a stretch so far, carried forward
    along the series, is the one a sample belongs to.

    Two passes over the same slices: when a sample's value last grew and whether the condition holds,
    and then where stretches begin. In each only a slice's first sample depends on the one before it.
    """
    stale = stale_seconds * 1_000_000
    scan = Sliced.by_range(alert_readings(samples, rules), ["alert", "series"], "ts")
    tested = _tested(scan, stale)
    states = _since(Sliced(kept(tested), scan.keys, scan.order)).where("_holds")
    held = F.unix_micros("ts") - F.unix_micros("since") >= F.col("held_seconds") * 1_000_000
    return states.select(
        "alert", "severity", "series", "labels", "ts", "value", "since", held.alias("firing")
    )


def _tested(scan: Sliced, stale: int) -> DataFrame:
    """Samples with whether the condition ``_holds``, and whether they follow on the one before."""
    reading = F.struct("value", "ts")

    def fresh(row: str, last: str) -> Column:
        return F.unix_micros(f"{row}ts") - F.unix_micros(f"{last}.ts") <= stale

    def grew(row: str, last: str) -> Column:
        """The instant, if the value has grown on it. A counter that fell was reset, so what it
        shows now was added since."""
        value, before = F.col(f"{row}value"), F.when(fresh(row, last), F.col(f"{last}.value"))
        more = (value > before) | ((value < before) & (value > 0))
        return F.when(more, F.col(f"{row}ts"))

    local = scan.rows.withColumn("_last", F.lag(reading).over(scan.in_order())).withColumn(
        "_grew", F.max(grew("", "_last")).over(scan.so_far())
    )
    edges = scan.edges(
        local,
        F.max_by(reading, F.col("ts")).alias("_own"),
        F.min_by(reading, F.col("ts")).alias("_first"),
        F.max("_grew").alias("_grown"),
    ).withColumn("_prior", F.lag("_own").over(scan.slices()))
    at_first = grew("_first.", "_prior")
    edges = edges.withColumn("_at_first", at_first)
    before = F.max(F.greatest("_grown", "_at_first")).over(scan.earlier())
    handed = scan.handed(
        local, edges, F.col("_prior"), F.greatest("_at_first", before).alias("_before")
    )
    rows = handed.withColumn("_last", F.coalesce("_last", "_prior"))
    since_growth = F.unix_micros("ts") - F.unix_micros(F.greatest("_grew", "_before"))
    limit = F.coalesce("threshold", "other_value")
    condition = (
        F.when(F.col("comparison") == "increase", since_growth < INCREASE_SECONDS * 1_000_000)
        .when(F.col("comparison") == "=", F.col("value") == limit)
        .otherwise(F.col("value") > limit)
    ) & (F.col("guard").isNull() | (F.col("other_value") > 0))
    return rows.select(
        *scan.group,
        "severity",
        "labels",
        "ts",
        "value",
        "held_seconds",
        F.coalesce(condition, F.lit(False)).alias("_holds"),
        F.coalesce(fresh("", "_last"), F.lit(False)).alias("_follows"),
    )


def _since(scan: Sliced) -> DataFrame:
    """Samples with the latest beginning of a stretch so far."""

    def begins(row: str, was: Column) -> Column:
        goes_on = F.col(f"{row}_follows") & F.coalesce(was, F.lit(False))
        return F.when(F.col(f"{row}_holds") & ~goes_on, F.col(f"{row}ts"))

    was = F.lag("_holds").over(scan.in_order())
    local = scan.rows.withColumn("_was", was).withColumn(
        "_begun", F.max(F.when(F.col("_was").isNotNull(), begins("", F.col("_was")))).over(scan.so_far())
    )
    edges = scan.edges(
        local,
        F.max_by("_holds", F.col("ts")).alias("_held"),
        F.min_by(F.struct("_holds", "_follows", "ts"), F.col("ts")).alias("_first"),
        F.max("_begun").alias("_begins"),
    ).withColumn("_prior", F.lag("_held").over(scan.slices()))
    edges = edges.withColumn("_at_first", begins("_first.", F.col("_prior")))
    before = F.max(F.greatest("_begins", "_at_first")).over(scan.earlier())
    handed = scan.handed(local, edges, F.greatest("_at_first", before).alias("_before"))
    return handed.withColumn("since", F.greatest("_begun", "_before"))


def alert_intervals(states: DataFrame) -> DataFrame:
    """Unbroken stretches during which an alert fired."""
    return (
        states.where("firing")
        .groupBy("alert", "severity", "series", "since")
        .agg(F.min("ts").alias("fired_at"), F.max("ts").alias("last_at"))
    )


def window_samples(windows: DataFrame, ctx: Context, every: str = "1 minute") -> DataFrame:
    """Scrapes of the number of open windows, one per interval in which any is open."""
    until = F.coalesce("closed_at", at(ctx.now))
    step = F.expr(f"interval {every}")
    first = F.date_trunc("minute", F.col("opened_at")) + step
    ticks = F.when(until >= first, F.sequence(first, until, step))
    open_at = windows.select(F.explode(ticks).alias("ts"), until.alias("_until"))
    return (
        open_at.where(F.col("ts") < F.col("_until"))
        .groupBy("ts")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(
            "ts",
            F.lit("analytics_chaos_window_active").alias("metric"),
            F.create_map().cast("map<string,string>").alias("labels"),
            "value",
        )
    )


def suppress_paging(states: DataFrame) -> DataFrame:
    """Firing alerts, each with whether it is muted.

    Warnings and criticals are muted at instants when the window marker fires, and a warning while
    the critical about the same label does. Alerts and their muters meet on the instant, so these
    are equality joins with one row per instant on the muting side.
    """
    firing = states.where("firing")
    window = (
        firing.where(F.col("alert") == WINDOW_MARKER)
        .select("ts", F.lit(True).alias("_window"))
        .distinct()
    )
    label = F.col("labels")[SHARED_LABEL]
    stronger = (
        firing.where(F.col("alert") == STRONGER)
        .select(
            "ts",
            F.lit(WEAKER).alias("alert"),
            F.coalesce(label, F.lit("")).alias("_label"),
            F.lit(True).alias("_stronger"),
        )
        .distinct()
    )
    by_window = F.coalesce("_window", F.lit(False)) & F.col("severity").isin(*PAGING_SEVERITIES)
    return (
        firing.withColumn("_label", F.coalesce(label, F.lit("")))
        .join(window, "ts", "left")
        .join(stronger, ["ts", "alert", "_label"], "left")
        .select(
            "alert",
            "severity",
            "series",
            "ts",
            "value",
            "since",
            (by_window | F.coalesce("_stronger", F.lit(False))).alias("muted"),
        )
    )
