"""Data quality: column tests that return failing rows, and shape checks that return verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.functions import at, changed, json_record
from tidemark.operators.history import as_of

PASS, WARN, FAIL = "pass", "warn", "fail"

# What the shape checks tolerate.
VOLUME_TOLERANCE = 0.5
VOLUME_MIN_HISTORY_DAYS = 3
DUPLICATE_RATE_LIMIT = 0.02
QUARANTINE_RATE_LIMIT = 0.01
SYNC_ERROR_RATE_LIMIT = 0.02
MISS_RATE_LIMIT = 0.25
MISS_RATE_MIN_EVENTS = 20

# Freshness target per layer, in seconds.
FRESHNESS_SLO = (
    ("raw_product_events", 600, "p95 behind event time"),
    ("raw_cdc", 300, "p95 behind commit"),
    ("raw_billing", 1800, "webhook path"),
    ("staging", 3600, "typed and deduplicated"),
    ("marts", 86400, "daily build"),
    ("reverse_etl", 86400, "delivered to the product"),
)
SLO_SCHEMA = "layer STRING, target_seconds INT, description STRING"

# How old a raw table may be, in seconds, before a warning and before an error.
SOURCE_FRESHNESS = (
    ("product_events", 15 * 60, 60 * 60),
    ("cdc_changes", 10 * 60, 30 * 60),
    ("billing_webhook_events", 30 * 60, 120 * 60),
    ("billing_events_batch", 30 * 3600, 48 * 3600),
)

# The column tests each model declares.
MODEL_TESTS = {
    "stg_subscription_changes": {
        "not_null": ["subscription_id", "source_lsn"],
        "accepted_values": {"op": ["c", "u", "d", "r"]},
    },
    "stg_billing_events": {
        "not_null": ["provider_event_id"],
        "unique": [["provider_event_id"]],
        "accepted_values": {"arrived_by": ["both", "webhook_only", "batch_only"]},
    },
    "stg_billing_reconciliation": {"not_null": ["billing_day"], "unique": [["billing_day"]]},
    "stg_product_events_quarantined": {"not_null": ["event_id"]},
    "stg_product_events": {
        "not_null": ["event_id", "account_id", "event_type", "event_time"],
        "unique": [["event_id"]],
    },
    "stg_product_events_unreconciled": {
        "not_null": ["event_id"],
        "unique": [["event_id"]],
        "accepted_values": {"reason": ["event predates account"]},
    },
    "dim_subscription": {
        "not_null": [
            "subscription_version_key",
            "subscription_id",
            "status",
            "valid_from",
            "valid_to",
        ],
        "unique": [["subscription_version_key"]],
        "accepted_values": {"status": ["trial", "active", "past_due", "cancelled"]},
    },
    "dim_account": {"not_null": ["account_id"], "unique": [["account_id"]]},
    "dim_date": {"not_null": ["date_day"], "unique": [["date_day"]]},
    "fct_subscription_daily": {"unique": [["date_day", "subscription_id"]]},
    "fct_account_activity_daily": {"unique": [["account_id", "activity_date"]]},
    "fct_invoices": {"not_null": ["invoice_id"], "unique": [["invoice_id"]]},
    "mart_account_health": {
        "not_null": ["account_id", "churn_score", "churn_band", "score_version"],
        "unique": [["account_id"]],
        "accepted_values": {"churn_band": ["low", "medium", "high", "critical", "churned"]},
        "accepted_range": {"churn_score": (0, 100)},
    },
    "mart_revenue_mrr": {
        "unique": [["date_day", "plan_code"]],
        "accepted_range": {"mrr_cents": (0, None)},
    },
    "mart_activation_funnel": {"not_null": ["cohort_week"], "unique": [["cohort_week"]]},
}


# ------------------------------------------------------------------ failing rows


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, with how often. Nulls are not compared in a single
    column and are grouped in a combination."""
    kept = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    counted = kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.where(F.col("occurrences") > 1)


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with another value; null is let through."""
    return df.where(~F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows outside inclusive bounds; null is let through."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < F.lit(low))
    if high is not None:
        outside = outside | (F.col(column) > F.lit(high))
    return df.where(outside)


def model_test_failures(model: str, df: DataFrame) -> DataFrame:
    """How many rows fail each test a model declares.

    Row-wise tests share one pass over the model, since each is a conditional count.
    """
    declared = MODEL_TESTS[model]
    row_wise: dict[str, Column] = {}
    for column in declared.get("not_null", []):
        row_wise[f"not_null:{column}"] = F.col(column).isNull()
    for column, values in declared.get("accepted_values", {}).items():
        row_wise[f"accepted_values:{column}"] = ~F.col(column).isin(*values)
    for column, (low, high) in declared.get("accepted_range", {}).items():
        outside = F.lit(False)
        if low is not None:
            outside = outside | (F.col(column) < F.lit(low))
        if high is not None:
            outside = outside | (F.col(column) > F.lit(high))
        row_wise[f"accepted_range:{column}"] = outside
    parts = []
    if row_wise:
        counts = df.agg(
            *[F.count_if(test).alias(f"_{i}") for i, test in enumerate(row_wise.values())]
        )
        pairs = F.array(
            *[
                F.struct(F.lit(name).alias("test"), F.col(f"_{i}").alias("failures"))
                for i, name in enumerate(row_wise)
            ]
        )
        parts.append(counts.select(F.inline(pairs)))
    for columns in declared.get("unique", []):
        failing = unique(df, columns).agg(F.count(F.lit(1)).alias("failures"))
        parts.append(failing.select(F.lit(f"unique:{','.join(columns)}").alias("test"), "failures"))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.lit(model).alias("model"), "test", "failures")


def reconcile_scd2(
    dim_subscription: DataFrame, snapshots: DataFrame, cdc_gaps: DataFrame
) -> DataFrame:
    """Subscriptions on which history and an independent snapshot disagree.

    History is read as of the snapshot's own instant. Nothing is reported where there is no
    snapshot, nor while a known gap is open.
    """
    shots = snapshots.where(F.col("source_table") == "subscriptions")
    newest = shots.agg(F.max("snapshot_at")).scalar()
    row = F.col("_row")
    photographed = (
        shots.where(F.col("snapshot_at") == newest)
        .withColumn("_row", json_record("row_data", "status", "seats", "plan_code"))
        .select(
            F.col("pk").cast("bigint").alias("subscription_id"),
            row["status"].alias("snapshot_status"),
            row["seats"].cast("int").alias("snapshot_seats"),
            row["plan_code"].alias("snapshot_plan_code"),
            F.lit(True).alias("_photographed"),
        )
    )
    derived = as_of(dim_subscription, newest).select(
        "subscription_id",
        F.col("status").alias("scd2_status"),
        F.col("seats").alias("scd2_seats"),
        F.col("plan_code").alias("scd2_plan_code"),
        F.lit(True).alias("_derived"),
    )
    open_gaps = cdc_gaps.where(F.col("resolved_at").isNull()).agg(F.count(F.lit(1))).scalar()
    disagree = (
        F.col("_photographed").isNull()
        | F.col("_derived").isNull()
        | changed("snapshot_status", "scd2_status")
        | changed("snapshot_seats", "scd2_seats")
        | changed("snapshot_plan_code", "scd2_plan_code")
    )
    return (
        photographed.join(derived, "subscription_id", "full_outer")
        .where(disagree & newest.isNotNull() & (open_gaps == 0))
        .drop("_photographed", "_derived")
    )


def miss_rate_breaches(
    reconciliation: DataFrame,
    min_events: int = MISS_RATE_MIN_EVENTS,
    max_rate: float = MISS_RATE_LIMIT,
) -> DataFrame:
    """Days on which the webhook path missed too much of a meaningful number of events."""
    return reconciliation.where(
        (F.col("events") >= min_events) & (F.col("webhook_miss_rate") > F.lit(max_rate))
    ).select("billing_day", "events", "webhook_missed", "webhook_miss_rate")


# ------------------------------------------------------------------ verdicts


def _verdict(
    df: DataFrame,
    check: str,
    target: Column | str,
    status: Column,
    observed: Column,
    threshold: Column,
    details: Column,
) -> DataFrame:
    return df.select(
        F.lit(check).alias("check_name"),
        (F.lit(target) if isinstance(target, str) else target).alias("target"),
        status.alias("status"),
        observed.cast("double").alias("observed"),
        threshold.cast("double").alias("threshold"),
        F.to_json(details).alias("details"),
    )


def _within(rate: Column, limit: float) -> Column:
    return F.when(rate <= F.lit(limit), PASS).otherwise(FAIL)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def volume_anomaly(activity: DataFrame, ctx: Context) -> DataFrame:
    """Yesterday's events against the median of the days present in the week before it."""
    day = F.date_sub(F.lit(ctx.today), 1)
    week = activity.where(
        (F.col("activity_date") > F.date_sub(day, 8)) & (F.col("activity_date") <= day)
    )
    daily = week.groupBy("activity_date").agg(F.sum("events").alias("events"))
    before = F.col("activity_date") < day
    # Daily totals are eight rows at most by now.
    summary = daily.agg(
        F.coalesce(F.sum(F.when(~before, F.col("events"))), F.lit(0).cast("bigint")).alias(
            "observed"
        ),
        F.count_if(before).alias("days"),
        F.median(F.when(before, F.col("events"))).alias("median"),
    )
    ratio = F.when(F.col("median") != 0, F.col("observed") / F.col("median")).otherwise(F.lit(0.0))
    few = F.col("days") < VOLUME_MIN_HISTORY_DAYS
    inside = ratio.between(1 - VOLUME_TOLERANCE, 1 + VOLUME_TOLERANCE)
    return _verdict(
        summary,
        "volume_anomaly",
        "core.fct_account_activity_daily",
        F.when(few, WARN).when(inside, PASS).otherwise(FAIL),
        F.when(few, F.col("observed").cast("double")).otherwise(ratio),
        F.when(~few, F.lit(VOLUME_TOLERANCE)),
        F.struct(
            F.when(few, F.lit("insufficient history")).alias("reason"),
            F.when(few, F.col("days")).alias("days_available"),
            F.when(~few, day.cast("string")).alias("day"),
            F.when(~few, F.col("observed")).alias("events"),
            F.when(~few, F.col("median")).alias("median_events"),
        ),
    )


def duplicate_rate(
    activity: DataFrame, ctx: Context, limit: float = DUPLICATE_RATE_LIMIT
) -> DataFrame:
    """Share of the day's events that were further copies."""
    zero = F.lit(0).cast("bigint")
    totals = activity.where(
        F.col("activity_date") > F.date_sub(F.lit(ctx.today), 1)
    ).agg(
        F.coalesce(F.sum("duplicate_copies"), zero).alias("duplicate_copies"),
        F.coalesce(F.sum("events"), zero).alias("events"),
    )
    rate = _ratio(F.col("duplicate_copies"), F.col("events"))
    return _verdict(
        totals,
        "duplicate_rate",
        "core.fct_account_activity_daily",
        _within(rate, limit),
        rate,
        F.lit(limit),
        F.struct("duplicate_copies", "events"),
    )


def quarantine_rate(
    staged: DataFrame, held: DataFrame, ctx: Context, limit: float = QUARANTINE_RATE_LIMIT
) -> DataFrame:
    """Share of the last day's loaded events that the cutoff holds back."""
    since = at(ctx.now) - F.expr("interval 1 day")

    def recent(df: DataFrame, is_held: bool) -> DataFrame:
        return df.where(F.col("loaded_at") > since).select(F.lit(is_held).alias("held"))

    totals = recent(staged, False).unionByName(recent(held, True)).agg(
        F.count_if("held").alias("quarantined"), F.count_if(~F.col("held")).alias("loaded")
    )
    rate = _ratio(F.col("quarantined"), F.col("quarantined") + F.col("loaded"))
    return _verdict(
        totals,
        "quarantine_rate",
        "staging.stg_product_events",
        _within(rate, limit),
        rate,
        F.lit(limit),
        F.struct("quarantined", "loaded"),
    )


def reverse_etl_health(sync_state: DataFrame, limit: float = SYNC_ERROR_RATE_LIMIT) -> DataFrame:
    """Share of accounts whose last delivery failed; refusals by the receiver are not failures."""
    totals = sync_state.agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") != "skipped_client_error").alias("considered"),
    )
    rate = _ratio(F.col("failed"), F.col("considered"))
    return _verdict(
        totals,
        "reverse_etl_error_rate",
        "ops.reverse_etl_sync_state",
        _within(rate, limit),
        rate,
        F.lit(limit),
        F.struct("failed", "considered"),
    )


Layer = DataFrame | Callable[[], DataFrame]


def _clock(name: str, layer: Layer) -> DataFrame:
    try:
        df = layer() if callable(layer) else layer
        newest = F.max(F.col(df.columns[0])).cast("timestamp").alias("latest")
        return df.agg(newest).select(
            F.lit(name).alias("layer"), "latest", F.lit(None).cast("string").alias("unreadable")
        )
    except AnalysisException as error:
        # One layer that is gone must not take the verdicts on all others with it.
        return SparkSession.active().range(1).select(
            F.lit(name).alias("layer"),
            F.lit(None).cast("timestamp").alias("latest"),
            F.lit(str(error).split("\n")[0]).alias("unreadable"),
        )


def layer_clocks(layers: dict[str, Layer]) -> DataFrame:
    """Newest instant per layer, each a one-row maximum of the frame's only column.

    A layer may be a function that reads it; if that fails because the table is not there or not as
    expected, the layer has no instant and says why.
    """
    return reduce(DataFrame.unionByName, [_clock(name, df) for name, df in layers.items()])


def freshness(layers: dict[str, Layer], slo: DataFrame, ctx: Context) -> DataFrame:
    """Age of each layer against its target. A layer without data, or one that cannot be read, fails;
    one without a target is not judged."""
    aged = layer_clocks(layers).join(slo.select("layer", "target_seconds"), "layer")
    age = (F.unix_micros(at(ctx.now)) - F.unix_micros("latest")) / F.lit(1e6)
    empty = F.col("latest").isNull()
    return _verdict(
        aged,
        "freshness",
        F.col("layer"),
        F.when(~empty & (age <= F.col("target_seconds")), PASS).otherwise(FAIL),
        age,
        F.col("target_seconds"),
        F.struct(
            F.coalesce("unreadable", F.when(empty, F.lit("no data in this layer"))).alias("reason"),
            F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("latest"),
        ),
    )


def source_freshness(sources: dict[str, Layer], ctx: Context) -> DataFrame:
    """Age of each raw table against the ages at which it warns and errors."""
    limits = {name: (warn, error) for name, warn, error in SOURCE_FRESHNESS}
    clocks = layer_clocks({name: df for name, df in sources.items() if name in limits})
    age = (F.unix_micros(at(ctx.now)) - F.unix_micros("latest")) / F.lit(1e6)

    def limit(which: int) -> Column:
        cases = F.lit(None).cast("int")
        for name, pair in limits.items():
            cases = F.when(F.col("layer") == name, F.lit(pair[which])).otherwise(cases)
        return cases

    judged = clocks.withColumns(
        {"age_seconds": age, "warn_seconds": limit(0), "error_seconds": limit(1)}
    )
    status = (
        F.when(F.col("latest").isNull(), "error")
        .when(F.col("age_seconds") > F.col("error_seconds"), "error")
        .when(F.col("age_seconds") > F.col("warn_seconds"), "warn")
        .otherwise("pass")
    )
    return judged.select(
        F.col("layer").alias("source"),
        "age_seconds",
        "warn_seconds",
        "error_seconds",
        status.alias("status"),
    )


def run_checks(tables: dict[str, DataFrame], slo: DataFrame, ctx: Context) -> DataFrame:
    """Every verdict of one run, passes included, ready to be appended to the history."""
    layers = {
        "raw_product_events": tables["product_events"]
        .where(F.col("source_path") == "live")
        .select("loaded_at"),
        "raw_cdc": tables["cdc_changes"].select("loaded_at"),
        "raw_billing": tables["billing_webhook_events"].select("loaded_at"),
        "staging": tables["stg_product_events"].select("loaded_at"),
        "marts": tables["mart_account_health"].select("as_of_date"),
        "reverse_etl": tables["reverse_etl_sync_state"].select("last_success_at"),
    }
    activity = tables["fct_account_activity_daily"]
    verdicts = [
        volume_anomaly(activity, ctx),
        duplicate_rate(activity, ctx),
        quarantine_rate(
            tables["stg_product_events"], tables["stg_product_events_quarantined"], ctx
        ),
        reverse_etl_health(tables["reverse_etl_sync_state"]),
        freshness(layers, slo, ctx),
    ]
    return reduce(DataFrame.unionByName, verdicts).select(at(ctx.now).alias("checked_at"), "*")


def append_results(results: DataFrame, folder: str) -> None:
    """Add one run's verdicts or findings to their history, and leave what is there as it is."""
    results.write.mode("append").parquet(folder)
