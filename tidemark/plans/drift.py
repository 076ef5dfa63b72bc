"""Schema drift in payloads that nobody declared a schema for."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.functions import at
from tidemark.functions.variants import OBJECT, json_type
from tidemark.operators.latest import first_per
from tidemark.plans import core, marts, staging

FIELD_ADDED, FIELD_REMOVED, TYPE_CHANGED = "field_added", "field_removed", "type_changed"

# A path seen less often is no baseline; how much a run looks at.
MIN_BASELINE_OCCURRENCES = 20
WINDOW = timedelta(hours=1)


def payload_paths(events: DataFrame) -> DataFrame:
    """One row per event and path of its payload, two levels at most, with the JSON type there.

    One scan and one parse: each member of the payload is met with its own members, or with none, and
    is given out itself beside the first of them.
    """
    explode = events.sparkSession.tvf.variant_explode_outer
    parsed = events.select("event_type", F.try_parse_json("payload").alias("_payload"))
    top = (
        parsed.lateralJoin(explode(F.col("_payload").outer()))
        .where(F.col("key").isNotNull())
        .select(
            "event_type",
            F.col("key").alias("_path"),
            json_type(F.col("value")).alias("_type"),
            F.col("value").alias("_value"),
        )
    )
    members = F.when(F.col("_type") == OBJECT, F.col("_value"))
    met = top.withColumn("_members", members).lateralJoin(explode(F.col("_members").outer()))
    itself = F.coalesce(F.col("pos"), F.lit(0)) == 0
    found = F.array(
        F.when(itself, F.struct(F.col("_path").alias("json_path"), F.col("_type").alias("json_type"))),
        F.when(
            F.col("key").isNotNull(),
            F.struct(
                F.concat_ws(".", "_path", "key").alias("json_path"),
                json_type(F.col("value")).alias("json_type"),
            ),
        ),
    )
    return met.select("event_type", F.inline(F.array_compact(found)))


def observe_shapes(raw_events: DataFrame, since, until) -> DataFrame:
    """How often each path had each type among events loaded in ``[since, until)``."""
    loaded = raw_events.where(
        (F.col("loaded_at") >= at(since)) & (F.col("loaded_at") < at(until))
    )
    return (
        payload_paths(loaded)
        .groupBy("event_type", "json_path", "json_type")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def merge_shapes(state: DataFrame, observed: DataFrame, since, until) -> DataFrame:
    """The shape history with a window added: first seen stays, last seen and counts move on."""
    keys = ["event_type", "json_path", "json_type"]
    fresh = observed.select(*keys, F.col("occurrences").alias("_fresh"))
    seen = F.col("_fresh").isNotNull()
    zero = F.lit(0).cast("bigint")
    return state.join(fresh, keys, "full_outer").select(
        *keys,
        F.coalesce("first_seen", at(since)).alias("first_seen"),
        F.when(seen, at(until)).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("occurrences", zero) + F.coalesce("_fresh", zero)).alias("occurrences"),
    )


def dominant_types(shapes: DataFrame) -> DataFrame:
    """The most frequent type of each path; equal counts go to the type first by name."""
    return first_per(
        shapes, ["event_type", "json_path"], [F.col("occurrences").desc(), F.col("json_type")]
    ).select("event_type", "json_path", "json_type", "occurrences")


def required_fields(spark: SparkSession) -> DataFrame:
    """Fields that models declare they depend on, and which models those are."""
    models: dict[str, list[str]] = {}
    for module in (staging, core, marts):
        for model, fields in module.REQUIRED_FIELDS.items():
            for field in fields:
                models.setdefault(field, []).append(model)
    return spark.createDataFrame(
        sorted((field, sorted(names)) for field, names in models.items()),
        "field STRING, required_by ARRAY<STRING>",
    )


def baseline_shapes(
    state: DataFrame, window_start, min_occurrences: int = MIN_BASELINE_OCCURRENCES
) -> DataFrame:
    """What counts as normal: types first seen before the window and seen often enough."""
    known = state.where(
        (F.col("first_seen") < at(window_start)) & (F.col("occurrences") >= min_occurrences)
    )
    return dominant_types(known)


def detect_drift(current: DataFrame, baseline: DataFrame, required: DataFrame) -> DataFrame:
    """Paths that appeared, vanished or changed type.

    A vanished path is reported only for event types that still arrive. Additions never block;
    the other two block when a model declares the field, named by the path's last part.
    """
    keys = ["event_type", "json_path"]
    now = current.select(*keys, F.col("json_type").alias("now"))
    was = baseline.select(*keys, F.col("json_type").alias("was"))
    arriving = current.select("event_type").distinct()
    change = (
        F.when(F.col("was").isNull(), FIELD_ADDED)
        .when(F.col("now").isNull(), FIELD_REMOVED)
        .when(F.col("was") != F.col("now"), TYPE_CHANGED)
    )
    found = (
        now.join(was, keys, "full_outer")
        .join(arriving, "event_type", "left_semi")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .withColumn("field", F.element_at(F.split("json_path", r"\."), -1))
    )
    judged = found.join(required, "field", "left")
    blocking = (F.col("change") != FIELD_ADDED) & F.col("required_by").isNotNull()
    return judged.select(
        "event_type",
        "json_path",
        "change",
        blocking.alias("blocking"),
        F.to_json(
            F.struct(
                "was",
                "now",
                F.when(F.col("change") != FIELD_ADDED, F.coalesce("required_by", F.array()))
                .alias("required_by"),
            )
        ).alias("details"),
    )


def run_detection(
    raw_events: DataFrame, state: DataFrame, ctx: Context, window: timedelta = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """One run: the shape history after it, and its findings.

    The baseline is read from the history after the window was added to it.
    """
    since = ctx.now - window
    observed = observe_shapes(raw_events, since, ctx.now)
    merged = merge_shapes(state, observed, since, ctx.now)
    findings = detect_drift(
        dominant_types(observed),
        baseline_shapes(merged, since),
        required_fields(raw_events.sparkSession),
    )
    return merged, findings.select(
        at(ctx.now).alias("detected_at"), "*", F.lit(None).cast("timestamp").alias("resolved_at")
    )


def resolve_findings(findings: DataFrame, paths: list[str], ctx: Context) -> DataFrame:
    """Close the open findings on the given paths."""
    closes = F.col("resolved_at").isNull() & F.col("json_path").isin(*paths)
    return findings.withColumn(
        "resolved_at", F.when(closes, at(ctx.now)).otherwise(F.col("resolved_at"))
    )
