"""Queries about the shape of payloads."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import inputs
from tidemark.catalog.inputs import CTX
from tidemark.catalog.registry import query
from tidemark.plans import drift, ops

START = datetime(2024, 1, 1, tzinfo=UTC)
RELEASE = datetime(2024, 1, 20, tzinfo=UTC)

# From 20 January clients write other payloads: `plan` becomes `plan_code`, `duration_ms` becomes
# text, and a `context` object appears.
SQL_PATHS = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    ts >= TIMESTAMP '2024-01-20' AS released
  FROM events
), paths AS (
  SELECT event_type, ts, unnest(CASE
      WHEN released THEN ['feature', 'plan_code', 'duration_ms', 'tags', 'context',
        'context.app', 'context.build', 'context.deep']
      ELSE ['feature', 'plan', 'duration_ms', 'tags'] END) AS json_path,
    unnest(CASE
      WHEN released THEN [CASE WHEN k = 60 THEN 'null' ELSE 'string' END, 'string', 'string',
        'array', 'object', 'boolean', 'number', 'object']
      ELSE [CASE WHEN k = 60 THEN 'null' ELSE 'string' END, 'string', 'number', 'array'] END)
      AS json_type
  FROM ev
)"""


def payload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with payloads as clients write them before and after a release."""
    k, released = F.col("k"), F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    feature = F.when(k == 60, "null").otherwise(
        F.concat(F.lit('"f'), F.expr("k div 17").cast("string"), F.lit('"'))
    )
    before = F.format_string(
        '{"feature":%s,"plan":"pro","duration_ms":%d,"tags":[%d]}', feature, k, k
    )
    after = F.format_string(
        '{"feature":%s,"plan_code":"pro","duration_ms":"%d","tags":[],'
        '"context":{"app":true,"build":%d.5,"deep":{"er":1}}}',
        feature,
        k,
        k,
    )
    return inputs.events(spark, sf_dir).select(
        "event_type",
        F.col("ts").alias("loaded_at"),
        F.when(released, after).otherwise(before).alias("payload"),
    )


SQL_SHAPES = f"""{SQL_PATHS}, history AS (
  SELECT event_type, json_path, json_type, TIMESTAMP '2024-01-01' AS first_seen,
    TIMESTAMP '2024-01-20' AS last_seen, count(*) AS occurrences
  FROM paths WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL
), observed AS (
  SELECT event_type, json_path, json_type, count(*) AS occurrences
  FROM paths WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL
), merged_shapes AS (
  SELECT event_type, json_path, json_type,
    coalesce(h.first_seen, TIMESTAMP '2024-01-20') AS first_seen,
    CASE WHEN o.occurrences IS NULL THEN h.last_seen ELSE TIMESTAMP '2024-01-31' END AS last_seen,
    coalesce(h.occurrences, 0) + coalesce(o.occurrences, 0) AS occurrences
  FROM history h FULL OUTER JOIN observed o USING (event_type, json_path, json_type)
), dominant AS (
  SELECT * FROM observed QUALIFY row_number() OVER (PARTITION BY event_type, json_path
    ORDER BY occurrences DESC, json_type) = 1
), baseline AS (
  SELECT * FROM merged_shapes
  WHERE first_seen < TIMESTAMP '2024-01-20' AND occurrences >= 20
  QUALIFY row_number() OVER (PARTITION BY event_type, json_path
    ORDER BY occurrences DESC, json_type) = 1
), findings AS (
  SELECT event_type, json_path,
    CASE WHEN b.json_type IS NULL THEN 'field_added' WHEN d.json_type IS NULL
      THEN 'field_removed' ELSE 'type_changed' END AS change,
    b.json_type IS NOT NULL AND list_last(string_split(json_path, '.')) IN ('feature', 'surface',
      'plan', 'duration_ms', 'status', 'plan_code', 'seats', 'mrr_cents', 'effective_at',
      'churn_score', 'churn_band', 'score_version', 'reasons') AS blocking
  FROM dominant d FULL OUTER JOIN baseline b USING (event_type, json_path)
  WHERE event_type IN (SELECT event_type FROM dominant)
    AND d.json_type IS DISTINCT FROM b.json_type
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape history up to the release."""
    observed = drift.observe_shapes(payload_events(spark, sf_dir), START, RELEASE)
    nothing = spark.createDataFrame(
        [],
        "event_type STRING, json_path STRING, json_type STRING, first_seen TIMESTAMP, "
        "last_seen TIMESTAMP, occurrences BIGINT",
    )
    return drift.merge_shapes(nothing, observed, START, RELEASE)


def detection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return drift.run_detection(
        payload_events(spark, sf_dir), history(spark, sf_dir), CTX, CTX.now - RELEASE
    )


@query(f"""WITH {SQL_PATHS}
SELECT event_type, json_path, json_type, count(*) AS events FROM paths GROUP BY ALL""")
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of every payload, counted per type."""
    return (
        drift.payload_paths(payload_events(spark, sf_dir))
        .groupBy("event_type", "json_path", "json_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(f"WITH {SQL_SHAPES} SELECT * FROM observed")
def observed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes among events loaded since the release."""
    return drift.observe_shapes(payload_events(spark, sf_dir), RELEASE, CTX.now)


@query(f"WITH {SQL_SHAPES} SELECT * FROM merged_shapes", ts="first_seen last_seen")
def merged_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection(spark, sf_dir)[0]


@query(f"WITH {SQL_SHAPES} SELECT event_type, json_path, json_type, occurrences FROM dominant")
def dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.dominant_types(
        drift.observe_shapes(payload_events(spark, sf_dir), RELEASE, CTX.now)
    )


@query(f"WITH {SQL_SHAPES} SELECT event_type, json_path, json_type, occurrences FROM baseline")
def baseline_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.baseline_shapes(detection(spark, sf_dir)[0], RELEASE)


@query(f"WITH {SQL_SHAPES} SELECT * FROM findings")
def drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection(spark, sf_dir)[1]
    return found.select("event_type", "json_path", "change", "blocking")


@query(
    f"""WITH {SQL_SHAPES}
SELECT *, CASE WHEN json_path IN ('plan', 'plan_code') THEN TIMESTAMP '2024-01-31' END
  AS resolved_at FROM findings""",
    ts="resolved_at",
)
def resolved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after the renamed field was rolled back."""
    found = drift.resolve_findings(detection(spark, sf_dir)[1], ["plan", "plan_code"], CTX)
    return found.select("event_type", "json_path", "change", "blocking", "resolved_at")


@query(
    f"""WITH {SQL_SHAPES}
SELECT *, TIMESTAMP '2024-01-31' AS detected_at FROM findings
ORDER BY blocking DESC, event_type, json_path LIMIT 20""",
    ts="detected_at",
)
def open_drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty findings to look at first."""
    return ops.open_drift_findings(detection(spark, sf_dir)[1])
