"""Queries about sending account health back to the product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import inputs, marts
from tidemark.catalog.inputs import CTX
from tidemark.catalog.marts import SQL_HEALTH
from tidemark.catalog.registry import query
from tidemark.context import kept
from tidemark.plans import activation

SQL_PAYLOADS = f"""{SQL_HEALTH}, payloads AS (
  SELECT account_id, CAST(churn_score AS INTEGER) AS churn_score, churn_band, score_version,
    '{{"account_id":' || account_id || ',"as_of_date":"' || CAST(as_of_date AS VARCHAR)
      || '","churn_band":"' || churn_band || '","churn_score":' || churn_score || ',"reasons":'
      || reasons || ',"score_version":"' || score_version || '"}}' AS payload
  FROM health
), digested AS (
  SELECT *, sha256(payload) AS digest FROM payloads
)"""

# What earlier runs left behind, read off the band: medium accounts were never sent, high ones
# failed, critical ones got older content, churned ones were refused.
SQL_STATE = f"""{SQL_PAYLOADS}, state AS (
  SELECT account_id,
    CASE WHEN churn_band IN ('low', 'churned') THEN digest ELSE 'stale' END AS payload_hash,
    score_version,
    CASE churn_band WHEN 'high' THEN 'failed' WHEN 'churned' THEN 'skipped_client_error'
      ELSE 'synced' END AS status,
    CAST(1 + churn_score // 20 AS INTEGER) AS attempts,
    TIMESTAMP '2024-01-30 12:00:00' AS last_attempt_at,
    CASE WHEN churn_band <> 'churned' THEN TIMESTAMP '2024-01-29 12:00:00' END AS last_success_at,
    CASE churn_band WHEN 'high' THEN 503 WHEN 'churned' THEN 404 ELSE 200 END AS last_status_code,
    CASE WHEN churn_band IN ('high', 'churned') THEN 'earlier' END AS last_error
  FROM digested WHERE churn_band <> 'medium'
), decided AS (
  SELECT d.*, s.payload_hash AS previous_hash, s.status AS previous_status,
    d.account_id || ':' || d.score_version || ':' || substr(d.digest, 1, 16) AS idempotency_key,
    coalesce(s.payload_hash = d.digest AND s.status IN ('synced', 'skipped_client_error'), false)
      AS unchanged
  FROM digested d LEFT JOIN state s USING (account_id)
), outcomes AS (
  SELECT d.account_id, d.digest, d.score_version, r.status_code,
    CASE WHEN r.status_code BETWEEN 200 AND 299 THEN 'synced'
      WHEN r.status_code BETWEEN 400 AND 499 THEN 'skipped_client_error' ELSE 'failed' END
      AS status,
    CASE WHEN r.status_code NOT BETWEEN 200 AND 299
      THEN CAST(r.status_code AS VARCHAR) || ': ' || substr(r.body, 1, 200) END AS error
  FROM decided d JOIN (
    SELECT c_custkey AS account_id,
      CASE c_mktsegment WHEN 'BUILDING' THEN 404 WHEN 'MACHINERY' THEN 503 WHEN 'FURNITURE'
        THEN 429 ELSE 200 END AS status_code,
      repeat(c_name, 20) AS body
    FROM customer
  ) r USING (account_id)
  WHERE NOT d.unchanged
)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.sync_payloads(marts.health(spark, sf_dir))


def written_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads for what reads them several times: scored once, and written a row per account."""
    return kept(payloads(spark, sf_dir))


def state_from(sent: DataFrame) -> DataFrame:
    """Delivery state as earlier runs left it, per account and band."""
    band = F.get_json_object("payload", "$.churn_band")
    given = sent.withColumn("band", band).where(F.col("band") != "medium")
    band = F.col("band")
    return given.select(
        "account_id",
        F.when(band.isin("low", "churned"), F.col("digest")).otherwise("stale").alias(
            "payload_hash"
        ),
        "score_version",
        F.when(band == "high", "failed")
        .when(band == "churned", "skipped_client_error")
        .otherwise("synced")
        .alias("status"),
        F.expr("cast(1 + churn_score div 20 as int)").alias("attempts"),
        F.lit("2024-01-30 12:00:00").cast("timestamp").alias("last_attempt_at"),
        F.when(band != "churned", F.lit("2024-01-29 12:00:00").cast("timestamp")).alias(
            "last_success_at"
        ),
        F.when(band == "high", 503).when(band == "churned", 404).otherwise(200).alias(
            "last_status_code"
        ),
        F.when(band.isin("high", "churned"), "earlier").alias("last_error"),
    )


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_from(payloads(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the product answers, by market segment."""
    segment = F.col("c_mktsegment")
    return inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.when(segment == "BUILDING", 404)
        .when(segment == "MACHINERY", 503)
        .when(segment == "FURNITURE", 429)
        .otherwise(200)
        .alias("status_code"),
        F.repeat("c_name", F.lit(20)).alias("body"),
    )


@query(f"""{SQL_PAYLOADS}
SELECT account_id, churn_score, score_version, payload, digest,
  account_id || ':' || score_version || ':' || substr(digest, 1, 16) AS idempotency_key
FROM digested""")
def sync_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir)


@query(f"""{SQL_STATE}
SELECT account_id, churn_score, score_version, payload, digest, idempotency_key, previous_hash,
  previous_status
FROM decided WHERE NOT unchanged""")
def sync_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = written_payloads(spark, sf_dir)
    return activation.sync_candidates(sent, state_from(sent))


def outcomes(spark: SparkSession, sf_dir: str, sent: DataFrame) -> DataFrame:
    due = activation.with_sync_decision(sent, state_from(sent)).where(~F.col("unchanged"))
    return activation.classify_responses(due, responses(spark, sf_dir))


@query(f"{SQL_STATE} SELECT * FROM outcomes")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir, written_payloads(spark, sf_dir))


@query(
    f"""{SQL_STATE}
SELECT account_id, CASE WHEN o.digest IS NOT NULL THEN o.digest ELSE s.payload_hash END
    AS payload_hash,
  coalesce(o.score_version, s.score_version) AS score_version,
  coalesce(o.status, s.status) AS status,
  coalesce(s.attempts, 0) + CASE WHEN o.digest IS NULL THEN 0 ELSE 1 END AS attempts,
  CASE WHEN o.digest IS NULL THEN s.last_attempt_at ELSE TIMESTAMP '2024-01-31' END
    AS last_attempt_at,
  CASE WHEN o.status = 'synced' THEN TIMESTAMP '2024-01-31' ELSE s.last_success_at END
    AS last_success_at,
  coalesce(o.status_code, s.last_status_code) AS last_status_code,
  CASE WHEN o.digest IS NULL THEN s.last_error ELSE o.error END AS last_error
FROM state s FULL OUTER JOIN outcomes o USING (account_id)""",
    ts="last_attempt_at last_success_at",
)
def merged_sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = written_payloads(spark, sf_dir)
    return activation.merge_sync_state(state_from(sent), outcomes(spark, sf_dir, sent), CTX)


@query(f"""{SQL_STATE}, counts AS (
  SELECT (SELECT count(*) FROM decided) AS considered,
    (SELECT count(*) FROM decided WHERE unchanged) AS unchanged,
    count(*) AS sent, count(*) FILTER (WHERE status = 'synced') AS succeeded,
    count(*) FILTER (WHERE status = 'skipped_client_error') AS client_errors,
    count(*) FILTER (WHERE status = 'failed') AS server_errors
  FROM outcomes
)
SELECT *, CAST(server_errors AS DOUBLE) / sent AS error_rate,
  CAST(server_errors AS DOUBLE) / sent > 0.02 AS failed FROM counts""")
def sync_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = written_payloads(spark, sf_dir)
    decided = activation.with_sync_decision(sent, state_from(sent))
    return activation.sync_verdict(decided, outcomes(spark, sf_dir, sent))
