"""Sending account health back to the product: what changed, what came of it, what to remember."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.functions import at

SYNCED, FAILED, SKIPPED = "synced", "failed", "skipped_client_error"

# Error share above which a run has failed, and how much of a reply is kept.
MAX_ERROR_RATE = 0.02
REPLY_LIMIT = 200
DIGEST_PREFIX = 16


def sync_payloads(health: DataFrame) -> DataFrame:
    """The message per account, its content digest and its idempotency key.

    Members are in name order, so equal content is equal text.
    """
    message = F.struct(
        F.col("account_id"),
        F.date_format("as_of_date", "yyyy-MM-dd").alias("as_of_date"),
        F.col("churn_band"),
        F.col("churn_score").cast("int").alias("churn_score"),
        F.col("reasons"),
        F.col("score_version"),
    )
    written = F.to_json(message, {"ignoreNullFields": "false"})
    return (
        health.withColumn("payload", written)
        .withColumn("digest", F.sha2("payload", 256))
        .select(
            "account_id",
            F.col("churn_score").cast("int").alias("churn_score"),
            "score_version",
            "payload",
            "digest",
            F.concat_ws(
                ":",
                F.col("account_id").cast("string"),
                "score_version",
                F.substring("digest", 1, DIGEST_PREFIX),
            ).alias("idempotency_key"),
        )
    )


def with_sync_decision(payloads: DataFrame, state: DataFrame) -> DataFrame:
    """Each payload beside what was last delivered, and whether it has to be sent."""
    held = state.select(
        "account_id",
        F.col("payload_hash").alias("previous_hash"),
        F.col("status").alias("previous_status"),
    )
    delivered = F.col("previous_hash").eqNullSafe(F.col("digest")) & F.coalesce(
        F.col("previous_status").isin(SYNCED, SKIPPED), F.lit(False)
    )
    return payloads.join(held, "account_id", "left").withColumn("unchanged", delivered)


def sync_candidates(payloads: DataFrame, state: DataFrame) -> DataFrame:
    """What has to be sent, riskiest accounts first."""
    due = with_sync_decision(payloads, state).where(~F.col("unchanged")).drop("unchanged")
    return due.orderBy(F.desc("churn_score"), "account_id")


def classify_responses(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """What came of each delivery: accepted, refused for good, or failed."""
    code = F.col("status_code")
    status = (
        F.when(code.between(200, 299), SYNCED)
        .when(code.between(400, 499), SKIPPED)
        .otherwise(FAILED)
    )
    reply = F.concat_ws(": ", code.cast("string"), F.substring("body", 1, REPLY_LIMIT))
    return candidates.join(responses, "account_id").select(
        "account_id",
        "digest",
        "score_version",
        "status_code",
        status.alias("status"),
        F.when(status != SYNCED, reply).alias("error"),
    )


def merge_sync_state(state: DataFrame, outcomes: DataFrame, ctx: Context) -> DataFrame:
    """Delivery state after a run; the last success outlives later failures."""
    fresh = outcomes.select(
        "account_id",
        F.col("digest").alias("_digest"),
        F.col("score_version").alias("_version"),
        F.col("status").alias("_status"),
        F.col("status_code").alias("_code"),
        F.col("error").alias("_error"),
        F.lit(True).alias("_sent"),
    )
    sent = F.col("_sent").isNotNull()

    def newer(fresh_column, held: str):
        return F.when(sent, fresh_column).otherwise(F.col(held)).alias(held)

    succeeded = F.when(F.col("_status") == SYNCED, at(ctx.now))
    return state.join(fresh, "account_id", "full_outer").select(
        "account_id",
        newer(F.col("_digest"), "payload_hash"),
        newer(F.col("_version"), "score_version"),
        newer(F.col("_status"), "status"),
        (F.coalesce("attempts", F.lit(0)) + F.when(sent, 1).otherwise(0)).alias("attempts"),
        newer(at(ctx.now), "last_attempt_at"),
        F.coalesce(succeeded, F.col("last_success_at")).alias("last_success_at"),
        newer(F.col("_code"), "last_status_code"),
        newer(F.col("_error"), "last_error"),
    )


def sync_verdict(
    decided: DataFrame, outcomes: DataFrame, max_rate: float = MAX_ERROR_RATE
) -> DataFrame:
    """One row of counts for a run, and whether it failed by its error rate."""
    zero = F.lit(0).cast("bigint")
    considered = decided.agg(
        F.count(F.lit(1)).alias("considered"), F.count_if("unchanged").alias("unchanged")
    )
    sent = outcomes.agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("status") == SYNCED).alias("succeeded"),
        F.count_if(F.col("status") == SKIPPED).alias("client_errors"),
        F.count_if(F.col("status") == FAILED).alias("server_errors"),
    )
    both = considered.unionByName(sent, allowMissingColumns=True)
    names = ("considered", "unchanged", "sent", "succeeded", "client_errors", "server_errors")
    counts = both.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])
    rate = F.when(
        F.col("sent") != 0, F.col("server_errors").cast("double") / F.col("sent")
    ).otherwise(F.lit(0.0))
    return counts.withColumn("error_rate", rate).withColumn(
        "failed", F.col("error_rate") > F.lit(max_rate)
    )
