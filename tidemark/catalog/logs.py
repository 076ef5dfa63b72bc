"""The given tables as message logs: envelopes as bytes, some of them unreadable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.inputs import (
    SHIFT,
    _event_fields,
    events,
    iso,
    shifted,
    subscription_rows,
    table,
)

EVENT_TOPIC = "product.events"
CDC_TOPIC = "cdc.app.public.subscriptions"
BILLING_TOPIC = "billing.webhooks"

# Messages whose number in the JSON column is one of these cannot be turned into a row.
POISON = (7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: offsets run without holes in each of six partitions."""
    return as_messages(events(spark, sf_dir))


def as_messages(numbered_events: DataFrame) -> DataFrame:
    fields = _event_fields()
    k = F.col("k")
    envelope = F.to_json(
        F.struct(
            F.when(k == 16, "not-a-uuid").otherwise(fields["event_id"]).alias("event_id"),
            F.when(k == 17, "").when(k != 8, fields["event_type"]).alias("event_type"),
            F.when(k == 12, "yesterday").otherwise(iso(F.col("ts"))).alias("event_time"),
            F.when(k != 8, iso(F.col("ts") + F.expr("interval 40 milliseconds"))).alias(
                "received_at"
            ),
            F.when(~k.isin(14, 50), F.col("user_id")).alias("account_id"),
            F.when(k != 18, fields["user_id"]).alias("user_id"),
            F.when(k != 15, fields["payload_struct"]).alias("payload"),
        )
    )
    # Members that a typed struct cannot hold are appended as text before the closing brace.
    text = (
        F.when(k == 7, "{not json at all")
        .when(k == 9, F.lit(None).cast("string"))
        .when(k == 11, "[1]")
        .when(k == 19, "null")
        .when(k == 14, F.regexp_replace(envelope, r"\}$", ',"account_id":true}'))
        .when(k == 15, F.regexp_replace(envelope, r"\}$", ',"payload":[]}'))
        .when(k == 18, F.regexp_replace(envelope, r"\}$", ',"user_id":1.5}'))
        .otherwise(envelope)
    )
    return numbered_events.select(
        F.lit(EVENT_TOPIC).alias("topic"),
        (F.col("event_id") % 6).cast("int").alias("partition"),
        F.expr("event_id div 6").alias("offset"),
        (F.col("ts") + F.expr("interval 1 second")).alias("timestamp"),
        F.col("user_id").cast("string").cast("binary").alias("key"),
        text.cast("binary").alias("value"),
    )


SQL_EVENT_LOG = """messages AS (
  SELECT 'product.events' AS topic, CAST(source_id % 6 AS INTEGER) AS partition,
    source_id // 6 AS "offset", event_time, received_at, event_uid, account_id, user_id,
    event_type, feature, surface, plan, duration_ms, k,
    CASE k WHEN 7 THEN 'invalid_json: not parseable'
      WHEN 8 THEN 'missing_envelope_fields: event_type,received_at'
      WHEN 9 THEN 'tombstone_on_event_topic'
      WHEN 11 THEN 'envelope_not_object' WHEN 19 THEN 'envelope_not_object'
      WHEN 12 THEN 'invalid_envelope: event_time must be an ISO timestamp'
      WHEN 14 THEN 'invalid_envelope: account_id must be an integer'
      WHEN 15 THEN 'invalid_envelope: payload must be an object'
      WHEN 16 THEN 'invalid_envelope: event_id must be a uuid'
      WHEN 17 THEN 'invalid_envelope: event_type must be a non-empty string'
      WHEN 18 THEN 'invalid_envelope: user_id must be an integer' END AS reason
  FROM named
), ok_messages AS (
  SELECT *, '{"duration_ms":' || CAST(duration_ms AS VARCHAR)
      || coalesce(',"feature":"' || feature || '"', '')
      || ',"plan":"' || plan || '","surface":"' || surface || '"}' AS payload
  FROM messages WHERE reason IS NULL
)"""


def _micros(at: Column) -> Column:
    return F.unix_micros(at)


def cdc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription changes as change envelopes, bare or wrapped, with dates in three spellings."""
    rows = subscription_rows(spark, sf_dir)
    price, op, base = F.col("price"), F.col("op"), F.col("base_at")
    key_number = F.col("order_key")
    as_micros = price < 100000
    by_update = (price >= 100000) & (price < 150000)
    bad_text = (price >= 150000) & (price < 160000)
    image = F.struct(
        "id",
        F.col("id").alias("account_id"),
        "plan_code",
        "status",
        "seats",
        "mrr_cents",
        F.when(bad_text, "soon").when(~as_micros & ~by_update, iso(base)).alias("effective_at"),
        F.when(by_update, iso(base)).alias("updated_at"),
        F.when(as_micros, _micros(base)).alias("created_at"),
    )
    # Some messages lack what their kind needs.
    lost_after = (price >= 200000) & (price < 205000)
    lost_lsn = (price >= 210000) & (price < 215000)
    odd_op = (price >= 220000) & (price < 225000)
    lost_before = (op == "d") & (price < 2000)
    tombstone = (price >= 230000) & (price < 235000)
    lost_source = (price >= 240000) & (price < 245000)
    change = F.struct(
        F.when((op == "d") & ~lost_before, image).alias("before"),
        F.when((op != "d") & ~lost_after, image).alias("after"),
        F.when(odd_op, "x").otherwise(op).alias("op"),
        F.unix_millis(base + F.expr("interval 12 hours")).alias("ts_ms"),
        F.when(
            ~lost_source,
            F.struct(
                F.lit("app").alias("db"),
                F.lit("subscriptions").alias("table"),
                F.when(~lost_lsn, F.col("lsn")).alias("lsn"),
                F.when(price < 300000, F.unix_millis(base + F.expr("interval 12 hours"))).alias(
                    "ts_ms"
                ),
                F.when(op == "r", "last").otherwise("false").alias("snapshot"),
            ),
        ).alias("source"),
    )
    wrapped = F.to_json(F.struct(change.alias("payload")))
    text = F.when(price >= 350000, wrapped).otherwise(F.to_json(change))
    keyless = price >= 450000
    return rows.select(
        F.lit(CDC_TOPIC).alias("topic"),
        (key_number % 3).cast("int").alias("partition"),
        F.expr("order_key div 3").alias("offset"),
        (base + F.expr("interval 13 hours")).alias("timestamp"),
        F.when(~keyless, F.to_json(F.struct("id")).cast("binary")).alias("key"),
        F.when(~tombstone, text.cast("binary")).alias("value"),
    )


SQL_CDC_LOG = f"""cdc_messages AS (
  SELECT CAST(o_orderkey % 3 AS INTEGER) AS partition, o_orderkey // 3 AS "offset", s.*,
    CAST(s.subscription_id AS VARCHAR) AS pk,
    CASE WHEN o.o_totalprice >= 230000 AND o.o_totalprice < 235000 THEN 'skip'
      ELSE 'data' END AS kind,
    CASE
      WHEN o.o_totalprice >= 220000 AND o.o_totalprice < 225000 THEN 'invalid_op: ''x'''
      WHEN o.o_totalprice >= 240000 AND o.o_totalprice < 245000 THEN 'missing_source_block'
      WHEN o.o_totalprice >= 210000 AND o.o_totalprice < 215000 THEN 'missing_source_lsn'
      WHEN s.op = 'd' AND o.o_totalprice < 2000 THEN 'delete_without_before_image'
      WHEN s.op <> 'd' AND o.o_totalprice >= 200000 AND o.o_totalprice < 205000
        THEN s.op || '_without_after_image' END AS reason,
    CASE WHEN s.op = 'd' OR (o.o_totalprice >= 150000 AND o.o_totalprice < 160000)
      THEN s.base_at + INTERVAL 12 HOUR ELSE s.base_at END AS business_time
  FROM orders o JOIN sub_rows s ON s.source_lsn =
    CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) * 10000000
      + o.o_orderkey
)"""


def billing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as billing notifications."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    created = shifted("o_orderdate")

    def band(low: int) -> Column:
        return (price >= low) & (price < low + 5000)

    body = F.to_json(
        F.struct(
            F.when(~band(100000), F.concat(F.lit("evt_"), F.col("o_orderkey").cast("string")))
            .alias("id"),
            F.when(~band(110000), F.concat(F.lit("invoice."), F.lower(status))).alias("type"),
            F.when(band(120000), "someday").when(~band(130000), iso(created)).alias("created_at"),
            F.when(price >= 250000, iso(created + F.expr("interval 5 minutes"))).alias(
                "received_at"
            ),
            F.when(~band(140000) & ~band(150000) & ~band(160000), F.expr("o_orderkey div 10"))
            .alias("account_id"),
        )
    )
    text = (
        F.when(band(140000), F.regexp_replace(body, r"\}$", ',"account_id":"seven"}'))
        .when(band(150000), F.regexp_replace(body, r"\}$", ',"account_id":true}'))
        .when(band(170000), F.lit(None).cast("string"))
        .when(band(180000), "{")
        .otherwise(body)
    )
    return table(spark, sf_dir, "orders").select(
        F.lit(BILLING_TOPIC).alias("topic"),
        (F.col("o_orderkey") % 2).cast("int").alias("partition"),
        F.expr("o_orderkey div 2").alias("offset"),
        (created + F.expr("interval 6 minutes")).alias("timestamp"),
        F.lit(None).cast("binary").alias("key"),
        text.cast("binary").alias("value"),
    )


SQL_BILLING_LOG = f"""billing_messages AS (
  SELECT CAST(o_orderkey % 2 AS INTEGER) AS partition, o_orderkey // 2 AS "offset",
    'evt_' || CAST(o_orderkey AS VARCHAR) AS provider_event_id,
    'invoice.' || lower(o_orderstatus) AS event_type,
    o_orderdate + INTERVAL {SHIFT} DAY AS provider_created_at,
    CASE WHEN o_totalprice >= 250000 THEN o_orderdate + INTERVAL {SHIFT} DAY + INTERVAL 5 MINUTE
      ELSE o_orderdate + INTERVAL {SHIFT} DAY END AS received_at,
    CASE WHEN o_totalprice >= 150000 AND o_totalprice < 155000 THEN 1
      WHEN o_totalprice >= 160000 AND o_totalprice < 165000 THEN NULL
      ELSE o_orderkey // 10 END AS account_id,
    CASE WHEN o_totalprice >= 170000 AND o_totalprice < 175000 THEN 'tombstone_on_billing_topic'
      WHEN o_totalprice >= 180000 AND o_totalprice < 185000 THEN 'invalid_json: not parseable'
      WHEN o_totalprice >= 100000 AND o_totalprice < 105000 THEN 'missing_provider_event_id'
      WHEN o_totalprice >= 110000 AND o_totalprice < 115000 THEN 'missing_event_type'
      WHEN (o_totalprice >= 120000 AND o_totalprice < 125000)
        OR (o_totalprice >= 130000 AND o_totalprice < 135000)
        THEN 'invalid_timestamps: created_at and received_at must be ISO timestamps'
      WHEN o_totalprice >= 140000 AND o_totalprice < 145000 THEN 'invalid_account_id' END AS reason
  FROM orders
)"""


# ------------------------------------------------------------------ ledgers over the logs


def _ledger(messages: DataFrame) -> DataFrame:
    """What a daily load of these messages would have recorded, repeated once on partition 0."""
    entries = messages.groupBy("topic", "partition", F.to_date("ts").alias("loaded_date")).agg(
        F.min("offset").alias("start_offset"),
        (F.max("offset") + 1).alias("end_offset"),
        F.count_if(~F.col("k").isin(*POISON)).alias("row_count"),
        F.count_if(F.col("k").isin(*POISON)).alias("dlq_count"),
    )
    tries = F.when(F.col("partition") == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    run_id = F.concat(F.lit("run-"), F.col("loaded_date").cast("string"))
    written = (F.date_add("loaded_date", 1)).cast("timestamp")
    return entries.withColumn("attempt", F.explode(tries)).select(
        F.shiftrightunsigned(F.xxhash64(run_id, "topic", "partition"), 1).alias("ledger_id"),
        run_id.alias("dag_run_id"),
        "topic",
        F.col("partition").cast("smallint").alias("partition_id"),
        "start_offset",
        "end_offset",
        "loaded_date",
        "row_count",
        "dlq_count",
        F.lit(0).cast("bigint").alias("erased_count"),
        F.lit(0).cast("bigint").alias("skipped_count"),
        "attempt",
        (written + F.make_dt_interval(mins=F.col("partition"))).alias("created_at"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event sits in the log, without its envelope."""
    return events(spark, sf_dir).select(
        F.lit(EVENT_TOPIC).alias("topic"),
        (F.col("event_id") % 6).cast("int").alias("partition"),
        F.expr("event_id div 6").alias("offset"),
        "ts",
        "k",
        "event_type",
    )


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(event_messages(spark, sf_dir))


def family_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger per event type over the same offsets, so its ranges do not meet."""
    return _ledger(
        event_messages(spark, sf_dir).withColumn(
            "topic", F.concat(F.lit("product."), F.col("event_type"))
        )
    )


def _sql_ledger(name: str, topic: str) -> str:
    return f"""{name} AS (
  SELECT {topic} AS topic, CAST(event_id % 6 AS INTEGER) AS partition,
    CAST(ts AS DATE) AS loaded_date, min(event_id // 6) AS start_offset,
    max(event_id // 6) + 1 AS end_offset,
    count(*) FILTER (WHERE k NOT IN (7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19)) AS row_count,
    count(*) FILTER (WHERE k IN (7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19)) AS dlq_count,
    CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)
      + CAST(event_id % 6 AS INTEGER) * INTERVAL 1 MINUTE AS created_at,
    CASE WHEN event_id % 6 = 0 THEN 2 ELSE 1 END AS attempt
  FROM ev GROUP BY ALL
)"""


SQL_EVENT_LEDGER = _sql_ledger("ledger", "'product.events'")
SQL_FAMILY_LEDGER = _sql_ledger("family_ledger", "'product.' || event_type")
