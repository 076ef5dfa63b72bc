"""The given tables in the shapes the operators take, and the same shapes as SQL.

Nothing is dropped or sampled: every row of a source table takes part, and what makes an event
late, a change redelivered or a message unreadable is read off the row's own values. The Spark side
writes row images and envelopes as JSON and lets the library parse them; the SQL side starts from
the plain columns, so the two meet only in their results.
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context
from tidemark.operators.latest import latest_per

# Orders end in August 2001 and events lie in January 2024; this many days bring them together.
SHIFT = 8216
NOW = datetime(2024, 1, 31, 0, 0, 0, tzinfo=UTC)
SNAPSHOT_AT = datetime(2024, 3, 1, tzinfo=UTC)
CTX = Context(now=NOW, spine_start=date(2017, 6, 1), spine_ahead_days=30)

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its timestamps read as UTC instants."""
    return in_utc(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def in_utc(df: DataFrame) -> DataFrame:
    zoned = {n: F.col(n).cast("timestamp") for n, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def iso(column: Column) -> Column:
    return F.date_format(column, ISO)


def shifted(column: str) -> Column:
    return F.col(column) + F.expr(f"interval {SHIFT} days")


def hours(count: Column) -> Column:
    return F.make_dt_interval(hours=count)


def _copies(further: Column) -> Column:
    """0 for a row itself, 1 as well where a further copy of it arrived."""
    return F.explode(F.when(further, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))


# ------------------------------------------------------------------ product events

EVENT_TYPES = {
    "view": "page_view",
    "click": "feature_invoked",
    "signup": "session_start",
    "purchase": "report_exported",
    "error": "api_called",
}

SQL_EVENTS = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), named AS (
  SELECT
    '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_uid,
    event_id AS source_id,
    CASE WHEN k = 50 THEN NULL ELSE user_id END AS account_id,
    user_id * 100 + k AS user_id,
    user_id % 6 AS partition_id,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'feature_invoked'
      WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'report_exported'
      ELSE 'api_called' END AS event_type,
    CASE WHEN event_type IN ('view', 'signup') THEN 'product.session'
      ELSE 'product.feature_usage' END AS topic,
    ts AS event_time,
    ts + INTERVAL 40 MILLISECOND AS received_at,
    CASE WHEN k >= 97 THEN INTERVAL 5 DAY WHEN k >= 90 THEN INTERVAL 2 DAY
      ELSE INTERVAL 1 MINUTE END AS delay,
    CASE WHEN k IN (13, 98) THEN 'backfill' ELSE 'live' END AS source_path,
    CASE WHEN k = 60 THEN NULL ELSE 'f' || CAST(k // 17 AS VARCHAR) END AS feature,
    CASE WHEN k < 50 THEN 'web' ELSE 'mobile' END AS surface,
    CASE WHEN value < 10 THEN 'basic' WHEN value < 20 THEN 'team' ELSE 'pro' END AS plan,
    CAST(floor(value * 100) AS BIGINT) AS duration_ms,
    k
  FROM ev
), raw_events AS (
  SELECT
    n.event_uid AS event_id, n.account_id, n.user_id, n.event_type, n.topic, n.partition_id,
    n.source_id + c.copy * 1000000000000000 AS kafka_offset,
    n.event_time, n.received_at,
    n.event_time + INTERVAL 1 SECOND + c.copy * INTERVAL 1 HOUR AS kafka_ts,
    n.event_time + n.delay + c.copy * INTERVAL 1 HOUR AS loaded_at,
    n.source_path, n.feature, n.surface, n.plan, n.duration_ms, n.k
  FROM named n CROSS JOIN (VALUES (0), (1)) AS c(copy)
  WHERE c.copy = 0 OR n.k < 3
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with the number in its JSON column beside it."""
    return with_number(table(spark, sf_dir, "events"))


def with_number(events_table: DataFrame) -> DataFrame:
    return events_table.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _event_fields() -> dict[str, Column]:
    k, value = F.col("k"), F.col("value")
    event_type = F.lit(None).cast("string")
    for given, name in EVENT_TYPES.items():
        event_type = F.when(F.col("event_type") == given, name).otherwise(event_type)
    return {
        "event_id": F.concat(
            F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0")
        ),
        "account_id": F.when(k != 50, F.col("user_id")),
        "user_id": F.col("user_id") * 100 + k,
        "event_type": event_type,
        "payload_struct": F.struct(
            F.when(k != 60, F.concat(F.lit("f"), F.expr("k div 17").cast("string"))).alias(
                "feature"
            ),
            F.when(k < 50, "web").otherwise("mobile").alias("surface"),
            F.when(value < 10, "basic").when(value < 20, "team").otherwise("pro").alias("plan"),
            F.floor(value * 100).alias("duration_ms"),
        ),
    }


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product events: a row per received copy."""
    return as_received(events(spark, sf_dir))


def as_received(numbered_events: DataFrame) -> DataFrame:
    k = F.col("k")
    delay = (
        F.when(k >= 97, F.expr("interval '5' day"))
        .when(k >= 90, F.expr("interval '2' day"))
        .otherwise(F.expr("interval '0 00:01:00' day to second"))
    )
    fields = _event_fields()
    session = F.col("event_type").isin("view", "signup")
    copies = numbered_events.withColumn("copy", _copies(k < 3))
    again = hours(F.col("copy"))
    loaded_at = F.col("ts") + delay + again
    return copies.select(
        F.to_date(loaded_at).alias("loaded_date"),
        F.when(session, "product.session").otherwise("product.feature_usage").alias("topic"),
        (F.col("user_id") % 6).cast("smallint").alias("partition_id"),
        (F.col("event_id") + F.col("copy") * F.lit(1_000_000_000_000_000)).alias("kafka_offset"),
        F.datediff(F.to_date(loaded_at), F.lit(date(2024, 1, 1))).cast("bigint").alias(
            "ledger_id"
        ),
        fields["event_id"].alias("event_id"),
        fields["account_id"].alias("account_id"),
        fields["user_id"].alias("user_id"),
        fields["event_type"].alias("event_type"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr("interval 40 milliseconds")).alias("received_at"),
        (F.col("ts") + F.expr("interval 1 second") + again).alias("kafka_ts"),
        loaded_at.alias("loaded_at"),
        F.when(k.isin(13, 98), "backfill").otherwise("live").alias("source_path"),
        F.to_json(fields["payload_struct"]).alias("payload"),
    )


# ------------------------------------------------------------------ the change log

SQL_SUBSCRIPTION_CHANGES = f"""sub_rows AS (
  SELECT
    o_custkey AS subscription_id,
    CASE WHEN o_totalprice < 5000 THEN 'd'
      WHEN o_orderdate < TIMESTAMP '1995-07-01' THEN 'r'
      WHEN o_totalprice > 490000 THEN 'c' ELSE 'u' END AS op,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10000000
      + o_orderkey AS source_lsn,
    o_orderdate + INTERVAL {SHIFT} DAY AS base_at,
    o_custkey AS account_id,
    o_orderpriority AS plan_code,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'trial'
      WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'cancelled'
      ELSE 'past_due' END AS status,
    CAST(1 + floor(o_totalprice / 100000) AS INTEGER) AS seats,
    (6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 10000 AS mrr_cents,
    o_totalprice, o_orderstatus
  FROM orders
), sub_changes AS (
  SELECT
    subscription_id, op, op = 'r' AS is_snapshot, source_lsn,
    base_at + INTERVAL 12 HOUR AS source_ts,
    CASE WHEN op = 'd' THEN base_at + INTERVAL 12 HOUR
      WHEN o_totalprice >= 488000 AND o_totalprice < 490000
        THEN base_at + seats * INTERVAL 1 HOUR - INTERVAL 400 DAY
      ELSE base_at + seats * INTERVAL 1 HOUR END AS effective_at,
    base_at + INTERVAL 13 HOUR AS loaded_at,
    'live' AS source_path,
    account_id, plan_code, status, seats, mrr_cents,
    base_at AS started_at,
    CASE WHEN o_orderstatus = 'F' THEN base_at + INTERVAL 1 DAY END AS ended_at,
    CASE WHEN op = 'd' THEN status
      WHEN op = 'u' AND o_totalprice < 250000 THEN 'active'
      WHEN op = 'u' THEN 'past_due' END AS previous_status
  FROM sub_rows
)"""

SQL_ACCOUNT_CHANGES = """acc_changes AS (
  SELECT
    c_custkey AS account_id,
    CASE WHEN i = 0 AND c_acctbal < 0 THEN 'r' WHEN i = 0 THEN 'c'
      WHEN i = 1 AND c_acctbal < 5200 THEN 'd' WHEN i = 1 THEN 'u' ELSE 'c' END AS op,
    c_custkey * 10 + i AS source_lsn,
    created_at,
    created_at + i * INTERVAL 1 DAY AS effective_at,
    created_at + i * INTERVAL 1 DAY + INTERVAL 1 HOUR AS source_ts,
    created_at + i * INTERVAL 1 DAY + INTERVAL 62 MINUTE AS loaded_at,
    (i = 0 AND c_acctbal < 0) AS is_snapshot,
    c_name || CASE WHEN i = 1 AND c_acctbal >= 5200 THEN ' v2' ELSE '' END AS company_name,
    'N' || CAST(c_nationkey AS VARCHAR) AS country
  FROM (
    SELECT *, TIMESTAMP '2023-11-20' + CAST(floor(c_acctbal / 200) AS INTEGER) * INTERVAL 1 DAY
      AS created_at
    FROM customer
  ) CROSS JOIN (VALUES (0), (1), (2)) AS n(i)
  WHERE i = 0 OR (i = 1 AND ((c_acctbal >= 5000 AND c_acctbal < 5200) OR c_acctbal > 9000))
    OR (i = 2 AND c_acctbal >= 5100 AND c_acctbal < 5200)
), account_exists AS (
  SELECT account_id, min(created_at) AS created_at FROM acc_changes GROUP BY account_id
)"""

SQL_INVOICE_CHANGES = f"""inv_ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate, (l_partkey * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT))
      AS arrival
  FROM lineitem
), inv_changes AS (
  SELECT
    l_orderkey AS invoice_id,
    CASE WHEN l_quantity = 50 AND l_discount < 0.01 THEN 'd'
      WHEN l_linenumber = 1 THEN 'c' ELSE 'u' END AS op,
    CAST(l_linenumber AS BIGINT) AS source_lsn,
    l_shipdate + INTERVAL {SHIFT} DAY AS effective_at,
    l_shipdate + INTERVAL {SHIFT} DAY + INTERVAL 1 HOUR AS loaded_at,
    l_orderkey // 10 AS account_id,
    'in_' || CAST(l_orderkey AS VARCHAR) AS provider_invoice_id,
    CAST(floor(l_extendedprice) AS INTEGER) AS amount_cents,
    CASE l_returnflag WHEN 'R' THEN 'payment_failed' WHEN 'A' THEN 'paid' ELSE 'open' END AS status,
    l_shipdate + INTERVAL {SHIFT} DAY AS issued_at,
    CASE WHEN l_returnflag = 'A' THEN l_shipdate + INTERVAL {SHIFT + 10} DAY END AS paid_at,
    CASE WHEN l_quantity = 50 AND l_discount < 0.01
        THEN CASE l_returnflag WHEN 'R' THEN 'payment_failed' WHEN 'A' THEN 'paid' ELSE 'open' END
      WHEN l_linenumber = 1 THEN NULL
      WHEN l_linestatus = 'F' THEN 'payment_failed' ELSE 'open' END AS previous_status
  FROM inv_ranked WHERE arrival = 1
)"""

SQL_TICKET_CHANGES = """ticket_changes AS (
  SELECT
    source_id AS ticket_id,
    CASE WHEN k < 2 THEN 'd' ELSE 'c' END AS op,
    source_id AS source_lsn,
    event_time AS effective_at,
    event_time + INTERVAL 2 MINUTE AS loaded_at,
    (user_id - k) // 100 AS account_id,
    CASE WHEN k >= 66 THEN 'high' WHEN k >= 33 THEN 'medium' ELSE 'low' END AS severity,
    event_time AS opened_at,
    CASE WHEN k >= 80 THEN event_time + INTERVAL 1 DAY END AS closed_at
  FROM named WHERE event_type = 'api_called'
)"""

SQL_USER_CHANGES = """user_changes AS (
  SELECT
    s_suppkey AS user_id,
    'c' AS op,
    s_suppkey AS source_lsn,
    TIMESTAMP '2023-01-01' AS effective_at,
    TIMESTAMP '2023-01-01 00:05:00' AS loaded_at,
    s_suppkey AS account_id,
    CASE WHEN s_nationkey < 5 THEN 'admin' ELSE 'member' END AS role,
    CASE WHEN s_acctbal >= 0
      THEN TIMESTAMP '2023-06-01' + CAST(floor(s_acctbal / 100) AS INTEGER) * INTERVAL 1 DAY END
      AS last_login_at,
    TIMESTAMP '2023-01-01' AS created_at
  FROM supplier
)"""


def _change_row(
    source_table: str,
    pk: Column,
    op: Column,
    account_id: Column,
    image: Column,
    before: Column,
    lsn: Column,
    source_ts: Column,
    effective_at: Column,
    loaded_at: Column,
    offset: Column,
) -> list[Column]:
    """One raw change: a delete has no after image, and its state in the before image."""
    return [
        F.to_date(loaded_at).alias("loaded_date"),
        F.lit(f"cdc.app.public.{source_table}").alias("topic"),
        F.lit(0).cast("smallint").alias("partition_id"),
        offset.cast("bigint").alias("kafka_offset"),
        F.lit(source_table).alias("source_table"),
        op.alias("op"),
        pk.cast("string").alias("pk"),
        account_id.alias("account_id"),
        F.when(op == "d", image).otherwise(before).alias("before"),
        F.when(op != "d", image).alias("after"),
        lsn.cast("bigint").alias("source_lsn"),
        source_ts.alias("source_ts"),
        effective_at.alias("effective_at"),
        (op == "r").alias("is_snapshot"),
        loaded_at.alias("kafka_ts"),
        loaded_at.alias("loaded_at"),
        F.lit("live").alias("source_path"),
    ]


def subscription_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as subscription states."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    op = (
        F.when(price < 5000, "d")
        .when(F.col("o_orderdate") < F.lit("1995-07-01").cast("timestamp"), "r")
        .when(price > 490000, "c")
        .otherwise("u")
    )
    day_number = F.datediff(F.to_date("o_orderdate"), F.lit(date(1970, 1, 1))).cast("bigint")
    plan = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        op.alias("op"),
        (day_number * 10_000_000 + F.col("o_orderkey")).alias("lsn"),
        shifted("o_orderdate").alias("base_at"),
        plan.alias("plan_code"),
        F.when((plan == "5-LOW") & (status == "P"), "trial")
        .when(status == "O", "active")
        .when(status == "F", "cancelled")
        .otherwise("past_due")
        .alias("status"),
        (1 + F.floor(price / 100000)).cast("int").alias("seats"),
        ((6 - F.substring(plan, 1, 1).cast("int")) * 10000).alias("mrr_cents"),
        price.alias("price"),
        status.alias("order_status"),
        F.col("o_orderkey").alias("order_key"),
    )


def subscription_changes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subscription_rows(spark, sf_dir).withColumn("copy", _copies(F.col("price") > 400000))
    price, op, base = F.col("price"), F.col("op"), F.col("base_at")
    source_ts = base + F.expr("interval 12 hours")
    in_time = base + hours(F.col("seats"))
    effective_at = (
        F.when(op == "d", source_ts)
        .when(
            (price >= 488000) & (price < 490000), in_time - F.expr("interval 400 days")
        )
        .otherwise(in_time)
    )
    image = F.to_json(
        F.struct(
            "id",
            F.col("id").alias("account_id"),
            "plan_code",
            "status",
            "seats",
            "mrr_cents",
            iso(base).alias("started_at"),
            F.when(F.col("order_status") == "F", iso(base + F.expr("interval 1 day"))).alias(
                "ended_at"
            ),
        )
    )
    was = F.when(price < 250000, "active").otherwise("past_due")
    before = F.when(op == "u", F.to_json(F.struct(was.alias("status"))))
    return rows.select(
        *_change_row(
            "subscriptions",
            F.col("id"),
            op,
            F.col("id"),
            image,
            before,
            F.col("lsn"),
            source_ts,
            effective_at,
            base + F.expr("interval 13 hours") + hours(F.col("copy")),
            F.col("order_key") * 2 + F.col("copy"),
        )
    )


def account_changes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, i = F.col("c_acctbal"), F.col("i")
    steps = (
        F.when((balance >= 5100) & (balance < 5200), 2)
        .when(((balance >= 5000) & (balance < 5100)) | (balance > 9000), 1)
        .otherwise(0)
    )
    created = F.lit("2023-11-20").cast("timestamp") + F.make_dt_interval(
        days=F.floor(balance / 200).cast("int")
    )
    rows = (
        table(spark, sf_dir, "customer")
        .withColumn("i", F.explode(F.sequence(F.lit(0), steps)))
        .withColumn("created", created)
        .withColumn("at", F.col("created") + F.make_dt_interval(days=i))
    )
    op = (
        F.when((i == 0) & (balance < 0), "r")
        .when(i == 0, "c")
        .when((i == 1) & (balance < 5200), "d")
        .when(i == 1, "u")
        .otherwise("c")
    )
    renamed = F.when((i == 1) & (balance >= 5200), " v2").otherwise("")
    image = F.to_json(
        F.struct(
            F.col("c_custkey").alias("id"),
            F.concat("c_name", renamed).alias("company_name"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"),
            iso(F.col("created")).alias("created_at"),
        )
    )
    return rows.select(
        *_change_row(
            "accounts",
            F.col("c_custkey"),
            op,
            F.col("c_custkey"),
            image,
            F.lit(None).cast("string"),
            F.col("c_custkey") * 10 + i,
            F.col("at") + F.expr("interval 1 hour"),
            F.col("at"),
            F.col("at") + F.expr("interval 62 minutes"),
            F.col("c_custkey") * 10 + i,
        )
    )


def invoice_changes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as invoice changes; repeated line numbers are redeliveries."""
    flag, first = F.col("l_returnflag"), F.col("l_linenumber") == 1
    issued = shifted("l_shipdate")
    op = (
        F.when((F.col("l_quantity") == 50) & (F.col("l_discount") < 0.01), "d")
        .when(first, "c")
        .otherwise("u")
    )
    status = F.when(flag == "R", "payment_failed").when(flag == "A", "paid").otherwise("open")
    was = F.when(F.col("l_linestatus") == "F", "payment_failed").otherwise("open")

    image = F.to_json(
        F.struct(
            F.col("l_orderkey").alias("id"),
            F.expr("l_orderkey div 10").alias("account_id"),
            F.concat(F.lit("in_"), F.col("l_orderkey").cast("string")).alias(
                "provider_invoice_id"
            ),
            F.floor("l_extendedprice").alias("amount_cents"),
            status.alias("status"),
            iso(issued).alias("issued_at"),
            F.when(flag == "A", iso(issued + F.expr("interval 10 days"))).alias("paid_at"),
        )
    )
    return table(spark, sf_dir, "lineitem").select(
        *_change_row(
            "invoices",
            F.col("l_orderkey"),
            op,
            F.expr("l_orderkey div 10"),
            image,
            F.when(op == "u", F.to_json(F.struct(was.alias("status")))),
            F.col("l_linenumber"),
            issued,
            issued,
            issued + F.expr("interval 1 hour"),
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 100
            + F.col("l_quantity").cast("bigint"),
        )
    )


def ticket_changes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("k"), F.col("ts")
    op = F.when(k < 2, "d").otherwise("c")
    image = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("account_id"),
            F.when(k >= 66, "high").when(k >= 33, "medium").otherwise("low").alias("severity"),
            iso(at).alias("opened_at"),
            F.when(k >= 80, iso(at + F.expr("interval 1 day"))).alias("closed_at"),
        )
    )
    return (
        events(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .select(
            *_change_row(
                "support_tickets",
                F.col("event_id"),
                op,
                F.col("user_id"),
                image,
                F.lit(None).cast("string"),
                F.col("event_id"),
                at,
                at,
                at + F.expr("interval 2 minutes"),
                F.col("event_id"),
            )
        )
    )


def user_changes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("s_acctbal")
    start = F.lit("2023-01-01").cast("timestamp")
    login = F.lit("2023-06-01").cast("timestamp") + F.make_dt_interval(
        days=F.floor(balance / 100).cast("int")
    )
    image = F.to_json(
        F.struct(
            F.col("s_suppkey").alias("id"),
            F.col("s_suppkey").alias("account_id"),
            F.col("s_name").alias("email"),
            F.when(F.col("s_nationkey") < 5, "admin").otherwise("member").alias("role"),
            F.when(balance >= 0, iso(login)).alias("last_login_at"),
            iso(start).alias("created_at"),
        )
    )
    return table(spark, sf_dir, "supplier").select(
        *_change_row(
            "users",
            F.col("s_suppkey"),
            F.lit("c"),
            F.col("s_suppkey"),
            image,
            F.lit(None).cast("string"),
            F.col("s_suppkey"),
            start,
            start,
            start + F.expr("interval 5 minutes"),
            F.col("s_suppkey"),
        )
    )


_CHANGE_SOURCES = {
    "subscriptions": subscription_changes_raw,
    "accounts": account_changes_raw,
    "invoices": invoice_changes_raw,
    "support_tickets": ticket_changes_raw,
    "users": user_changes_raw,
}


def cdc_changes(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """The change log of some source tables, or of all.

    The raw layer keeps it partitioned by source table, so a model reads its own table's files only;
    naming the tables here stands for that.
    """
    names = tables or tuple(_CHANGE_SOURCES)
    log = _CHANGE_SOURCES[names[0]](spark, sf_dir)
    for name in names[1:]:
        log = log.unionByName(_CHANGE_SOURCES[name](spark, sf_dir))
    return log


# ------------------------------------------------------------------ billing

SQL_BILLING = f"""hooks AS (
  SELECT
    'evt_' || CAST(l_orderkey AS VARCHAR) AS provider_event_id,
    CASE l_returnflag WHEN 'R' THEN 'invoice.payment_failed' WHEN 'A' THEN 'invoice.paid'
      ELSE 'invoice.created' END AS event_type,
    l_orderkey // 10 AS account_id,
    l_shipdate + INTERVAL {SHIFT} DAY AS provider_created_at,
    l_shipdate + INTERVAL {SHIFT} DAY + l_linenumber * INTERVAL 1 MINUTE AS received_at
  FROM lineitem WHERE l_linestatus = 'F'
), pulled AS (
  SELECT
    'evt_' || CAST(o_orderkey AS VARCHAR) AS provider_event_id,
    CASE o_orderstatus WHEN 'F' THEN 'invoice.paid' WHEN 'P' THEN 'invoice.payment_failed'
      ELSE 'invoice.created' END AS event_type,
    o_orderkey // 10 AS account_id,
    o_orderdate + INTERVAL {SHIFT} DAY AS provider_created_at,
    o_orderdate + INTERVAL {SHIFT + 1} DAY AS pulled_at,
    '{{"id":"evt_' || CAST(o_orderkey AS VARCHAR) || '"}}' AS payload
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01'
), hook_ids AS (
  SELECT provider_event_id, min(event_type) AS event_type, min(account_id) AS account_id,
    min(provider_created_at) AS provider_created_at, min(received_at) AS webhook_received_at,
    count(*) AS webhook_deliveries
  FROM hooks GROUP BY provider_event_id
), billing AS (
  SELECT
    coalesce(w.provider_event_id, b.provider_event_id) AS provider_event_id,
    coalesce(w.event_type, b.event_type) AS event_type,
    coalesce(w.account_id, b.account_id) AS account_id,
    coalesce(w.provider_created_at, b.provider_created_at) AS provider_created_at,
    w.webhook_received_at, b.pulled_at AS batch_pulled_at,
    coalesce(w.webhook_deliveries, 0) AS webhook_deliveries,
    CASE WHEN w.provider_event_id IS NOT NULL AND b.provider_event_id IS NOT NULL THEN 'both'
      WHEN w.provider_event_id IS NOT NULL THEN 'webhook_only' ELSE 'batch_only' END AS arrived_by,
    w.provider_event_id IS NULL AS webhook_missed,
    b.provider_event_id IS NULL AS not_yet_reconciled,
    b.payload
  FROM hook_ids w FULL OUTER JOIN pulled b ON w.provider_event_id = b.provider_event_id
), reconciliation AS (
  SELECT CAST(provider_created_at AS DATE) AS billing_day, count(*) AS events,
    count(*) FILTER (WHERE arrived_by = 'both') AS both_paths,
    count(*) FILTER (WHERE webhook_missed) AS webhook_missed,
    count(*) FILTER (WHERE webhook_deliveries > 1) AS duplicate_deliveries,
    ((count(*) FILTER (WHERE webhook_missed)) * 20000 + count(*)) // (2 * count(*)) / 10000.0
      AS webhook_miss_rate
  FROM billing WHERE NOT not_yet_reconciled GROUP BY 1
)"""


def billing_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that arrived: one per fulfilled line, so some events have several or none."""
    flag = F.col("l_returnflag")
    created = shifted("l_shipdate")
    received = created + F.make_dt_interval(mins=F.col("l_linenumber"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linestatus") == "F")
        .select(
            F.concat(F.lit("evt_"), F.col("l_orderkey").cast("string")).alias("provider_event_id"),
            F.when(flag == "R", "invoice.payment_failed")
            .when(flag == "A", "invoice.paid")
            .otherwise("invoice.created")
            .alias("event_type"),
            F.expr("l_orderkey div 10").alias("account_id"),
            created.alias("provider_created_at"),
            received.alias("received_at"),
            received.alias("loaded_at"),
        )
    )


def billing_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the provider lists, in the order it lists it."""
    status = F.col("o_orderstatus")
    event_id = F.concat(F.lit("evt_"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        event_id.alias("provider_event_id"),
        F.when(status == "F", "invoice.paid")
        .when(status == "P", "invoice.payment_failed")
        .otherwise("invoice.created")
        .alias("event_type"),
        F.expr("o_orderkey div 10").alias("account_id"),
        shifted("o_orderdate").alias("provider_created_at"),
        (shifted("o_orderdate") + F.expr("interval 1 day")).alias("pulled_at"),
        F.to_json(F.struct(event_id.alias("id"))).alias("payload"),
        F.col("o_orderkey").alias("fetch_order"),
        F.col("o_orderdate").alias("listed_at"),
    )


def billing_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the daily pull holds: everything listed before its last run."""
    held = F.col("listed_at") < F.lit("2001-07-01").cast("timestamp")
    return billing_offered(spark, sf_dir).where(held).drop("fetch_order", "listed_at")


# ------------------------------------------------------------------ snapshots

SQL_SNAPSHOT = """latest_sub AS (
  SELECT * FROM sub_changes
  QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY source_lsn DESC) = 1
), photographed AS (
  SELECT subscription_id, CASE WHEN seats = 5 THEN 'active' ELSE status END AS status, seats,
    plan_code
  FROM latest_sub WHERE op <> 'd'
)"""


def oltp_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photograph of subscriptions as they ended, with some statuses the log does not have."""
    newest = latest_per(subscription_rows(spark, sf_dir), ["id"], ["lsn"]).where(
        F.col("op") != "d"
    )
    seen = F.when(F.col("seats") == 5, "active").otherwise(F.col("status"))
    return newest.select(
        F.lit(SNAPSHOT_AT.strftime("%Y-%m-%d")).cast("timestamp").alias("snapshot_at"),
        F.lit("subscriptions").alias("source_table"),
        F.col("id").cast("string").alias("pk"),
        F.to_json(
            F.struct(
                "id",
                F.col("id").alias("account_id"),
                "plan_code",
                seen.alias("status"),
                "seats",
                "mrr_cents",
            )
        ).alias("row_data"),
    )


def cdc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap in this log was closed: one per year in which changes were made."""
    year = F.date_trunc("year", "o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(year.alias("detected_at"))
        .agg(F.max("o_orderdate").alias("resolved_at"))
        .withColumn("reason", F.lit("slot invalidated"))
    )
