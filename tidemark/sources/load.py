"""The micro-batch load: read claimed ranges, parse, split, erase, land, and commit by ledger.

Rows and their ledger entry have to become visible together, and a rerun of a run id has to replace
what it wrote before. Parquet has no transactions, so visibility is decided by the ledger:

* a run lands its rows under a batch id of its own, then appends its ledger entries, naming that
  batch; the append is the commit;
* readers keep landed rows whose (batch, ledger entry) is the entry's latest attempt. Files of a
  run that died before its commit, and files of replaced attempts, are never seen;
* a rerun with nothing left to write still commits a new attempt, and so hides the old rows.

All of a run's topic partitions are one Spark job, and every record is parsed once: good rows, dead
letters and skipped records go to one landing table, partitioned by disposition, in one write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.context import Context, kept
from tidemark.functions import at
from tidemark.sources.envelopes import (
    DEAD,
    ERASED,
    OK,
    SKIP,
    parse_billing_webhooks,
    parse_cdc_changes,
    parse_product_events,
    raw_text,
)
from tidemark.sources.files import create_once, delete, read_text
from tidemark.sources.log import (
    SLOT,
    assert_contiguous,
    assert_retained,
    claim_ranges,
    latest_attempts,
    read_range,
    run_ranges,
)
from tidemark.sources.log_table import Log, bounds_of, records_of, settings

# Records per topic partition and run, live and for history replays.
LIVE_MAX_RECORDS = 50_000
BACKFILL_MAX_RECORDS = 200_000

SLOT_IN_LEDGER = ("topic", "partition_id")


class ClaimConflict(RuntimeError):
    """Another run has committed some of the same records."""


LEDGER_SCHEMA = (
    "ledger_id BIGINT, dag_run_id STRING, topic STRING, partition_id SMALLINT, "
    "start_offset BIGINT, end_offset BIGINT, loaded_date DATE, row_count BIGINT, "
    "dlq_count BIGINT, erased_count BIGINT, skipped_count BIGINT, attempt INT, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, target STRING, batch STRING"
)
RANGE_SCHEMA = (
    "topic STRING, partition INT, start_offset BIGINT, end_offset BIGINT, loaded_date DATE, "
    "attempt INT"
)
BOUNDS_SCHEMA = "topic STRING, partition INT, earliest BIGINT, high_water BIGINT"
_SLOT_COLUMNS = {"loaded_date": "DATE", "topic": "STRING", "partition_id": "SMALLINT"}
_LOAD_COLUMNS = {"kafka_offset": "BIGINT", "ledger_id": "BIGINT"}
_CLOCK_COLUMNS = {"kafka_ts": "TIMESTAMP", "loaded_at": "TIMESTAMP", "source_path": "STRING"}
#: A batch lands under one load date, or a few where parts of it are repeated. A task keeps a file open
#: for each, and only one that meets more of them sorts its rows by date first.
_UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": "8"}
_DEAD_COLUMNS = {"reason": "STRING", "raw_value": "STRING"}


@dataclass(frozen=True)
class LoadTarget:
    """One stream: how its messages parse, which columns it lands, what backfills sort by."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    columns: dict[str, str]
    sort_key: str

    @property
    def raw_columns(self) -> list[str]:
        return [*_SLOT_COLUMNS, *_LOAD_COLUMNS, *self.columns, *_CLOCK_COLUMNS]

    @property
    def landing_schema(self) -> str:
        fields = {**_SLOT_COLUMNS, **_LOAD_COLUMNS, **self.columns, **_CLOCK_COLUMNS}
        fields |= {**_DEAD_COLUMNS, "batch": "STRING", "disposition": "STRING"}
        return ", ".join(f"{name} {kind}" for name, kind in fields.items())


PRODUCT_EVENTS = LoadTarget(
    "product_events",
    parse_product_events,
    {
        "event_id": "STRING",
        "account_id": "BIGINT",
        "user_id": "BIGINT",
        "event_type": "STRING",
        "event_time": "TIMESTAMP",
        "received_at": "TIMESTAMP",
        "payload": "STRING",
    },
    sort_key="event_time",
)
CDC_CHANGES = LoadTarget(
    "cdc_changes",
    parse_cdc_changes,
    {
        "source_table": "STRING",
        "op": "STRING",
        "pk": "STRING",
        "account_id": "BIGINT",
        "before": "STRING",
        "after": "STRING",
        "source_lsn": "BIGINT",
        "source_ts": "TIMESTAMP",
        "effective_at": "TIMESTAMP",
        "is_snapshot": "BOOLEAN",
    },
    sort_key="source_lsn",
)
BILLING_WEBHOOKS = LoadTarget(
    "billing_webhook_events",
    parse_billing_webhooks,
    {
        "provider_event_id": "STRING",
        "event_type": "STRING",
        "account_id": "BIGINT",
        "provider_created_at": "TIMESTAMP",
        "received_at": "TIMESTAMP",
        "payload": "STRING",
    },
    sort_key="provider_created_at",
)
TARGETS = {t.name: t for t in (PRODUCT_EVENTS, CDC_CHANGES, BILLING_WEBHOOKS)}


def drop_erased(rows: DataFrame, erasure: DataFrame) -> DataFrame:
    """Rows of accounts that asked for erasure removed; rows without an account stay."""
    return rows.join(erasure.select("account_id"), "account_id", "left_anti")


def mark_erased(parsed: DataFrame, erasure: DataFrame) -> DataFrame:
    """Good rows of erased accounts get their own disposition, so that they can be counted."""
    # Accounts are few beside messages. Written, their size is known, and where it allows Spark sends
    # them to the messages instead of shuffling and sorting every message by account.
    asked = kept(erasure.select("account_id").distinct()).withColumn("_asked", F.lit(True))
    gone = (F.col("disposition") == OK) & F.coalesce(F.col("_asked"), F.lit(False))
    return (
        parsed.join(asked, "account_id", "left")
        .withColumn("disposition", F.when(gone, ERASED).otherwise(F.col("disposition")))
        .drop("_asked")
    )


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good, dead and skipped records as three views of one parsed log."""
    kind = F.col("disposition")
    return parsed.where(kind == OK), parsed.where(kind == DEAD), parsed.where(kind == SKIP)


def split_counts(parsed: DataFrame, *by: str) -> DataFrame:
    """How many records the three views of a parsed log hold, parsing it once for all of them."""
    names = {"good": OK, "dead": DEAD, "skipped": SKIP}
    return parsed.groupBy(*by).agg(
        *[F.count_if(F.col("disposition") == kind).alias(name) for name, kind in names.items()]
    )


def dlq_rows(parsed: DataFrame) -> DataFrame:
    """Dead letters: where the message is, why it failed, and what it said."""
    return parsed.where(F.col("disposition") == DEAD).select(
        "topic",
        F.col("partition").cast("smallint").alias("partition_id"),
        F.col("offset").alias("kafka_offset"),
        "reason",
        raw_text(F.col("value")).alias("raw_value"),
    )


def ledger_id_expr(run: Column) -> Column:
    """One key per run, topic and partition, the same whenever that run is repeated."""
    return F.shiftrightunsigned(F.xxhash64(run, "topic", "partition"), 1)


def stamp(
    parsed: DataFrame, target: LoadTarget, ledger_id, loaded_date, ctx: Context, source_path: str
) -> DataFrame:
    """Parsed records as landing rows: load metadata on, and content only where it may be kept."""
    kept = F.col("disposition") == OK
    dead = F.col("disposition") == DEAD
    return parsed.select(
        loaded_date.alias("loaded_date"),
        "topic",
        F.col("partition").cast("smallint").alias("partition_id"),
        F.col("offset").alias("kafka_offset"),
        ledger_id.alias("ledger_id"),
        *[F.when(kept, F.col(c)).alias(c) for c in target.columns],
        F.col("timestamp").alias("kafka_ts"),
        at(ctx.now).alias("loaded_at"),
        F.lit(source_path).alias("source_path"),
        F.when(dead, F.col("reason")).alias("reason"),
        F.when(dead, raw_text(F.col("value"))).alias("raw_value"),
        "disposition",
    )


def ledger_entries(
    landed: DataFrame, ranges: DataFrame, target: LoadTarget, batch: str, ctx: Context
) -> DataFrame:
    """One entry per claimed range (with its ``run``) and its counts, ranges without rows included."""

    def tally(disposition: str, name: str):
        return F.count_if(F.col("disposition") == disposition).alias(name)

    counts = landed.groupBy("ledger_id").agg(
        tally(OK, "row_count"),
        tally(DEAD, "dlq_count"),
        tally(ERASED, "erased_count"),
        tally(SKIP, "skipped_count"),
    )
    names = ("row_count", "dlq_count", "erased_count", "skipped_count")
    claimed = ranges.withColumn("ledger_id", ledger_id_expr(F.col("run")))
    return claimed.join(counts, "ledger_id", "left").select(
        "ledger_id",
        F.col("run").alias("dag_run_id"),
        "topic",
        F.col("partition").cast("smallint").alias("partition_id"),
        "start_offset",
        "end_offset",
        "loaded_date",
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names],
        (F.col("attempt") + 1).alias("attempt"),
        at(ctx.now).alias("created_at"),
        at(ctx.now).alias("updated_at"),
        F.lit(target.name).alias("target"),
        F.lit(batch).alias("batch"),
    )


@dataclass(frozen=True)
class Warehouse:
    """Tables under one root folder that every executor can reach."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("load_ledger", LEDGER_SCHEMA)

    def landing(self, target: LoadTarget) -> DataFrame:
        return self._read(f"landing/{target.name}", target.landing_schema)

    def _visible(self, target: LoadTarget) -> DataFrame:
        current = latest_attempts(self.ledger()).select("batch", "ledger_id")
        return self.landing(target).join(current, ["batch", "ledger_id"], "left_semi")

    def raw(self, target: LoadTarget) -> DataFrame:
        """Committed rows of a stream."""
        return (
            self._visible(target).where(F.col("disposition") == OK).select(*target.raw_columns)
        )

    def dlq(self, target: LoadTarget) -> DataFrame:
        """Committed dead letters of a stream."""
        return (
            self._visible(target)
            .where(F.col("disposition") == DEAD)
            .select(
                "ledger_id",
                "topic",
                "partition_id",
                "kafka_offset",
                "reason",
                "raw_value",
                F.col("loaded_at").alias("created_at"),
            )
        )

    def land(self, rows: DataFrame, target: LoadTarget, batch: str) -> DataFrame:
        """Write one batch and return it as read back from its files.

        Folders are by load date alone, so that a year of small batches is a year of folders to
        list. A file belongs to one batch, and readers skip others by the files' own statistics.
        """
        batched = rows.withColumn("batch", F.lit(batch))
        with settings(self.spark, _UNSORTED):
            batched.write.mode("append").partitionBy("loaded_date").parquet(
                f"{self.root}/landing/{target.name}"
            )
        return self.landing(target).where(F.col("batch") == batch)

    def commit(self, entries: DataFrame) -> None:
        """Append ledger entries, one row per claimed range, as one file.

        Two runs that claimed the same records must not both count: entries that overlap those of
        another run are refused, and the rows landed for them stay invisible.
        """
        own = entries.select(*SLOT_IN_LEDGER, "dag_run_id", "start_offset", "end_offset")
        others = latest_attempts(self.ledger()).select(
            *SLOT_IN_LEDGER,
            F.col("dag_run_id").alias("_run"),
            F.col("start_offset").alias("_start"),
            F.col("end_offset").alias("_end"),
        )
        clash = (
            own.join(others, list(SLOT_IN_LEDGER))
            .where(F.col("dag_run_id") != F.col("_run"))
            .where((F.col("start_offset") < F.col("_end")) & (F.col("_start") < F.col("end_offset")))
            .take(1)
        )
        if clash:
            row = clash[0]
            raise ClaimConflict(
                f"{row['topic']}/{row['partition_id']}: {row['_run']} has committed offsets "
                f"{row['_start']} to {row['_end']} already"
            )
        self._claim(entries)
        self._append(entries)

    def _append(self, entries: DataFrame) -> None:
        entries.coalesce(1).write.mode("append").parquet(f"{self.root}/load_ledger")

    def _marker(self, slot: Row) -> str:
        place = f"{slot['topic']}/{slot['partition_id']}/{slot['start']:020d}"
        return f"{self.root}/claims/{place}"

    def _claim(self, entries: DataFrame) -> None:
        """Mark where each topic partition's new records begin; of several runs one can.

        Runs claim from where the ledger ends, so runs that race begin at the same record. A marker
        is made only where there is none, and names its run: the same run may come back to it, which
        is how a run that died before its entries were appended goes on. ``release`` takes back a
        marker whose run will not return.
        """
        firsts = (
            entries.groupBy(*SLOT_IN_LEDGER)
            .agg(
                F.min("start_offset").alias("start"),
                F.min_by("dag_run_id", "start_offset").alias("run"),
            )
            .collect()  # one per topic partition
        )
        made = []
        for slot in firsts:
            path = self._marker(slot)
            if create_once(self.spark, path, slot["run"]):
                made.append(path)
                continue
            holder = read_text(self.spark, path)
            if holder != slot["run"]:
                for mine in made:
                    delete(self.spark, mine)
                raise ClaimConflict(
                    f"{slot['topic']}/{slot['partition_id']}: {holder} is committing offsets from "
                    f"{slot['start']} on"
                )

    def release(self, topic: str, partition: int, start: int) -> None:
        """Take back the marker of a run that died before its commit and will not be repeated."""
        delete(self.spark, self._marker({"topic": topic, "partition_id": partition, "start": start}))

    # ------------------------------------------------------------ upkeep

    def _standing(self, target: LoadTarget) -> DataFrame:
        """Landed rows by batch and ledger entry, and whether readers see them."""
        current = latest_attempts(self.ledger()).select("batch", "ledger_id", F.lit(1).alias("_now"))
        landed = self.landing(target).groupBy("batch", "ledger_id").agg(F.count("*").alias("rows"))
        return landed.join(current, ["batch", "ledger_id"], "left").select(
            "batch", "ledger_id", "rows", F.col("_now").isNotNull().alias("seen")
        )

    def sweep(self, target: LoadTarget, before: datetime) -> Row:
        """Delete files of batches of which readers see nothing; returns batches, files and rows.

        Such a batch was replaced by a rerun, rewritten by ``compact``, or never committed. Files
        written since ``before`` are left: they may belong to a load that has yet to commit, or to a
        batch that a reader still at work has begun to read. A file holds one batch only.
        """
        batches = (
            self._standing(target)
            .groupBy("batch")
            .agg(F.sum("rows").alias("rows"), F.bool_or("seen").alias("seen"))
            .where(~F.col("seen"))
        )
        files = (
            self.landing(target)
            .select(
                "batch",
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("written"),
            )
            .join(batches.select("batch"), "batch", "left_semi")
            .groupBy("batch", "path")
            .agg(F.max("written").alias("written"), F.count("*").alias("rows"))
            .where(F.col("written") < at(before))
        )
        swept = kept(files)
        for file in swept.select("path").toLocalIterator():
            delete(self.spark, file["path"])
        return swept.agg(
            F.countDistinct("batch").alias("batches"),
            F.count("*").alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        ).first()

    def compact(self, target: LoadTarget, ctx: Context, small_rows: int = 1_000_000) -> int:
        """Rewrite batches that are partly replaced, and small ones, as one; returns the rows.

        What readers see of them is landed again as a new batch, and the same ledger entries are
        then appended with that batch as a further attempt, in one file: readers change over at
        once, and see the same rows. The old files are for a later ``sweep``.
        """
        standing = kept(self._standing(target))
        sizes = standing.groupBy("batch").agg(
            F.bool_and("seen").alias("whole"),
            F.coalesce(F.sum(F.when(F.col("seen"), F.col("rows"))), F.lit(0)).alias("rows"),
        )
        worn = kept(
            sizes.where((F.col("rows") > 0) & (~F.col("whole") | (F.col("rows") < small_rows)))
        )
        figures = worn.agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole")).first()
        if not figures["n"] or (figures["n"] == 1 and figures["whole"]):
            return 0
        batch = uuid.uuid4().hex
        entries = latest_attempts(self.ledger()).join(worn.select("batch"), "batch", "left_semi")
        entries = kept(entries)
        live = self.landing(target).join(
            entries.select("batch", "ledger_id"), ["batch", "ledger_id"], "left_semi"
        )
        order = ["loaded_date", "topic", "partition_id", "kafka_offset"]
        rows = live.drop("batch").repartitionByRange(*order).sortWithinPartitions(*order)
        landed = self.land(rows, target, batch).count()
        again = {
            "attempt": F.col("attempt") + 1,
            "updated_at": at(ctx.now),
            "batch": F.lit(batch),
        }
        self._append(entries.withColumns(again).select(*self.ledger().columns))
        return landed


def load_records(
    warehouse: Warehouse,
    records: DataFrame,
    ranges: DataFrame,
    target: LoadTarget,
    run_id: str,
    ctx: Context,
    source_path: str = "live",
    erasure: DataFrame | None = None,
) -> DataFrame:
    """Land and commit the records of one run's claimed ranges; returns its ledger entries."""
    named = ranges.withColumn("run", F.lit(run_id))
    dates = F.broadcast(
        named.select(*SLOT, F.col("loaded_date").alias("_date"), F.col("run").alias("_run"))
    )
    return land_and_commit(
        warehouse,
        records,
        lambda parsed: parsed.join(dates, SLOT),
        named,
        target,
        ctx,
        source_path,
        erasure,
    )


def land_and_commit(
    warehouse: Warehouse,
    records: DataFrame,
    placed: Callable[[DataFrame], DataFrame],
    ranges: DataFrame | Callable[[DataFrame], DataFrame | None],
    target: LoadTarget,
    ctx: Context,
    source_path: str = "live",
    erasure: DataFrame | None = None,
) -> DataFrame:
    """Land records under the date and run that ``placed`` gives them, and commit their ranges.

    ``ranges`` are known, or found from what has landed, which is every record that was read; where
    none are found nothing is committed.
    """
    batch = uuid.uuid4().hex
    parsed = target.parse(records)
    if erasure is not None:
        parsed = mark_erased(parsed, erasure)
    dated = placed(parsed)
    rows = stamp(dated, target, ledger_id_expr(F.col("_run")), F.col("_date"), ctx, source_path)
    if source_path == "backfill":
        # Replayed history lands under one load date; ordered files keep parquet's min/max useful.
        # Drawing the ranges reads the rows once more, so they are parsed into a table first.
        rows = kept(rows).repartitionByRange(target.sort_key, "kafka_offset").sortWithinPartitions(
            target.sort_key
        )
    landed = warehouse.land(rows, target, batch)
    claimed = ranges if isinstance(ranges, DataFrame) else ranges(landed)
    if claimed is not None:
        warehouse.commit(ledger_entries(landed, claimed, target, batch, ctx))
    return warehouse.ledger().where(F.col("batch") == batch)


def run_load(
    warehouse: Warehouse,
    log: Log,
    target: LoadTarget,
    topic: str,
    run_id: str,
    ctx: Context,
    max_records: int = LIVE_MAX_RECORDS,
    source_path: str = "live",
    erasure: DataFrame | None = None,
) -> DataFrame | None:
    """One run over all partitions of a topic. None when there is nothing new to read.

    The only rows brought to the driver are the claims: one per partition of the topic.
    """
    spark = warehouse.spark
    ledger = warehouse.ledger()
    # One row per partition of the topic, read once and reused by the checks below.
    bounds = spark.createDataFrame(bounds_of(log, topic).collect(), BOUNDS_SCHEMA)
    rows = run_ranges(bounds, ledger, run_id, max_records, ctx).collect()
    if not rows:
        return None
    ranges = spark.createDataFrame(rows, RANGE_SCHEMA)
    assert_contiguous(ranges.where(F.col("attempt") == 0), ledger)
    assert_retained(ranges, bounds)
    records = read_range(records_of(log, topic, rows), ranges)
    return load_records(
        warehouse,
        records,
        ranges,
        target,
        run_id,
        ctx,
        source_path,
        erasure,
    )


def batches_recorded(ledger: DataFrame, run_id: str) -> int:
    """How many batches of a backfill the ledger has."""
    prefix = f"{run_id}-batch"
    own = ledger.where(F.startswith("dag_run_id", F.lit(prefix)))
    number = F.substring("dag_run_id", len(prefix) + 1, 20).try_cast("bigint")
    last = own.agg(F.max(number)).first()[0]
    return 0 if last is None else last + 1


def backfill_ranges(
    bounds: DataFrame, ledger: DataFrame, run_id: str, first: int, max_records: int, ctx: Context
) -> DataFrame:
    """All that a log holds beyond the ledger, in ranges of ``max_records``, each with its run.

    The k-th range of every topic partition belongs to the run's k-th batch, counted from ``first``.
    """
    whole = claim_ranges(bounds, ledger, 1 << 62)
    step = F.lit(max_records).cast("bigint")
    starts = F.sequence("start_offset", F.col("end_offset") - 1, step)
    return (
        whole.select(*SLOT, "end_offset", F.posexplode(starts).alias("_k", "start_offset"))
        .select(
            *SLOT,
            "start_offset",
            F.least("end_offset", F.col("start_offset") + step).alias("end_offset"),
            F.lit(ctx.today).alias("loaded_date"),
            F.lit(0).alias("attempt"),
            F.concat(F.lit(f"{run_id}-batch"), (F.lit(first) + F.col("_k")).cast("string")).alias(
                "run"
            ),
        )
    )


def drain_backfill(
    warehouse: Warehouse,
    log: Log,
    target: LoadTarget,
    topic: str,
    run_id: str,
    ctx: Context,
    max_records: int = BACKFILL_MAX_RECORDS,
    erasure: DataFrame | None = None,
) -> int:
    """Read a topic to its end as bounded batches with a run id each; returns how many.

    All batches are claimed, landed and committed by one job over the log. A record's batch follows
    from its offset, so records do not meet the list of ranges, however long that is. A drain that
    dies has committed nothing and is repeated as a whole; one that finished finds what came since.
    """
    ledger = warehouse.ledger()
    bounds = warehouse.spark.createDataFrame(bounds_of(log, topic).collect(), BOUNDS_SCHEMA)
    first = batches_recorded(ledger, run_id)
    ranges = kept(backfill_ranges(bounds, ledger, run_id, first, max_records, ctx))
    slots = ranges.groupBy(*SLOT).agg(
        F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset")
    )
    rows = slots.collect()  # one per topic partition
    if not rows:
        return 0
    slots = warehouse.spark.createDataFrame(rows, slots.schema)
    assert_contiguous(slots, ledger)
    assert_retained(slots, bounds)
    batch = F.lit(first) + F.floor((F.col("offset") - F.col("_start")) / max_records)

    def placed(parsed: DataFrame) -> DataFrame:
        own = F.broadcast(slots.select(*SLOT, F.col("start_offset").alias("_start")))
        run = F.concat(F.lit(f"{run_id}-batch"), batch.cast("string"))
        return parsed.join(own, SLOT).withColumns({"_run": run, "_date": F.lit(ctx.today)})

    records = read_range(records_of(log, topic, rows), slots)
    land_and_commit(warehouse, records, placed, ranges, target, ctx, "backfill", erasure)
    return ranges.select("run").distinct().count()
