"""What a query's plan and tasks must not do as tables grow."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.test_load import TOPIC, messages
from tests.test_models import CDC, account
from tidemark.catalog import live, logs
from tidemark.plans import staging
from tidemark.sources import load
from tidemark.sources.envelopes import parse_product_events
from tidemark.sources.load import PRODUCT_EVENTS, Warehouse, run_load
from tidemark.sources.log import read_range

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize(
    "stage", ["stg_invoice_changes", "stg_subscription_changes", "stg_account_changes"]
)
def test_images_are_parsed_before_rows_are_sorted(spark, folder, stage):
    rows = [account(1, "2026-03-05T00:00:00Z"), account(1, "2026-03-05T00:00:00Z", offset=1)]
    spark.createDataFrame(rows, CDC).write.parquet(folder)
    plan = plan_of(getattr(staging, stage)(spark.read.parquet(folder)))
    assert "from_json" in plan
    assert "from_json" not in plan[: plan.rindex("WindowGroupLimit")]


@pytest.mark.parametrize("name", ["merged_sync_state", "sync_outcomes", "sync_candidates"])
def test_accounts_are_scored_once(spark, name):
    found = __spark_entry__.queries()[name](spark, FOLDER)
    assert not [f for f in found.inputFiles() if "lineitem" in f or "orders" in f]


def test_messages_are_not_shuffled_by_their_partitions(spark, folder):
    messages(spark, 0, 50).write.parquet(folder)
    ranges = spark.createDataFrame(
        [(TOPIC, 0, 5, 20)], "topic STRING, partition INT, start_offset BIGINT, end_offset BIGINT"
    )
    read = read_range(spark.read.parquet(folder), ranges)
    assert read.count() == 15
    assert "SortMergeJoin" not in plan_of(read)


def test_erasure_meets_messages_where_they_are(spark, folder):
    messages(spark, 0, 50).write.parquet(folder)
    gone = spark.createDataFrame([(1,), (1,)], "account_id BIGINT")
    marked = load.mark_erased(parse_product_events(spark.read.parquet(folder)), gone)
    assert marked.where("disposition = 'erased'").count() == 50
    assert "SortMergeJoin" not in plan_of(marked)


def test_a_batch_lands_unsorted(spark, folder, ctx, monkeypatch):
    seen = []
    enter = load.settings
    monkeypatch.setattr(load, "settings", lambda s, values: seen.append(values) or enter(s, values))
    warehouse = Warehouse(spark, folder)
    run_load(warehouse, messages(spark, 0, 9), PRODUCT_EVENTS, TOPIC, "r1", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 18
    name = "spark.sql.maxConcurrentOutputFileWriters"
    assert [int(v[name]) > 0 for v in seen] == [True]


def test_the_three_views_come_from_one_parse(spark, folder):
    messages(spark, 0, 6, bad=(2,)).write.parquet(folder)
    counts = load.split_counts(parse_product_events(spark.read.parquet(folder)), "partition")
    assert {tuple(r) for r in counts.collect()} == {(0, 5, 1, 0), (1, 5, 1, 0)}
    split = __spark_entry__.queries()["three_way_split"](spark, FOLDER)
    assert plan_of(split).count("FileScan") == 1


def test_stretches_of_a_log_are_written_by_its_tasks(spark):
    log = logs.event_log(spark, FOLDER).repartition(3)
    parts = live._parts(log)
    assert sum(p.count() for p in parts) == log.count()
    assert all(p.rdd.getNumPartitions() == 3 for p in parts)


def test_a_start_is_shown_once_per_version(spark):
    plan = plan_of(__spark_entry__.queries()["fct_subscription_daily"](spark, FOLDER))
    assert "explode" in plan and "version_started_at" in plan
    per_day = plan.split("Generate explode")[0]
    assert "cast(version_started_at" not in per_day and "cast(valid_from" not in per_day


def test_a_day_is_shown_once_per_day_of_the_spine(spark):
    daily = __spark_entry__.queries()["fct_subscription_daily"](spark, FOLDER)
    assert dict(daily.dtypes)["date_day"] == "string"
    assert "cast(date_day" not in plan_of(daily).split("Generate explode")[0]


def test_days_are_laid_out_by_several_tasks_a_core(spark):
    plan = plan_of(__spark_entry__.queries()["fct_subscription_daily"](spark, FOLDER))
    dealt = plan.split("Generate explode", 1)[1].splitlines()[1]
    assert "REPARTITION_BY_NUM" in dealt and f", {8 * spark.sparkContext.defaultParallelism})" in dealt


def test_versions_of_small_keys_take_one_pass(spark):
    """Positions are sparse here, so slices by position would have a row each."""
    plan = plan_of(__spark_entry__.queries()["dim_subscription"](spark, FOLDER))
    assert "Join" not in plan and "parquet" in plan


def test_events_are_staged_once_for_health(spark):
    plan = plan_of(__spark_entry__.queries()["mart_account_health"](spark, FOLDER))
    assert plan.count("events.parquet") == 1  # tickets; the daily fact has been written


def test_a_check_run_scores_accounts_once(spark):
    assert "l_discount" not in plan_of(__spark_entry__.queries()["check_run"](spark, FOLDER))


def test_versions_alike_are_summed_before_they_are_laid_on_days(spark):
    plan = plan_of(__spark_entry__.queries()["revenue_from_daily_fact"](spark, FOLDER))
    days = plan.index("Generate explode")
    assert "Aggregate(keys=[plan_code" in plan[days:]
