"""The whole build, in full and then incrementally, judged by the models' own declared tests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tests.conftest import utc
from tidemark.catalog import inputs
from tidemark.context import shared_folder
from tidemark.plans.build import Layer, build
from tidemark.plans.checks import MODEL_TESTS, model_test_failures
from tidemark.sources.days import DayTable, _on_days

FOLDER = "/root/testdata/sf0.001"


def test_full_and_incremental_build(spark, folder):
    events = inputs.product_events(spark, FOLDER)
    raw = {
        "product_events": events.where(F.col("loaded_at") < F.lit("2024-01-20").cast("timestamp")),
        "cdc_changes": inputs.cdc_changes(spark, FOLDER),
        "billing_webhook_events": inputs.billing_webhooks(spark, FOLDER),
        "billing_events_batch": inputs.billing_batch(spark, FOLDER),
    }
    layer = Layer(spark, folder)
    before = build(raw, inputs.CTX, layer)
    events_before = before["stg_product_events"].count()
    assert before["stg_product_events_quarantined"].count() == 0
    after = build({**raw, "product_events": events}, inputs.CTX, layer)
    assert after["stg_product_events"].count() > events_before
    assert after["stg_product_events_quarantined"].count() > 0
    small = set(MODEL_TESTS) - {"fct_subscription_daily"}
    failing = {
        (row["model"], row["test"])
        for model in sorted(small & set(after))
        for row in model_test_failures(model, after[model]).collect()
        if row["failures"]
    }
    # Some of these events name no account, which the model's own test is there to say.
    assert failing == {("stg_product_events", "not_null:account_id")}


ROWS = "id BIGINT, at TIMESTAMP, loaded_at TIMESTAMP, v STRING"


def day_files(table):
    """Folder and file of every row's file, by the day of the folder."""
    rows = table._days().select("_day", F.col("_metadata.file_path").alias("f")).distinct()
    found = {}
    for r in rows.collect():
        found.setdefault(r["_day"], set()).add(r["f"])
    return found


def rows_of(*rows):
    return [(k, day and utc(2026, 1, day, 8), utc(2026, 2, loaded), v) for k, day, loaded, v in rows]


def test_files_of_untouched_days_stay(spark, ctx, folder):
    table = DayTable(spark, folder, "at", ("id",))
    assert not table.built() and table.newest() is None
    first = rows_of((1, 1, 1, "a"), (2, 1, 2, "b"), (3, 2, 2, "c"), (4, 3, 1, "d"), (5, 4, 1, "e"))
    table.overwrite(spark.createDataFrame([*first, *rows_of((6, None, 1, "f"))], ROWS), ctx)
    before = day_files(table)
    assert table.newest() == int(utc(2026, 2, 2).timestamp() * 1e6)
    # One row is replaced on its day, one moves from a day of its own, one is new; the first of
    # January and the null day are left alone.
    fresh = rows_of((3, 2, 3, "C"), (5, 3, 3, "E"), (7, 9, 4, "g"))
    after = table.replace(spark.createDataFrame(fresh, ROWS), ctx)
    assert {r["id"]: r["v"] for r in after.collect()} == {
        1: "a", 2: "b", 3: "C", 4: "d", 5: "E", 6: "f", 7: "g",
    }
    files = day_files(table)
    untouched = (date(2026, 1, 1), None)
    assert {d: files[d] for d in untouched} == {d: before[d] for d in untouched}
    assert not files[date(2026, 1, 2)] & before[date(2026, 1, 2)]
    assert date(2026, 1, 4) not in files and date(2026, 1, 9) in files
    assert table.newest() == int(utc(2026, 2, 4).timestamp() * 1e6)
    # The same rows again change nothing.
    again = table.replace(spark.createDataFrame(fresh, ROWS), ctx)
    assert again.count() == 7 and table.replace(spark.createDataFrame([], ROWS), ctx).count() == 7


def test_days_are_pruned_by_folder(spark, ctx, folder):
    table = DayTable(spark, folder, "at", ("id",))
    table.overwrite(spark.createDataFrame(rows_of(*[(k, 1 + k, 1, "x") for k in range(9)]), ROWS), ctx)
    near = table._days().where(_on_days([date(2026, 1, 2), None]))
    assert "PartitionFilters: [(" in near._jdf.queryExecution().simpleString()
    assert near.count() == 1


def test_an_empty_table_can_be_built_onto(spark, ctx, folder):
    table = DayTable(spark, folder, "at", ("id",))
    table.overwrite(spark.createDataFrame([], ROWS), ctx)
    assert table.built() and table.newest() is None
    fresh = spark.createDataFrame(rows_of((1, 1, 1, "a")), ROWS)
    assert table.replace(fresh, ctx).count() == 1


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
