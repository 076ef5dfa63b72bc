"""The load as a stream: everything once, also when a micro-batch is repeated."""

from __future__ import annotations

from tests.test_load import messages
from tidemark.sources.load import PRODUCT_EVENTS, Warehouse
from tidemark.streaming.ingest import load_micro_batch, stream_load


def test_stream_loads_what_arrives_since(spark, folder, ctx):
    warehouse = Warehouse(spark, f"{folder}/warehouse")

    def run():
        log = spark.readStream.schema(messages(spark, 0, 1).schema).parquet(f"{folder}/log")
        stream_load(
            warehouse, log, PRODUCT_EVENTS, "events", f"{folder}/checkpoint", ctx
        ).awaitTermination()
        return warehouse.raw(PRODUCT_EVENTS).count()

    messages(spark, 0, 5, bad=(1,)).write.parquet(f"{folder}/log")
    assert run() == 8
    assert run() == 8
    messages(spark, 5, 8).write.mode("append").parquet(f"{folder}/log")
    assert run() == 14
    assert warehouse.dlq(PRODUCT_EVENTS).count() == 2


def test_repeated_micro_batch_replaces_itself(spark, folder, ctx):
    warehouse, batch = Warehouse(spark, folder), messages(spark, 0, 5)
    for _ in range(2):
        load_micro_batch(warehouse, batch, 7, PRODUCT_EVENTS, "events", ctx)
    assert warehouse.raw(PRODUCT_EVENTS).count() == 10
    assert {r["attempt"] for r in warehouse.ledger().collect()} == {1, 2}
