"""The whole build, as plain function calls from raw tables to marts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.context import Context
from tidemark.plans import core, marts, staging
from tidemark.sources.days import DayTable

@dataclass(frozen=True)
class Layer:
    """Where built tables are kept, on storage every executor reaches."""

    spark: SparkSession
    root: str

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def events(self) -> DayTable:
        """Staged events, by the day they happened on."""
        return DayTable(self.spark, f"{self.root}/stg_product_events", "event_time", ("event_id",))

    def activity(self) -> DayTable:
        """Daily activity, by its day."""
        keys = ("account_id", "activity_date")
        path = f"{self.root}/fct_account_activity_daily"
        return DayTable(self.spark, path, "activity_date", keys, "last_loaded_at")


def build(raw: dict[str, DataFrame], ctx: Context, layer: Layer) -> dict[str, DataFrame]:
    """All models. Without a full refresh the event models are built onto what the layer holds.

    They are kept by day, and a run rewrites the days it touches: those of rows loaded since the
    last build, looked back from, and those of rows that these replace. All other models are lazy
    or written whole.
    """
    cdc = raw["cdc_changes"]
    out: dict[str, DataFrame] = {}

    def merged(table: DayTable, make) -> DataFrame:
        if ctx.full_refresh or not table.built():
            return table.overwrite(make(None), ctx)
        return table.replace(make(table.newest()), ctx)

    out["stg_product_events"] = merged(
        layer.events(),
        lambda newest: staging.stg_product_events(
            raw["product_events"], cdc, ctx, newest=newest
        ),
    )
    out["fct_account_activity_daily"] = merged(
        layer.activity(),
        lambda newest: core.fct_account_activity_daily(
            out["stg_product_events"], ctx, newest=newest
        ),
    )
    staged = out["stg_product_events"]
    activity = out["fct_account_activity_daily"]
    out["stg_product_events_quarantined"] = staging.quarantined(
        raw["product_events"], staged, ctx
    )
    out["stg_product_events_unreconciled"] = staging.unreconciled(
        raw["product_events"], staged, cdc
    )
    for table, model in (
        ("subscription", staging.stg_subscription_changes),
        ("account", staging.stg_account_changes),
        ("user", staging.stg_user_changes),
        ("invoice", staging.stg_invoice_changes),
        ("support_ticket", staging.stg_support_ticket_changes),
    ):
        out[f"stg_{table}_changes"] = model(cdc)
    out["dim_subscription"] = layer.write(
        "dim_subscription", core.dim_subscription(out["stg_subscription_changes"])
    )
    out["dim_date"] = core.dim_date(layer.spark, ctx)
    out["dim_account"] = core.dim_account(out["stg_account_changes"])
    out["fct_subscription_daily"] = core.fct_subscription_daily(out["dim_subscription"], ctx)
    out["fct_invoices"] = core.fct_invoices(out["stg_invoice_changes"])
    out["mart_revenue_mrr"] = marts.revenue_from_versions(out["dim_subscription"], ctx)
    out["mart_activation_funnel"] = marts.mart_activation_funnel(
        out["dim_account"], activity, out["dim_subscription"]
    )
    out["mart_account_health"] = marts.mart_account_health(
        out["dim_account"],
        out["dim_subscription"],
        activity,
        out["fct_invoices"],
        out["stg_support_ticket_changes"],
        ctx,
    )
    if "billing_webhook_events" in raw:
        out["stg_billing_events"] = staging.stg_billing_events(
            raw["billing_webhook_events"], raw["billing_events_batch"]
        )
        out["stg_billing_reconciliation"] = staging.stg_billing_reconciliation(
            out["stg_billing_events"]
        )
    return out
