"""Event types to families to topics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The family each accepted event type belongs to.
EVENT_FAMILIES = {
    "session_start": "session",
    "session_end": "session",
    "page_view": "session",
    "feature_invoked": "feature_usage",
    "report_exported": "feature_usage",
    "api_called": "feature_usage",
    "signup": "lifecycle",
    "invite_sent": "lifecycle",
    "seat_added": "lifecycle",
    "seat_removed": "lifecycle",
    "plan_viewed": "billing_ui",
    "checkout_started": "billing_ui",
    "subscription_changed": "billing_ui",
}


def route_events(events: DataFrame, prefix: str = "product") -> DataFrame:
    """Each event with its topic, null for a type no family takes. A literal map, so no join."""
    families = F.create_map(*[F.lit(v) for v in chain.from_iterable(EVENT_FAMILIES.items())])
    family = F.try_element_at(families, F.col("event_type"))
    return events.withColumn(
        "topic", F.when(family.isNotNull(), F.concat(F.lit(f"{prefix}."), family))
    )


def rejected_events(events: DataFrame) -> DataFrame:
    """Events whose type belongs to no family."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_FAMILIES), F.lit(False))
    return events.where(~known)
