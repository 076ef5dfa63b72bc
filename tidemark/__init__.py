"""Product analytics on Spark: ingest semantics, models, checks and activation."""

from tidemark.context import Context, configure

__all__ = ["Context", "configure"]
