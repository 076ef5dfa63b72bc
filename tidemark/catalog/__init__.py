"""Every operator as a named query over the given tables, with equivalent SQL beside it."""

from tidemark.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
