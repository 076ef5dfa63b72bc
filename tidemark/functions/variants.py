"""Typed questions about JSON values held as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six JSON type names.
NULL, BOOLEAN, NUMBER, STRING, ARRAY, OBJECT = (
    "null",
    "boolean",
    "number",
    "string",
    "array",
    "object",
)


def json_type(value: Column) -> Column:
    """The JSON type name of a variant; SQL null when there is no value at all."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.isNull(), F.lit(None).cast("string"))
        .when(schema == "VOID", NULL)
        .when(schema == "BOOLEAN", BOOLEAN)
        .when(schema == "STRING", STRING)
        .when(schema.startswith("ARRAY<"), ARRAY)
        .when(schema.startswith("OBJECT<"), OBJECT)
        .otherwise(NUMBER)
    )
