from tidemark.functions.columns import (
    END_OF_TIME,
    at,
    changed,
    day_start,
    json_record,
    parse_iso,
    safe_rate,
    seconds_between,
    surrogate_key,
)

__all__ = [
    "END_OF_TIME",
    "at",
    "changed",
    "day_start",
    "json_record",
    "parse_iso",
    "safe_rate",
    "seconds_between",
    "surrogate_key",
]
