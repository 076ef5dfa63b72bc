"""Column expressions shared by the models. All of them stay inside the JVM."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def at(instant: datetime) -> Column:
    """A timestamp literal, independent of the Python process's own zone."""
    moment = instant if instant.tzinfo else instant.replace(tzinfo=UTC)
    micros = (moment - datetime(1970, 1, 1, tzinfo=UTC)) // (datetime.resolution)
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def END_OF_TIME() -> Column:  # noqa: N802 - reads as the constant it is
    """End of an open interval. Finite, so every client can read it; midnight, so no zone offset
    pushes it into year 10000."""
    return F.lit("9999-12-31 00:00:00+00:00").cast("timestamp")


def json_record(column: Column | str, *keys: str) -> Column:
    """Several keys of a JSON object as a struct of strings, parsing the text once.

    Every field is text, so one odd value cannot null its neighbours; callers cast, and under ANSI
    a cast that cannot succeed raises instead of quietly making nulls.
    """
    return F.from_json(_col(column), ", ".join(f"`{k}` STRING" for k in keys))


def changed(left: Column | str, right: Column | str) -> Column:
    """Null-safe inequality."""
    return ~_col(left).eqNullSafe(_col(right))


def surrogate_key(*columns: Column | str) -> Column:
    """Deterministic key: md5 over the values as text, joined by a bar, null as a marker."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("<null>")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def safe_rate(numerator: Column | str, denominator: Column | str, scale: int = 4) -> Column:
    """A ratio rounded half up, null where the denominator is zero."""
    ratio = _col(numerator).cast("decimal(20,0)") / F.nullif(
        _col(denominator).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
    )
    return F.round(ratio, scale)


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Elapsed seconds with microsecond fractions."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(1e6)


def day_start(column: Column | str) -> Column:
    """A date as the instant its day begins."""
    return _col(column).cast("timestamp")


# Fixed format: calendar date, optional time of day, optional fraction, optional offset.
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:\d{2})?)?)?)?$"
)


def parse_iso(text: Column) -> Column:
    """ISO text to a timestamp, null when it is not one.

    The pattern is checked before casting because Spark's cast also takes words such as
    ``yesterday`` and ``now``.
    """
    return F.when(
        text.rlike(ISO_PATTERN), F.regexp_replace(text, ",", ".").try_cast("timestamp")
    )
