"""Parsing message values, whole logs at a time.

Each parser adds a ``disposition`` to every record: ``ok`` with typed columns, ``dead`` with a
reason, or ``skip`` for records that are neither data nor errors. Reasons are checked in a fixed
order, so a record has exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parse_iso

OK, DEAD, SKIP, ERASED = "ok", "dead", "skip", "erased"

# Required members of an event envelope, in the order a reason names them.
ENVELOPE_FIELDS = ("event_id", "event_type", "event_time", "received_at")
# Change kinds (create, update, delete, snapshot read).
CHANGE_OPS = ("c", "u", "d", "r")
# Fixed value: characters of raw text kept with a dead letter.
RAW_TEXT_LIMIT = 8192


def _reason(*cases: tuple[Column, Column | str]) -> Column:
    """The first case that holds, null when none does."""
    chosen = F.lit(None).cast("string")
    for condition, text in reversed(cases):
        chosen = F.when(condition, F.lit(text) if isinstance(text, str) else text).otherwise(
            chosen
        )
    return chosen


def _opened(log: DataFrame) -> DataFrame:
    return log.withColumn("_body", F.try_parse_json(F.col("value").cast("string")))


def _unpack(df: DataFrame, parent: str, into: str, *names: str) -> DataFrame:
    """Take members out of an object in one pass, as a struct of variants.

    The struct is null when the parent is no object. It is a column of its own, as everything
    costly here is, so that what refers to it often does not evaluate it often.
    """
    wanted = ", ".join(f"{n}: variant" for n in names)
    return df.withColumn(into, F.try_variant_get(F.col(parent), "$", f"struct<{wanted}>"))


def _describe(df: DataFrame, parent: str, *names: str) -> DataFrame:
    """Add each scalar member's type as ``_<member>_type``; absent and JSON null are both VOID."""
    types = {
        f"_{n}_type": F.coalesce(F.schema_of_variant(F.col(f"{parent}.{n}")), F.lit("VOID"))
        for n in names
    }
    return df.withColumns(types)


def _is(name: str, kind: str) -> Column:
    return F.col(f"_{name}_type") == kind


def _absent(name: str) -> Column:
    return _is(name, "VOID")


def _text(parent: str, name: str) -> Column:
    return F.when(_is(name, "STRING"), F.try_variant_get(F.col(f"{parent}.{name}"), "$", "string"))


def _integer(parent: str, name: str) -> Column:
    return F.when(_is(name, "BIGINT"), F.try_variant_get(F.col(f"{parent}.{name}"), "$", "bigint"))


def _json(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def uuid_text(text: Column) -> Column:
    """A UUID in its usual dashed form, from any of the spellings accepted for one."""
    bare = F.regexp_replace(F.lower(text), r"urn:|uuid:|^[{]+|[}]+$|-", "")
    digits = F.regexp_replace(bare, r"^[{]+", "")
    dashed = F.regexp_replace(
        digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    usual = text.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.when(usual, F.lower(text)).when(digits.rlike(r"^[0-9a-f]{32}$"), dashed)


def parse_product_events(log: DataFrame) -> DataFrame:
    """Product events: the envelope is checked, the payload is only required to be an object."""
    scalars = (*ENVELOPE_FIELDS, "account_id", "user_id")
    opened = _unpack(_opened(log), "_body", "_event", *scalars, "payload")
    opened = _unpack(opened, "_event.payload", "_inner", "feature")
    typed = _describe(opened, "_event", *scalars).withColumns(
        {
            "_missing": F.concat_ws(
                ",", *[F.when(_absent(f), F.lit(f)) for f in ENVELOPE_FIELDS]
            ),
            "event_id": uuid_text(_json(F.col("_event.event_id"))),
            "event_type": _text("_event", "event_type"),
            "event_time": parse_iso(_text("_event", "event_time")),
            "received_at": parse_iso(_text("_event", "received_at")),
            "account_id": _integer("_event", "account_id"),
            "user_id": _integer("_event", "user_id"),
            "payload": F.coalesce(_json(F.col("_event.payload")), F.lit("{}")),
        }
    )

    def not_integer(name: str) -> Column:
        return ~_absent(name) & ~_is(name, "BIGINT")

    reason = _reason(
        (F.col("value").isNull(), "tombstone_on_event_topic"),
        (F.col("_body").isNull(), "invalid_json: not parseable"),
        (F.col("_event").isNull(), "envelope_not_object"),
        (F.col("_missing") != "", F.concat(F.lit("missing_envelope_fields: "), "_missing")),
        (F.col("event_id").isNull(), "invalid_envelope: event_id must be a uuid"),
        (F.col("event_time").isNull(), "invalid_envelope: event_time must be an ISO timestamp"),
        (F.col("received_at").isNull(), "invalid_envelope: received_at must be an ISO timestamp"),
        (not_integer("account_id"), "invalid_envelope: account_id must be an integer"),
        (not_integer("user_id"), "invalid_envelope: user_id must be an integer"),
        (
            F.coalesce(F.col("event_type"), F.lit("")) == "",
            "invalid_envelope: event_type must be a non-empty string",
        ),
        (
            F.col("_event.payload").isNotNull() & F.col("_inner").isNull(),
            "invalid_envelope: payload must be an object",
        ),
    )
    return _settle(typed.withColumn("reason", reason), F.lit(False))


def _given(parent: str, name: str) -> Column:
    """Whether a member counts as given: not absent, and neither empty, zero nor false."""
    shown = F.col(f"_{name}_shown")
    empty = F.when(_is(name, "STRING"), shown == "").otherwise(
        shown.isin("0", "false", "{}", "[]")
    )
    return ~_absent(name) & ~F.coalesce(empty, F.lit(False))


def _show(df: DataFrame, parent: str, *names: str) -> DataFrame:
    """Add each member's text as ``_<member>_shown``."""
    return df.withColumns({f"_{n}_shown": _json(F.col(f"{parent}.{n}")) for n in names})


def business_time(parent: str, names: tuple[str, ...], commit_time: Column) -> Column:
    """Business time carried in a row image, else commit time.

    The first member given decides. Text is read as ISO and a whole number as microseconds; text
    that is no timestamp falls back to commit time, not to the next member.
    """
    chosen = F.lit(None).cast("timestamp")
    for name in reversed(names):
        shown = F.col(f"_{name}_shown")
        value = F.when(_is(name, "STRING"), parse_iso(shown)).when(
            _is(name, "BIGINT"), F.timestamp_micros(shown.cast("bigint"))
        )
        chosen = F.when(_given(parent, name), value).otherwise(chosen)
    return F.coalesce(chosen, commit_time)


def _key_text(key: Column) -> Column:
    """A message key as text: its members joined in name order, or the key itself if no object."""
    parsed = F.try_parse_json(key.cast("string"))
    members = F.try_variant_get(parsed, "$", "map<string,string>")
    joined = F.array_join(
        F.transform(
            F.array_sort(F.map_keys(members)),
            lambda name: F.coalesce(F.element_at(members, name), F.lit("None")),
        ),
        "|",
    )
    return F.when(F.size(members) > 0, joined).otherwise(_json(parsed))


def parse_cdc_changes(log: DataFrame) -> DataFrame:
    """Row changes with before and after images, bare or wrapped in a payload."""
    times = ("effective_at", "updated_at", "created_at")
    has_key = F.coalesce(F.length("key") > 0, F.lit(False))
    opened = _unpack(_opened(log), "_body", "_outer", "payload")
    # A wrapped change is taken out of its wrapping whatever it is, JSON null included.
    opened = opened.withColumn("_inside", F.coalesce("_outer.payload", "_body"))
    opened = _unpack(opened, "_inside", "_change", "op", "source", "before", "after", "ts_ms")
    opened = _unpack(opened, "_change.source", "_source", "table", "lsn", "snapshot", "ts_ms")
    opened = _unpack(opened, "_change.after", "_new", "id", "account_id", *times)
    opened = _unpack(opened, "_change.before", "_old", "id", "account_id")
    opened = opened.withColumns(
        {
            "before": _json(F.col("_change.before")),
            "after": _json(F.col("_change.after")),
            "_key": F.when(has_key, _key_text(F.col("key"))),
            "_millis": F.coalesce(
                F.nullif(F.try_variant_get("_source.ts_ms", "$", "bigint"), F.lit(0)),
                F.nullif(F.try_variant_get("_change.ts_ms", "$", "bigint"), F.lit(0)),
                F.lit(0).cast("bigint"),
            ),
            "_new_account": F.when(
                F.schema_of_variant("_new.account_id") == "BIGINT",
                F.try_variant_get("_new.account_id", "$", "bigint"),
            ),
            "_old_account": F.when(
                F.schema_of_variant("_old.account_id") == "BIGINT",
                F.try_variant_get("_old.account_id", "$", "bigint"),
            ),
        }
    )
    opened = _describe(opened, "_source", "table", "lsn")
    opened = _show(_describe(opened, "_new", *times), "_new", *times)
    opened = _describe(opened, "_change", "op")

    def image_id(image: str) -> Column:
        found = F.col(f"{image}.id")
        return F.when(found.isNotNull(), F.coalesce(_json(found), F.lit("None")))

    typed = opened.withColumns(
        {
            "op": _text("_change", "op"),
            "source_table": _text("_source", "table"),
            "source_lsn": _integer("_source", "lsn"),
            "source_ts": F.timestamp_millis("_millis"),
            "pk": F.when(has_key, F.col("_key")).otherwise(
                F.coalesce(image_id("_new"), image_id("_old"))
            ),
            "is_snapshot": F.coalesce(
                F.lower(_json(F.col("_source.snapshot"))).isin("true", "first", "last"),
                F.lit(False),
            ),
        }
    )
    typed = typed.withColumns(
        {
            "effective_at": F.when(F.col("op") == "d", F.col("source_ts")).otherwise(
                business_time("_new", times, F.col("source_ts"))
            ),
            "account_id": F.coalesce(
                "_new_account",
                "_old_account",
                F.when(F.col("source_table") == "accounts", F.col("pk").try_cast("bigint")),
            ),
        }
    )
    op = F.col("op")
    # Text is shown in quotes, nothing as None, anything else as written.
    op_shown = (
        F.when(op.isNotNull(), F.concat(F.lit("'"), op, F.lit("'")))
        .when(_absent("op"), F.lit("None"))
        .otherwise(_json(F.col("_change.op")))
    )
    reason = _reason(
        (F.col("_body").isNull(), "invalid_json: not parseable"),
        (F.col("_outer").isNull(), "envelope_not_object"),
        (F.col("_change").isNull(), "payload_not_object"),
        (
            ~F.coalesce(op.isin(*CHANGE_OPS), F.lit(False)),
            F.concat(F.lit("invalid_op: "), op_shown),
        ),
        (F.col("_source").isNull(), "missing_source_block"),
        (F.coalesce(F.col("source_table"), F.lit("")) == "", "missing_source_table"),
        (F.col("source_lsn").isNull(), "missing_source_lsn"),
        (F.col("before").isNotNull() & F.col("_old").isNull(), "before_not_object"),
        (F.col("after").isNotNull() & F.col("_new").isNull(), "after_not_object"),
        ((op == "d") & F.col("before").isNull(), "delete_without_before_image"),
        ((op != "d") & F.col("after").isNull(), F.concat(op, F.lit("_without_after_image"))),
        (F.col("pk").isNull(), "missing_primary_key"),
    )
    # A delete is followed by a message with its key and no value; it carries nothing.
    return _settle(
        typed.withColumn("reason", F.when(F.col("value").isNotNull(), reason)),
        F.col("value").isNull(),
    )


def parse_billing_webhooks(log: DataFrame) -> DataFrame:
    """Billing notifications. Without the provider's own id there is nothing to reconcile by."""
    names = ("id", "type", "created_at", "received_at", "account_id")
    opened = _unpack(_opened(log), "_body", "_hook", *names)
    opened = _show(_describe(opened, "_hook", *names), "_hook", "received_at")
    created = parse_iso(_text("_hook", "created_at"))
    # Unlike an event's ids, true and false pass as 1 and 0 here.
    flag = F.when(
        _is("account_id", "BOOLEAN"), F.try_variant_get("_hook.account_id", "$", "bigint")
    )
    typed = opened.withColumns(
        {
            "provider_event_id": _text("_hook", "id"),
            "event_type": _text("_hook", "type"),
            "provider_created_at": created,
            "received_at": F.when(
                _given("_hook", "received_at"), parse_iso(_text("_hook", "received_at"))
            ).otherwise(created),
            "account_id": F.coalesce(_integer("_hook", "account_id"), flag),
            "payload": _json(F.col("_body")),
        }
    )
    reason = _reason(
        (F.col("value").isNull(), "tombstone_on_billing_topic"),
        (F.col("_body").isNull(), "invalid_json: not parseable"),
        (F.col("_hook").isNull(), "envelope_not_object"),
        (F.coalesce(F.col("provider_event_id"), F.lit("")) == "", "missing_provider_event_id"),
        (F.coalesce(F.col("event_type"), F.lit("")) == "", "missing_event_type"),
        (
            F.col("provider_created_at").isNull() | F.col("received_at").isNull(),
            "invalid_timestamps: created_at and received_at must be ISO timestamps",
        ),
        (~_absent("account_id") & F.col("account_id").isNull(), "invalid_account_id"),
    )
    return _settle(typed.withColumn("reason", reason), F.lit(False))


def _settle(df: DataFrame, skipped: Column) -> DataFrame:
    """Give each record its disposition and fix the parsed columns in place.

    The one-element array is a fence. Without it the optimizer substitutes every parsing expression
    into each later filter on these columns, and a filter on the disposition would hold the whole
    parser several hundred times over.
    """
    disposition = F.when(skipped, SKIP).when(F.col("reason").isNotNull(), DEAD).otherwise(OK)
    kept = [c for c in df.columns if not c.startswith("_")]
    return df.select(F.inline(F.array(F.struct(*kept, disposition.alias("disposition")))))


def raw_text(value: Column) -> Column:
    """A message as text for its dead letter: bad bytes replaced, length limited."""
    return F.substring(F.make_valid_utf8(value.cast("string")), 1, RAW_TEXT_LIMIT)
