"""Parsing: each kind of bad message gets its reason, good ones their types."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources.envelopes import (
    parse_billing_webhooks,
    parse_cdc_changes,
    parse_product_events,
    raw_text,
)

LOG = "topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, key BINARY, value BINARY"
GOOD_ID = "6f1c2f0e-8a4b-4d7e-9c55-0123456789ab"


def log_of(spark, *messages, keys=None):
    from tests.conftest import utc

    rows = []
    for i, message in enumerate(messages):
        text = json.dumps(message) if isinstance(message, dict) else message
        value = text.encode() if isinstance(text, str) else text
        key = None if keys is None else keys[i]
        rows.append(("t", 0, i, utc(2026, 3, 1), key, value))
    return spark.createDataFrame(rows, LOG)


def event(**changes):
    body = {
        "event_id": GOOD_ID,
        "account_id": 1,
        "user_id": 10,
        "event_type": "feature_invoked",
        "event_time": "2026-03-01T10:00:00+00:00",
        "received_at": "2026-03-01T10:00:00.040000Z",
        "payload": {"feature": "export"},
    }
    body.update(changes)
    return {k: v for k, v in body.items() if v != "DROP"}


EVENT_CASES = [
    (event(), "ok", None),
    (None, "dead", "tombstone_on_event_topic"),
    ("{not json at all", "dead", "invalid_json"),
    ("[1]", "dead", "envelope_not_object"),
    ("null", "dead", "envelope_not_object"),
    (event(event_type="DROP", received_at=None), "dead",
     "missing_envelope_fields: event_type,received_at"),
    (event(event_id="not-a-uuid"), "dead", "invalid_envelope: event_id"),
    (event(event_time="yesterday"), "dead", "invalid_envelope: event_time"),
    (event(event_time="now"), "dead", "invalid_envelope: event_time"),
    (event(received_at=5), "dead", "invalid_envelope: received_at"),
    (event(account_id=True), "dead", "invalid_envelope: account_id"),
    (event(user_id=1.5), "dead", "invalid_envelope: user_id"),
    (event(user_id="7"), "dead", "invalid_envelope: user_id"),
    (event(event_type=""), "dead", "invalid_envelope: event_type"),
    (event(payload=[]), "dead", "invalid_envelope: payload"),
    (event(payload="{}"), "dead", "invalid_envelope: payload"),
    (event(payload=None), "dead", "invalid_envelope: payload"),
    (event(payload="DROP"), "ok", None),
    (event(payload={}), "ok", None),
    (event(account_id=None, user_id=None), "ok", None),
    (event(event_id="{6F1C2F0E8A4B4D7E9C550123456789AB}"), "ok", None),
    (event(event_id="urn:uuid:" + GOOD_ID), "ok", None),
    (event(event_time="2026-03-01 10:00:00"), "ok", None),
]


def test_event_reasons(spark):
    rows = (
        parse_product_events(log_of(spark, *[c[0] for c in EVENT_CASES]))
        .orderBy("offset")
        .collect()
    )
    for row, (message, disposition, reason) in zip(rows, EVENT_CASES, strict=True):
        assert row["disposition"] == disposition, message
        if reason is None:
            assert row["reason"] is None
            assert row["event_id"] == GOOD_ID
        else:
            assert row["reason"].startswith(reason), (message, row["reason"])
    assert rows[17]["payload"] == "{}"
    assert json.loads(rows[0]["payload"]) == {"feature": "export"}


def test_naive_times_are_utc_and_offsets_are_applied(spark):
    parsed = parse_product_events(
        log_of(
            spark,
            event(event_time="2026-03-01T10:00:00"),
            event(event_time="2026-03-01T15:30:00+05:30"),
        )
    )
    shown = parsed.select(F.col("event_time").cast("string")).collect()
    assert [r[0] for r in shown] == ["2026-03-01 10:00:00", "2026-03-01 10:00:00"]


def change(op="u", after=None, before=None, **source):
    row = {"id": 7, "account_id": 3, "status": "active", "effective_at": "2026-02-01T00:00:00Z"}
    block = {"table": "subscriptions", "lsn": 100, "ts_ms": 1772000000000, "snapshot": "false"}
    block.update(source)
    return {
        "op": op,
        "after": row if after is None else after,
        "before": before,
        "source": {k: v for k, v in block.items() if v != "DROP"},
    }


def one(spark, message, key=None):
    return parse_cdc_changes(log_of(spark, message, keys=[key])).first()


@pytest.mark.parametrize(
    ("message", "reason"),
    [
        ("{", "invalid_json"),
        ("[]", "envelope_not_object"),
        ({"payload": None}, "payload_not_object"),
        ({**change(), "op": "x"}, "invalid_op: 'x'"),
        ({**change(), "op": None}, "invalid_op: None"),
        ({**change(), "source": 5}, "missing_source_block"),
        (change(table=""), "missing_source_table"),
        (change(lsn="DROP"), "missing_source_lsn"),
        ({**change(), "before": [1]}, "before_not_object"),
        ({**change(), "after": "x"}, "after_not_object"),
        ({**change("d"), "after": None}, "delete_without_before_image"),
        ({**change("c"), "after": None}, "c_without_after_image"),
        (change(after={"status": "active"}), "missing_primary_key"),
    ],
)
def test_change_reasons(spark, message, reason):
    row = one(spark, message)
    assert row["disposition"] == "dead"
    assert row["reason"].startswith(reason)


def test_changes_bare_wrapped_and_tombstone(spark):
    bare, wrapped = one(spark, change()), one(spark, {"schema": {}, "payload": change()})
    for row in (bare, wrapped):
        assert (row["disposition"], row["op"], row["pk"], row["account_id"]) == ("ok", "u", "7", 3)
        assert row["source_lsn"] == 100
        assert json.loads(row["after"])["status"] == "active"
    assert one(spark, None, b'{"id": 7}')["disposition"] == "skip"


def test_business_time(spark):
    def at(after, op="u", before=None):
        row = parse_cdc_changes(log_of(spark, change(op, after=after, before=before))).select(
            F.col("effective_at").cast("string"), F.col("source_ts").cast("string")
        )
        return row.first()

    commit = at({"id": 1})[1]
    assert at({"id": 1})[0] == commit
    assert at({"id": 1, "updated_at": "2026-01-02T00:00:00Z"})[0] == "2026-01-02 00:00:00"
    assert at({"id": 1, "effective_at": "", "created_at": 1767312000000000})[0] == (
        "2026-01-02 00:00:00"
    )
    # Text that is no time does not fall through to the next member.
    assert at({"id": 1, "effective_at": "soon", "updated_at": "2026-01-02T00:00:00Z"})[0] == commit
    # A delete is dated by its commit, whatever its before image says.
    gone = {"id": 1, "effective_at": "2026-01-02T00:00:00Z"}
    assert at(None, "d", gone)[0] == commit


def test_keys(spark):
    assert one(spark, change(), b'{"id": 9}')["pk"] == "9"
    assert one(spark, change(), b'{"b": "x", "a": 1}')["pk"] == "1|x"
    assert one(spark, change(), b"12")["pk"] == "12"
    assert one(spark, change(), b"{")["reason"] == "missing_primary_key"
    accounts = {"id": 5, "company_name": "x"}
    assert one(spark, change(after=accounts, table="accounts"), b'{"id": 5}')["account_id"] == 5


def test_billing(spark):
    good = {"id": "evt_1", "type": "invoice.paid", "created_at": "2026-03-01T00:00:00Z"}
    cases = [
        (good, None),
        ({**good, "account_id": True}, None),
        (None, "tombstone_on_billing_topic"),
        ({**good, "id": 5}, "missing_provider_event_id"),
        ({**good, "type": ""}, "missing_event_type"),
        ({**good, "created_at": "someday"}, "invalid_timestamps"),
        ({**good, "account_id": "seven"}, "invalid_account_id"),
    ]
    rows = (
        parse_billing_webhooks(log_of(spark, *[c[0] for c in cases])).orderBy("offset").collect()
    )
    for row, (_, reason) in zip(rows, cases, strict=True):
        assert (row["reason"] or "").startswith(reason or "")
        assert (row["reason"] is None) == (reason is None)
    assert rows[0]["received_at"] == rows[0]["provider_created_at"]
    assert rows[1]["account_id"] == 1


def test_dead_text_is_repaired_and_cut(spark):
    df = spark.createDataFrame([(b"\xff" + b"x" * 9000,)], "value BINARY")
    text = df.select(raw_text(F.col("value"))).first()[0]
    assert len(text) == 8192
    assert text.startswith("�x")
