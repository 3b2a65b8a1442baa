from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartshift.operators import ledger, outbox

JAN, FEB, MAR = (datetime(2024, m, 1) for m in (1, 2, 3))


@pytest.fixture
def book(rows):
    return rows(
        ledger.LEDGER_SCHEMA,
        ("order", "U1", "platform_order_id", "old", JAN),
        ("order", "U1", "platform_order_id", "new", FEB),
        ("order", "U2", "status", "x", FEB),
        ("customer", "U2", "platform_order_id", "y", FEB),
        ("order", "U4", "platform_order_id", "a", MAR),
        ("order", "U4", "platform_order_id", "b", MAR),
    )


@pytest.fixture
def orders(rows):
    return rows(
        "order_uid string, platform string, platform_order_id string",
        ("U1", "USHOP", None), ("U1", "USHOP", None), ("U2", "USHOP", None),
        ("U2", "USHOP", None), ("U3", "other", None), ("U4", "USHOP", "kept?"), ("U5", "USHOP", ""),
    )


def test_latest_value_per_key_and_field(book, collect):
    assert collect(ledger.latest(book), "entity", "entity_id", "field", "value") == [
        ("customer", "U2", "platform_order_id", "y"),
        ("order", "U1", "platform_order_id", "new"),
        ("order", "U2", "status", "x"),
        ("order", "U4", "platform_order_id", "b"),
    ]


def test_write_back_reaches_every_line_of_a_key(book, orders, collect):
    written = ledger.write_back(orders, book, "order", "platform_order_id", "order_uid")
    assert collect(written, "order_uid", "platform_order_id") == [
        ("U1", "new"), ("U1", "new"), ("U2", None), ("U2", None), ("U3", None), ("U4", "b"),
        ("U5", ""),
    ]


def test_pending_looks_at_the_ledger_and_at_the_rows_own_state(book, orders, collect):
    left = ledger.pending(orders, book, "order", "platform_order_id", "order_uid")
    assert collect(left.distinct(), "order_uid") == [("U2",), ("U3",), ("U5",)]
    own = ledger.pending(
        orders, book, "order", "platform_order_id", "order_uid", state="platform_order_id"
    )
    assert collect(own.distinct(), "order_uid") == [("U2",), ("U3",)]


def test_missing_and_empty_ids_differ_for_recovery_only(orders, collect):
    assert collect(ledger.not_created(orders).distinct(), "order_uid") == [
        ("U1",), ("U2",), ("U3",), ("U5",)
    ]
    assert collect(ledger.unrecorded_orders(orders)) == [("U1",), ("U2",)]


def test_an_empty_outcome_is_not_written(rows, collect):
    found = rows("id string, v string", ("a", "x"), ("b", ""), ("c", None))
    written = ledger.entries(found, "order", "id", "f", F.col("v"), F.lit(JAN))
    assert collect(written, "entity_id", "value") == [("a", "x")]


def test_the_same_request_has_the_same_id(rows):
    rows_ = rows("customer_id string, point_diff int, outcome string", ("a", 1, "change"))
    first = outbox.points_requests(rows_).first()
    again = outbox.points_requests(rows_, phase="second").first()
    other = outbox.points_requests(rows_.withColumn("point_diff", F.lit(2))).first()
    assert first.request_id == again.request_id != other.request_id
    assert list(first.asDict()) == list(outbox.OUTBOX_COLUMNS)


def test_purge_and_cancel_are_off_by_default(rows):
    customers = rows("customer_id string", ("a",), ("b",), ("c",))
    assert outbox.purge_requests(customers, "a").count() == 0
    sent = outbox.purge_requests(customers, "a", enabled=True).orderBy("entity_id").collect()
    assert [(r.method, r.path, r.body_json) for r in sent] == [
        ("DELETE", "/customers/b", None), ("DELETE", "/customers/c", None)
    ]
    orders = rows("platform_order_id string", ("P1",))
    assert outbox.cancel_requests(orders).count() == 0
    (sent,) = outbox.cancel_requests(orders, enabled=True).collect()
    assert (sent.method, sent.path) == ("PATCH", "/orders/P1/cancel")
    assert sent.body_json == (
        '{"order_id":"P1","cancelled_reason":{"key":"other","message":"刪除測試商店訂單"}}'
    )
