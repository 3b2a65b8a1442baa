import pytest

from cartshift.operators import outbox, status

PAID = "2023/01/01 00:00:00"


def decide(order_lines, state, paid=None, shipped=None, platform_id="P1"):
    lines = order_lines(
        {"order_uid": "U1", "order_status": state, "paid_at": paid, "shipped_at": shipped,
         "platform_order_id": platform_id}
    )
    return status.decide_statuses(lines).first()


@pytest.mark.parametrize(
    "state, paid, shipped, expected",
    [
        ("交易終結", None, None, ("completed", "completed", "arrived")),
        ("交易終結", PAID, PAID, ("completed", "completed", "arrived")),
        ("出貨中", None, None, ("confirmed", "pending", "shipping")),
        ("出貨中", PAID, None, ("confirmed", "completed", "shipping")),
        ("已出貨", "", "", ("confirmed", "pending", "shipped")),
        ("已取消", PAID, PAID, ("cancelled", "refunded", "returned")),
        ("已取消", "", "", ("cancelled", "pending", "pending")),
        ("已取消", None, PAID, ("cancelled", "pending", "returned")),
        ("新訂單", None, None, ("pending", "pending", "pending")),
        ("新訂單", PAID, None, ("pending", "completed", "pending")),
    ],
)
def test_known_states(order_lines, state, paid, shipped, expected):
    row = decide(order_lines, state, paid, shipped)
    assert (row.order_to, row.payment_to, row.delivery_to) == expected
    assert {row.order_outcome, row.payment_outcome, row.delivery_outcome} == {"ok"}


@pytest.mark.parametrize("state", ["other", "", None])
@pytest.mark.parametrize("platform_id", [None, ""])
def test_which_check_comes_first(order_lines, state, platform_id):
    row = decide(order_lines, state, platform_id=platform_id)
    assert row.order_outcome == "unknown_status"
    assert row.payment_outcome == "no_platform_id"
    assert row.delivery_outcome == "no_platform_id"


def test_unknown_state_with_a_platform_id(order_lines):
    row = decide(order_lines, "other", PAID)
    outcomes = (row.order_outcome, row.payment_outcome, row.delivery_outcome)
    assert outcomes == ("unknown_status", "ok", "unknown_status")
    assert row.payment_to == "completed"


def test_three_requests_in_sequence(order_lines):
    lines = order_lines(
        {"order_uid": "U1", "order_status": "已取消", "platform_order_id": "P1"},
        {"order_uid": "U2", "order_status": "已取消", "platform_order_id": None},
    )
    changes = status.status_changes(status.decide_statuses(lines))
    sent = outbox.status_requests(changes, "first").orderBy("seq").collect()
    assert [(r.seq, r.method, r.path, r.body_json, r.phase) for r in sent] == [
        (1, "PATCH", "/orders/P1/status", '{"status":"cancelled"}', "first"),
        (2, "PATCH", "/orders/P1/order_payment_status", '{"status":"pending"}', "first"),
        (3, "PATCH", "/orders/P1/order_delivery_status", '{"status":"pending"}', "first"),
    ]
    assert len({r.request_id for r in sent}) == 3


def test_outcome_summary(rows, collect):
    answers = rows("http_status int", (200,), (201,), (422,), (500,), (None,))
    assert collect(status.outcome_summary(answers)) == [
        ("error", 2), ("success", 2), ("unprocessable", 1)
    ]
