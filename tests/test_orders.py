import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartshift.operators import orders, outbox
from cartshift.operators.orders import OrderSettings

SETTINGS = OrderSettings("delivery", "payment")


def items_of(lines, basis=orders.UNIT):
    parsed = orders.parse_amounts(lines)
    folded = orders.fold_orders(parsed, basis=basis)
    found = orders.order_items(parsed, folded).orderBy("order_uid", "position").collect()
    return [
        (r.item_data.name, r.item_price, r.item_data.price, r.quantity, r.total) for r in found
    ]


def document_of(lines, settings=SETTINGS):
    parsed = orders.parse_amounts(lines)
    folded = orders.fold_orders(parsed, basis=settings.balance_basis)
    requests = outbox.create_order_requests(orders.order_documents(parsed, folded, settings))
    whole = outbox.whole_bodies(requests).orderBy("entity_id").collect()
    return [json.loads(r.body_json)["order"] for r in whole]


@pytest.mark.parametrize(
    "price, rounded", [("10", 10), ("10.4", 10), ("10.5", 11), ("", 0), (None, 0)]
)
def test_prices_round_half_up(order_lines, price, rounded):
    lines = order_lines({"order_uid": "U1", "unit_price": price, "items_subtotal": "0"})
    name, item_price, text, *_ = items_of(lines)[0]
    assert (text, item_price) == (str(rounded), 0)  # the balance takes the price away


def test_item_order_and_positive_balance(order_lines):
    lines = order_lines(
        {"order_uid": "U1", "items_subtotal": "25", "shipping_fee": "60", "order_total": "80"},
        {"order_uid": "U1", "item_code": None, "item_name": "tea", "unit_price": "12"},
    )
    assert items_of(lines) == [
        ("A1-cake", 10, "10", 1, 10),
        ("null-tea", 12, "12", 1, 12),
        ("差額", 3, "3", 1, 3),
        ("運費", 60, "60", 1, 60),
        ("折扣及紅利點數", 5, None, None, 5),
        ("舊站訂單-U1", 0, "0", 1, 0),
    ]


def test_negative_balance_lowers_the_last_line_but_not_its_price_text(order_lines):
    lines = order_lines(
        {"order_uid": "U1", "items_subtotal": "19", "order_total": "19"},
        {"order_uid": "U1"},
    )
    assert items_of(lines)[:2] == [("A1-cake", 10, "10", 1, 10), ("A1-cake", 9, "10", 1, 9)]
    assert len(items_of(lines)) == 5


def test_balance_basis(order_lines):
    lines = order_lines({"order_uid": "U1", "quantity": "3", "items_subtotal": "30"})
    assert [i[0] for i in items_of(lines)][1] == "差額"
    assert items_of(lines)[1][1] == 20
    corrected = items_of(lines, orders.LINE_TOTAL)
    assert [i[0] for i in corrected] == ["A1-cake", "運費", "折扣及紅利點數", "舊站訂單-U1"]


@pytest.mark.parametrize(
    "subtotal, shipping, total, discount, bonus",
    [
        ("100", "60", "150", "0", Decimal(10)),
        ("100", "60", "160", "0", Decimal(0)),
        ("100", "0", "160", "0", Decimal(0)),
        ("100.5", "0", "100", "0", Decimal("0.5")),
        ("abc", "0", "10", "0", Decimal(0)),
        ("100", "60.9", "150.9", "5.9", Decimal(5)),
    ],
)
def test_bonus(order_lines, subtotal, shipping, total, discount, bonus):
    lines = order_lines(
        {"order_uid": "U1", "items_subtotal": subtotal, "shipping_fee": shipping,
         "order_total": total, "discount_total": discount}
    )
    row = orders.fold_orders(orders.parse_amounts(lines)).first()
    assert row.bonus == bonus
    whole = int(bonus)
    assert row.subtotal == row.total_amount + row.discount_amount + whole
    if bonus > 0 and bonus == whole:
        paid = row.bonus + row.total + row.discount_amount
        assert paid == row.subtotal_amount + row.shipping_amount


@pytest.mark.parametrize(
    "column, text",
    [("unit_price", "abc"), ("quantity", ""), ("order_total", "x"), ("shipping_fee", None),
     ("discount_total", ""), ("items_subtotal", "12abc")],
)
def test_unreadable_amounts_are_rejected(order_lines, column, text):
    parsed = orders.parse_amounts(order_lines({"order_uid": "U1", column: text}))
    assert orders.fold_orders(parsed).where(orders.bad_amounts()).count() == 1


def test_readable_amounts_are_not_rejected(order_lines):
    parsed = orders.parse_amounts(order_lines({"order_uid": "U1", "quantity": "2x"}))
    assert orders.fold_orders(parsed).where(orders.bad_amounts()).count() == 0


@pytest.mark.parametrize(
    "created, kept",
    [
        ("2023/01/01 00:00:00", 3),
        ("2023/06/30 23:59:59", 3),
        ("2023/07/01 00:00:00", 5),
        ("2022/03/01 00:00:00", 5),
        (None, 5),
        ("", 5),
    ],
)
def test_repeated_lines_go_in_some_months_only(order_lines, created, kept):
    numbers = ["1", "1", "2", None, None]
    lines = order_lines(
        *[
            {"order_uid": "U1", "line_order_no": n, "item_code": str(i),
             # only the first line's date counts
             "created_at": created if i == 0 else "2021/01/01 00:00:00"}
            for i, n in enumerate(numbers)
        ]
    )
    left = orders.drop_repeated_lines(lines)
    assert left.columns == lines.columns
    expected = [1, 3, 4] if kept == 3 else [1, 2, 3, 4, 5]
    assert sorted(r.line_seq for r in left.collect()) == expected


def test_repeated_lines_per_order(order_lines, collect):
    month = {"created_at": "2023/03/17 21:26:29", "line_order_no": "1"}
    lines = order_lines({"order_uid": "U1"} | month, {"order_uid": "U2"} | month)
    assert orders.drop_repeated_lines(lines).count() == 2


@pytest.mark.parametrize(
    "email, used",
    [
        (None, "fakeUser@gmail.com"),
        ("", "fakeUser@gmail.com"),
        ("user1@example.com", "user1@example.com"),
        ("user1@example.com註銷本帳號", "fakeUser@gmail.com"),
    ],
)
def test_email_fallback(order_lines, email, used):
    lines = order_lines({"order_uid": "U1", "customer_email": email})
    assert document_of(lines)[0]["customer_email"] == used


def test_address_needs_a_city_and_phone_has_a_placeholder(order_lines):
    given = {"recipient_name": "Ann", "recipient_address": "台北市1號", "postcode": "100"}
    lines = order_lines(
        {"order_uid": "U1", "recipient_city": "台北市", "recipient_phone": "0900000001"} | given,
        {"order_uid": "U2", "recipient_city": "", "recipient_phone": ""} | given,
        {"order_uid": "U3"} | given,
    )
    full, *rest = [d["delivery_address"] for d in document_of(lines)]
    assert full == {
        "recipient_name": "Ann",
        "recipient_phone": "0900000001",
        "address_1": "台北市1號",
        "postcode": "100",
        "city": "台北市",
        "country_code": "TW",
    }
    assert rest == [{"recipient_name": "Ann", "recipient_phone": "0000000000"}] * 2


def test_remark_parts_in_order(order_lines):
    every = {
        "shop_note": "a", "cancel_reason": "b", "buyer_note": "c", "delivery_note": "d",
        "created_at": "e", "order_status": "f", "payment_info": "g", "paid_at": "h",
        "allocated_at": "i", "delivery_state": "j", "delivery_type": "k",
    }
    nothing = {name: "" for name in every}
    lines = order_lines(
        {"order_uid": "U1"} | every,
        {"order_uid": "U2"} | nothing,
        {"order_uid": "U3"} | nothing | {"paid_at": "h", "created_at": None},
    )
    assert [d["order_remarks"] for d in document_of(lines)] == [
        "店家備註: a。取消原因: b。買家備註: c。出貨備註: d。建立時間: e。訂單狀態: f。"
        "付款資訊: g。付款日期: h。配貨時間: i。配送狀態: j。出貨類型: k。",
        "",
        "付款日期: h。",
    ]


def test_document(order_lines):
    lines = order_lines(
        {"order_uid": "U1", "items_subtotal": "10", "shipping_fee": "60", "order_total": "65",
         "customer_email": "user1@example.com"}
    )
    (document,) = document_of(lines)
    assert document["delivery_option_id"] == "delivery"
    assert document["payment_method_id"] == "payment"
    assert (document["subtotal"], document["total"]) == (70, 65)
    assert document["items"] == [
        {"item_type": "CustomProduct", "item_price": 10,
         "item_data": {"name": "A1-cake", "price": "10"}, "quantity": 1, "total": 10},
        {"item_type": "CustomProduct", "item_price": 60,
         "item_data": {"name": "運費", "price": "60"}, "quantity": 1, "total": 60},
        {"item_type": "CustomDiscount", "item_price": 5,
         "item_data": {"name": "折扣及紅利點數"}, "total": 5},
        {"item_type": "CustomProduct", "item_price": 0,
         "item_data": {"name": "舊站訂單-U1", "price": "0"}, "quantity": 1, "total": 0},
    ]


def test_a_giant_order_is_one_request_at_any_block_size(order_lines):
    lines = order_lines(
        *[{"order_uid": "U1", "unit_price": str(i), "items_subtotal": "9"} for i in range(1, 12)],
        {"order_uid": "U2", "recipient_name": None},
    )
    parsed = orders.parse_amounts(lines)
    folded = orders.fold_orders(parsed)

    def requests(bits):
        settings = OrderSettings("delivery", "payment", block_bits=bits)
        return outbox.create_order_requests(orders.order_documents(parsed, folded, settings))

    whole = {r.entity_id: (r.request_id, r.body_json) for r in requests(13).collect()}
    pieces = requests(2)
    settings = OrderSettings("delivery", "payment", block_bits=2)
    at_once = outbox.whole_order_requests(orders.order_documents(parsed, folded, settings)).collect()
    assert {r.entity_id: (r.request_id, r.body_json) for r in at_once} == whole and {r.seq for r in at_once} == {1}
    assert pieces.where("entity_id = 'U1'").count() == 3
    joined = {r.entity_id: (r.request_id, r.body_json) for r in outbox.whole_bodies(pieces).collect()}
    assert joined == whole and len(whole) == 2
    assert len(json.loads(whole["U1"][1])["order"]["items"]) == 14
    assert '"recipient_name":null' in whole["U2"][1]


def ids_of(lines, bits=13, **settings):
    parsed = orders.parse_amounts(lines)
    folded = orders.fold_orders(parsed)
    chosen = OrderSettings("delivery", "payment", block_bits=bits, **settings)
    requests = outbox.create_order_requests(orders.order_documents(parsed, folded, chosen))
    return {r.entity_id: r.request_id for r in requests.select("entity_id", "request_id").distinct().collect()}


LINES = [
    {"order_uid": "U1", "item_code": "A", "item_name": "tea", "unit_price": "5", "quantity": "2"},
    {"order_uid": "U1", "item_code": "B", "item_name": "cup", "unit_price": "7", "quantity": "2"},
    {"order_uid": "U1", "item_code": "C", "item_name": "pot", "unit_price": "5", "quantity": "1"},
]


@pytest.mark.parametrize(
    "line, change",
    [
        (1, {"item_name": "mug"}),
        (1, {"item_code": "D"}),
        (1, {"item_code": None}),
        (0, {"item_code": "A|tea", "item_name": ""}),
        (2, {"item_name": "pot-"}),
        (0, {"shipping_fee": "60x"}),
        (0, {"customer_email": "a|b@c.d"}),
    ],
)
def test_a_changed_document_has_another_id(order_lines, line, change):
    changed = [dict(d, **change) if i == line else d for i, d in enumerate(LINES)]
    assert ids_of(order_lines(*LINES)) != ids_of(order_lines(*changed))


def test_sums_that_stay_do_not_hide_a_change(order_lines):
    """Same prices, same sums: units that move between lines, and lines that change places."""
    moved = [dict(LINES[0], quantity="1"), LINES[1], dict(LINES[2], quantity="2")]
    swapped = [LINES[2], LINES[1], LINES[0]]
    assert len({ids_of(order_lines(*d))["U1"] for d in (LINES, moved, swapped, LINES)}) == 3


def test_the_id_is_the_same_in_blocks_of_any_size_and_for_equal_documents(order_lines):
    many = [dict(LINES[i % 3], item_name=f"n{i}") for i in range(20)]
    assert len({ids_of(order_lines(*many), bits)["U1"] for bits in (1, 2, 13)}) == 1
    assert ids_of(order_lines(*many)) != ids_of(order_lines(*many), null_text="-")


def test_fields_cannot_run_into_each_other(order_lines):
    one = dict(LINES[0], item_code="A|", item_name="B")
    other = dict(LINES[0], item_code="A", item_name="|B")
    assert ids_of(order_lines(one)) != ids_of(order_lines(other))


def test_items_agree_with_the_documents(order_lines):
    lines = order_lines(
        *[{"order_uid": f"U{i % 3}", "unit_price": str(i), "items_subtotal": "20",
           "quantity": str(i % 4 + 1)} for i in range(20)]
    )
    flat = [i[:3] for i in items_of(lines)]
    nested = [
        (i["item_data"]["name"], i["item_price"], i["item_data"].get("price"))
        for d in document_of(lines)
        for i in d["items"]
    ]
    assert flat == nested


def test_subtotal_fraction(order_lines, collect):
    lines = order_lines(
        {"order_uid": "1", "items_subtotal": "9.25"}, {"order_uid": "2", "items_subtotal": "9"}
    )
    flag, fraction = orders.subtotal_fraction(F.col("items_subtotal"))
    shown = collect(lines.select("order_uid", flag.alias("f"), fraction.alias("x")))
    assert shown == [("1", True, Decimal("0.25")), ("2", False, Decimal(0))]


def test_lines_are_numbered_in_file_order(rows, collect):
    lines = rows("order_uid string, at int", ("a", 30), ("b", 5), ("a", 10), ("a", 20))
    numbered = orders.with_line_seq(lines, ["at"])
    assert collect(numbered) == [("a", 10, 1), ("a", 20, 2), ("a", 30, 3), ("b", 5, 1)]


def test_no_python_in_the_plan(order_lines):
    parsed = orders.parse_amounts(order_lines({"order_uid": "U1"}))
    folded = orders.fold_orders(parsed)
    documents = orders.order_documents(parsed, folded, SETTINGS)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan
