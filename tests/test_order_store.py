"""Stored order lines: the same plan, and no shuffle of lines."""

import pytest
from pyspark.sql import functions as F

from cartshift.operators import outbox
from cartshift.operators.orders import OrderSettings
from cartshift.plans import flows
from cartshift.sources import order_store
from cartshift.sources.readers import LEDGER_SCHEMA

SETTINGS = OrderSettings("delivery", "payment")


@pytest.fixture
def lines(order_lines):
    made = []
    for i in range(1, 8):
        created = "2019/03/01 10:00:00" if i % 2 else "2022/03/17 21:26:29"
        for n in range(1, 4 * i):
            made.append({
                "order_uid": f"A{i}", "created_at": created, "unit_price": str(n), "item_name": f"i{n}",
                "line_order_no": None if n % 5 == 0 else str(n % 3), "items_subtotal": "500" if i != 4 else "x",
                "platform_order_id": "P" if i == 6 else None,
            })
    return order_lines(*made)


@pytest.fixture
def empty_ledger(spark):
    return spark.createDataFrame([], LEDGER_SCHEMA)


@pytest.fixture
def uids(rows):
    return rows("order_uid string", *[(f"A{i}",) for i in range(1, 10)], (None,))


def found(plan):
    requests = outbox.whole_bodies(plan.requests)
    return (
        sorted((r.entity_id, r.request_id, r.body_json) for r in requests.collect()),
        sorted((str(r.entity_id), r.reason) for r in plan.rejects.collect()),
    )


@pytest.mark.parametrize("bits", [1, 13])
@pytest.mark.parametrize("bounds", [(None, None), ("A2", "A6")])
def test_same_plan_as_from_rows(spark, lines, uids, empty_ledger, tmp_path, bits, bounds):
    store = order_store.store_orders(lines, str(tmp_path), 5, bits)
    stored = flows.create_stored_orders(store, uids, empty_ledger, SETTINGS, "first", *bounds)
    plain = flows.create_orders(lines, uids, empty_ledger, SETTINGS, "first", *bounds)
    requests, rejects = found(stored)
    assert (requests, rejects) == found(plain)
    assert requests and ("A4", "bad_amount") in rejects


def ancestors(plan, mark):
    """The plan nodes above the first line that holds ``mark``."""
    rows = plan.splitlines()
    at = next(i for i, row in enumerate(rows) if mark in row)
    depth = lambda row: len(row) - len(row.lstrip(" :+-*"))
    above, level = [], depth(rows[at])
    for row in reversed(rows[:at]):
        if row.strip() and depth(row) < level:
            above.append(row)
            level = depth(row)
    return above


def test_no_line_is_shuffled(spark, lines, uids, empty_ledger, tmp_path):
    store = order_store.store_orders(lines, str(tmp_path), 6)
    plan = flows.create_stored_orders(store, uids, empty_ledger, SETTINGS, "first")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan.requests._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    above = ancestors(text, store.lines)
    assert sum("SortMergeJoin" in row for row in above) == 2
    assert not any("Exchange" in row for row in above), above
    assert "Exchange" in text  # of the orders' rows


def test_a_giant_order_is_spread_over_the_buckets(spark, order_lines, tmp_path):
    lines = order_lines(*[{"order_uid": "U1", "line_order_no": str(i)} for i in range(64)], {"order_uid": "U2"})
    store = order_store.store_orders(lines, str(tmp_path), 8, block_bits=2)
    files = store.read_lines(spark).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 5 and max(r["count"] for r in files) <= 24


def test_blocks_hold_the_sums_and_one_header(spark, lines, tmp_path):
    store = order_store.store_orders(lines, str(tmp_path), 3, block_bits=1)
    blocks = store.read_blocks(spark)
    assert blocks.where("header is not null").count() == 7
    assert blocks.agg(F.sum("unit_sum")).first()[0] == store.read_lines(spark).agg(F.sum("unit_amount")).first()[0]
    assert blocks.where("again").count() > 0


def test_a_header_is_stored_once_and_lines_are_shuffled_by_their_texts(spark, lines, tmp_path):
    store = order_store.store_orders(lines, str(tmp_path), 3, block_bits=1)
    stored = store.read_lines(spark)
    assert stored.count() == lines.count() and "recipient_name" not in stored.columns
    assert stored.where("header is not null").count() == stored.where("line_seq = 1").count() == 7


def test_headers_leave_the_lines_before_their_one_shuffle(spark, lines, tmp_path, monkeypatch):
    plans, write = [], order_store._write

    def seen(rows, *more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, *more)

    monkeypatch.setattr(order_store, "_write", seen)
    store = order_store.store_orders(lines.withColumn("again", F.lit(False)), str(tmp_path), 3)
    moved = [row for row in plans[0].splitlines() if "Exchange" in row]
    assert len(moved) == 1 and "Exchange" not in plans[1]
    below = plans[0].split("Exchange")[1]
    assert "(line_seq#" in below and "THEN struct(" in below and "regexp_extract" not in below
    blocks = store.read_blocks(spark).select("header.*").columns
    assert "recipient_name" not in blocks and "created_at" in blocks


def test_blocks_of_short_orders_stay_in_their_bucket(spark, lines, uids, empty_ledger, tmp_path, monkeypatch):
    plans, stored = [], flows.checkpointed
    monkeypatch.setattr(flows, "checkpointed", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stored(d))
    store = order_store.store_orders(lines, str(tmp_path), 6)
    flows.create_stored_orders(store, uids, empty_ledger, SETTINGS, "first")
    assert len(plans) == 2
    above = ancestors(plans[1], store.blocks)
    assert any("SortMergeJoin" in row for row in above) and not any("Exchange" in row for row in above)


def test_long_orders_among_short_ones_and_lines_without_an_id(spark, order_lines, empty_ledger, tmp_path):
    many = [{"order_uid": u, "line_order_no": str(n % 4), "created_at": "2023/03/01 10:00:00" if u == "L2" else "2022/03/17 21:26:29"}
            for u, k in (("L1", 9), ("L2", 9), ("S1", 2), (None, 7)) for n in range(k)]
    lines = order_lines(*many)
    wanted = lines.select("order_uid")
    store = order_store.store_orders(lines, str(tmp_path), 4, block_bits=2)
    stored = found(flows.create_stored_orders(store, wanted, empty_ledger, SETTINGS, "first"))
    assert stored == found(flows.create_orders(lines, wanted, empty_ledger, SETTINGS, "first"))
    assert [(u, body.count("cake")) for u, _, body in stored[0]] == [("L1", 9), ("L2", 4), ("S1", 2)]
    assert ("None", "no_lines") in stored[1]
