import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators import grouping, ledger, outbox
from cartshift.operators.ledger import LEDGER_SCHEMA
from cartshift.operators.orders import OrderSettings
from cartshift.plans import flows
from cartshift.sources import readers, writers
from cartshift.sources.schemas import RESPONSES
from cartshift.streaming import answers

SETTINGS = OrderSettings("delivery", "payment")
NOW, LATER = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture
def empty_ledger(rows):
    return rows(LEDGER_SCHEMA)


@pytest.fixture
def store(order_lines, rows):
    month = "2023/03/17 21:26:29"
    lines = order_lines(
        {"order_uid": "U1"},
        {"order_uid": "U1", "unit_price": "x"},  # unreadable
        {"order_uid": "U2", "created_at": month, "line_order_no": "1"},
        {"order_uid": "U2", "created_at": month, "line_order_no": "1"},  # exported twice
        {"order_uid": "U3", "platform_order_id": "P3"},  # exists
        {"order_uid": "U4", "platform_order_id": ""},
        {"order_uid": "U9"},  # outside of the range
    ).withColumn("platform", F.lit("USHOP"))
    uids = rows("order_uid string", *[(f"U{i}",) for i in (1, 2, 3, 4, 5, 9)])
    return lines, uids


def create(store, book):
    return flows.create_orders(*store, book, SETTINGS, "first", "U1", "U9")


def answer(requests, rows, status=200, body='{"id":"%s"}', at=NOW):
    """What the platform says to each request."""
    return rows(
        RESPONSES,
        *[
            (r.request_id, r.entity, r.entity_id, status, body.replace("%s", "P" + r.entity_id), at)
            for r in requests.collect()
        ],
    )


def test_every_order_is_created_settled_or_rejected(store, empty_ledger, collect):
    plan = create(store, empty_ledger)
    assert collect(plan.requests, "entity_id") == [("U2",), ("U4",)]
    assert collect(plan.rejects) == [
        ("order", "U1", "bad_amount"), ("order", "U5", "no_lines")
    ]
    bodies = {r.entity_id: json.loads(r.body_json)["order"] for r in plan.requests.collect()}
    products = [i for i in bodies["U2"]["items"] if i["item_data"]["name"] == "A1-cake"]
    assert len(products) == 1


def test_a_rerun_creates_nothing_twice(store, empty_ledger, rows, collect):
    plan = create(store, empty_ledger)
    written = flows.record_created(answer(plan.requests, rows))
    assert collect(written, "entity_id", "field", "value") == [
        ("U2", "platform_order_id", "PU2"), ("U4", "platform_order_id", "PU4")
    ]
    assert create(store, written).requests.count() == 0
    partial = written.where("entity_id = 'U2'")
    assert collect(create(store, partial).requests, "entity_id") == [("U4",)]
    failed = flows.record_created(answer(plan.requests, rows, status=422))
    assert failed.count() == 0


def exported_csv(folder, orders):
    """A CSV export under the legacy headings: ``orders`` as dicts by the names used here."""
    headings = {new: old for old, new in fixed.ORDER_LINE_COLUMNS.items() if new != "order_uid"}
    headings["platform_order_id"] = "new id"
    usual = {
        "platform": "U", "unit_price": "10", "quantity": "1", "items_subtotal": "10",
        "order_total": "10", "discount_total": "0", "shipping_fee": "0",
        "created_at": "2023/03/17 21:26:29", "order_status": "新訂單", "recipient_name": "A",
    }
    text = ",".join(headings.values()) + "\n"
    for order in orders:
        text += ",".join((usual | order).get(name, "") for name in headings) + "\n"
    folder.mkdir()
    (folder / "orders.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_from_the_raw_export_to_requests(spark, tmp_path, empty_ledger, collect):
    long_order = [
        {"transaction_no": "1", "line_order_no": str(n), "item_name": f"item {n}"}
        for n in range(2000, 0, -1)
    ]
    folder = exported_csv(tmp_path / "export", [
        *long_order,
        {"transaction_no": "1", "line_order_no": "7", "item_name": "again"},  # exported twice
        {"transaction_no": "2", "recipient_name": '""', "delivery_type": fixed.UNCHOSEN_DELIVERY},
        {"transaction_no": "3", "platform_order_id": "P3"},
        {"transaction_no": "4", "recipient_address": "台北市1"},
    ])
    before = {key: spark.conf.get(key) for key in SMALL_PARTS}
    for key, value in SMALL_PARTS.items():
        spark.conf.set(key, value)
    try:
        read = readers.read_order_lines(spark, folder, "new id")
        assert read.rdd.getNumPartitions() > 3  # the place of a line holds across parts of a file
        lines = flows.prepare_orders(read)
        uids = flows.prepare_order_uids(lines)
        assert collect(uids) == [("U1",), ("U3",), ("U4",)]
        plan = flows.create_orders(lines, uids, empty_ledger, SETTINGS, "first")
        bodies = {
            r.entity_id: json.loads(r.body_json)["order"] for r in plan.requests.collect()
        }
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert set(bodies) == {"U1", "U4"} and plan.rejects.count() == 0
    names = [i["item_data"]["name"] for i in bodies["U1"]["items"]]
    assert names[:2000] == [f"null-item {n}" for n in range(2000, 0, -1)]
    assert "null-again" not in names
    assert bodies["U4"]["delivery_address"]["city"] == "台北市"


# Parts of a file that a small test file has several of.
SMALL_PARTS = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}


def test_only_the_phase_asked_for_is_planned(store, empty_ledger, collect):
    lines, uids = store
    first, second = F.lit("first"), F.lit("second")
    lines = lines.withColumn("phase", F.when(F.col("order_uid") == "U2", second).otherwise(first))
    uids = uids.withColumn("phase", F.when(F.col("order_uid") == "U2", second).otherwise(first))
    for phase, expected in (("first", [("U4",), ("U9",)]), ("second", [("U2",)])):
        plan = flows.create_orders(lines, uids, empty_ledger, SETTINGS, phase)
        assert collect(plan.requests, "entity_id") == expected
    with pytest.raises(ValueError, match="unknown phase"):
        flows.create_orders(lines, uids, empty_ledger, SETTINGS, "no-such-phase")


def test_statuses_use_the_recorded_ids(store, rows, collect):
    book = rows(LEDGER_SCHEMA, ("order", "U2", "platform_order_id", "P2", NOW))
    plan = flows.sync_statuses(*store, book, "first", "U2", "U6")
    assert collect(plan.requests, "entity_id", "seq") == [
        ("P2", 1), ("P2", 2), ("P2", 3), ("P3", 1), ("P3", 2), ("P3", 3)
    ]
    assert collect(plan.rejects.distinct()) == [
        ("order", "U4", "no_platform_id"), ("order", "U5", "no_lines")
    ]
    assert plan.rejects.count() == 4


def test_recovery_settles_single_hits(store, rows, collect):
    book = rows(LEDGER_SCHEMA, ("order", "U9", "platform_order_id", "P9", NOW))
    found = rows("query string, platform_order_id string", ("U1", "a"), ("U2", "b"), ("U2", "c"))
    plan = flows.recover_orders(store[0], book, found, F.lit(NOW))
    assert collect(plan.settled, "entity_id", "value") == [("U1", "a")]
    assert collect(plan.rejects, "entity_id", "reason") == [("U2", "ambiguous")]
    again = flows.recover_orders(
        store[0], book.unionByName(plan.settled), found, F.lit(LATER)
    )
    assert again.settled.count() == 0


RECON = "customer_id string, email string, legacy_points int, legacy_credits int, " \
    "platform_credits int, platform_points int"
SNAPSHOT = "customer_id string, balance int, fetched_at timestamp"


@pytest.fixture
def recon(rows):
    return rows(
        RECON,
        ("same", "a", 5, 0, 0, 0), ("more", "b", 9, 0, 0, 0), ("lost", "d", 1, 0, 0, 0),
        (None, "g", 3, 0, 0, 0),
    )


@pytest.fixture
def snapshot(rows):
    return rows(SNAPSHOT, ("same", 5, NOW), ("more", 0, NOW), ("more", 4, LATER))


def test_points_from_plan_to_audit(
    spark, tmp_path, recon, snapshot, empty_ledger, rows, collect
):
    plan = flows.plan_points(recon, empty_ledger, snapshot, F.lit(NOW))
    assert collect(plan.requests, "entity_id") == [("more",)]
    assert json.loads(plan.requests.first().body_json)["value"] == 5
    assert collect(plan.settled, "entity_id", "value") == [("same", "no_diff")]
    assert collect(plan.rejects, "entity_id", "reason") == [
        ("lost", "no_balance"), (None, "no_platform_id")
    ]
    body = '{"point_balance":9}'
    done = flows.record_points(answer(plan.requests, rows, body=body), recon)
    assert collect(done, "entity_id", "field", "value") == [("more", "points_status", "success")]
    wrong = flows.record_points(answer(plan.requests, rows, body='{"point_balance":8}'), recon)
    assert collect(wrong, "value") == [("wrong",)]
    failed = flows.record_points(answer(plan.requests, rows, status=500, body="{}"), recon)
    assert collect(failed, "value") == [("fail",)]

    path = str(tmp_path / "ledger")
    writers.append_ledger(plan.settled, path)
    writers.append_ledger(done, path)
    book = readers.read_ledger(spark, path)
    again = flows.plan_points(recon, book, snapshot, F.lit(LATER))
    assert again.requests.count() == 0 and again.settled.count() == 0

    after = rows(SNAPSHOT, ("same", 5, LATER), ("more", 8, LATER))
    audit = flows.audit_points(recon, book, after, F.lit(LATER))
    assert collect(audit, "entity_id", "value") == [
        ("lost", "false"), ("more", "false"), ("same", "true")
    ]
    assert flows.audit_points(recon, audit, after, F.lit(LATER)).count() == 0


def test_tags_from_plan_to_ledger(rows, empty_ledger, collect):
    recon = rows(
        "customer_id string, full_name string, email string, tier string",
        ("p1", "Ann", "a", "VIP"), (None, "Bob", "b", "VVIP"),
    )
    plan = flows.plan_tags(recon, empty_ledger)
    assert collect(plan.rejects) == [("customer", "b", "no_platform_id")]
    done = flows.record_tags(answer(plan.requests, rows, body='{"tags":["0325-VIP"]}'))
    assert collect(done, "entity_id", "value") == [("p1", "success")]
    empty = flows.record_tags(answer(plan.requests, rows, body='{"tags":[]}'))
    assert collect(empty, "entity_id", "value") == [("p1", "fail")]
    failed = flows.record_tags(answer(plan.requests, rows, status=500, body="{}"))
    assert failed.count() == 0  # planned again by the next run
    assert flows.plan_tags(recon, done).requests.count() == 0


def test_answers_are_written_back_once_as_they_arrive(spark, tmp_path, recon, collect):
    inbox, book, marks = (str(tmp_path / d) for d in ("inbox", "ledger", "marks"))
    (tmp_path / "inbox").mkdir()

    def drop(name, entity_id, balance):
        line = {
            "request_id": name, "entity": "customer", "entity_id": entity_id,
            "http_status": 200, "answer": json.dumps({"point_balance": balance}),
            "answered_at": "2024-01-01T00:00:00",
        }
        (tmp_path / "inbox" / f"{name}.json").write_text(json.dumps(line) + "\n")

    def run():
        query = answers.write_back(
            answers.answers(spark, inbox),
            lambda df: flows.record_points(df, recon),
            book,
            marks,
            once=True,
        )
        query.awaitTermination()

    drop("r1", "more", 9)
    run()
    drop("r2", "same", 4)
    run()
    run()
    written = readers.read_ledger(spark, book)
    assert collect(written, "entity_id", "value") == [("more", "success"), ("same", "wrong")]
    left = ledger.pending(recon, written, "customer", "points_status", "customer_id")
    assert collect(left, "customer_id") == [("lost",), (None,)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity" in plan


def test_streamed_and_appended_ledger_rows_are_all_read(spark, tmp_path, recon, rows, collect):
    inbox, book, marks = (str(tmp_path / d) for d in ("inbox", "ledger", "marks"))
    (tmp_path / "inbox").mkdir()
    entry = lambda i: rows(LEDGER_SCHEMA, ("customer", i, "points_status", "no_diff", NOW))
    writers.append_ledger(entry("first"), book)
    line = {
        "request_id": "r", "entity": "customer", "entity_id": "more", "http_status": 200,
        "answer": json.dumps({"point_balance": 9}), "answered_at": "2024-01-01T00:00:00",
    }
    (tmp_path / "inbox" / "r.json").write_text(json.dumps(line) + "\n")
    arriving = answers.answers(spark, inbox)
    judge = lambda df: flows.record_points(df, recon)
    answers.write_back(arriving, judge, book, marks, once=True).awaitTermination()
    writers.append_ledger(entry("last"), book)
    read = readers.read_ledger(spark, book)
    assert collect(read, "entity_id") == [("first",), ("last",), ("more",)]


def test_phase_is_checked_and_filtered(store, empty_ledger, collect):
    lines, uids = store
    with pytest.raises(ValueError):
        flows.create_orders(lines, uids, empty_ledger, SETTINGS, phase="no-such-phase")
    both = lines.withColumn("phase", F.lit("first")).unionByName(lines.withColumn("phase", F.lit("second")))
    ids = uids.withColumn("phase", F.lit("first"))
    got = flows.create_orders(both, ids, empty_ledger, SETTINGS, phase="first").requests
    one = flows.create_orders(lines, uids, empty_ledger, SETTINGS, phase="first").requests
    assert collect(got, "entity_id", "body_json") == collect(one, "entity_id", "body_json")


def test_customers_end_to_end(rows, collect):
    from cartshift.sources.schemas import LEGACY_CUSTOMERS

    legacy = rows(
        LEGACY_CUSTOMERS,
        ("Ann", "b@example.com", "0900-000-001", "2011-1-5", None, 5, 0, "台北市大安區", "VIP"),
        ("Bob", "a@example.com", "0900000001", "1990-1-5", "", 0, 7, "南投門市", "一般"),
    )
    prepared = flows.prepare_customers(legacy)
    assert collect(prepared, "email_address", "mobile_number", "note", "address_1") == [
        ("a@example.com", "0900000001", "舊站電話-0900000001。", None),
        ("b@example.com", None, "舊站-會員備註-,舊站電話-0900-000-001。", "大安區"),
    ]


def test_numbered_lines_are_folded_where_they_are(spark, order_lines, empty_ledger, monkeypatch):
    """One exchange of the lines, in one job; orders of one block need no line after that."""
    lines = order_lines(
        *[{"order_uid": f"U{i}", "line_order_no": str(n % 2), "created_at": m} for i, m in ((1, "2023/02/01 0:0:0"), (2, "2022/02/01 0:0:0")) for n in range(5)]
    ).withColumnRenamed("line_seq", "at").withColumn("platform", F.lit("U")).withColumn("transaction_no", F.col("order_uid"))
    prepared = flows.prepare_orders(lines, ["at"])
    uids = prepared.select("order_uid").distinct()
    plans = []
    stored = flows.checkpointed
    monkeypatch.setattr(flows, "checkpointed", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stored(d))
    plan = flows.create_orders(prepared, uids, empty_ledger, SETTINGS, phase="first")
    assert len(plans) == 2 and plans[1].count("Exchange hashpartitioning(order_uid") <= 2  # lines, and wanted ids if not broadcast
    text = plan.requests._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text
    bodies = {r.entity_id: r.body_json for r in plan.requests.collect()}
    assert {u: body.count("cake") for u, body in bodies.items()} == {"UU1": 2, "UU2": 5}


def test_long_orders_are_in_pieces_beside_short_ones(spark, order_lines, empty_ledger, collect):
    lines = order_lines(*[{"order_uid": u, "line_order_no": str(n)} for u, k in (("U1", 7), ("U2", 2)) for n in range(k)])
    settings = OrderSettings("delivery", "payment", block_bits=2)
    whole = {}
    for chosen in (settings, SETTINGS):
        plan = flows.create_orders(lines, lines.select("order_uid"), empty_ledger, chosen, phase="first")
        whole[chosen.block_bits] = [r[-1].replace("delivery-id", "").replace("payment-id", "") for r in collect(outbox.whole_order_requests(plan.documents), "entity_id", "body_json")]
        assert plan.requests.count() == (3 if chosen is settings else 2)
    cakes = [[body.count("cake") for body in bodies] for bodies in whole.values()]
    assert cakes == [[7, 2], [7, 2]]


def test_lines_that_lie_together_are_folded_before_they_are_moved(spark, order_lines, empty_ledger, monkeypatch, tmp_path):
    lines = order_lines(
        *[{"order_uid": f"{i}", "line_order_no": str(n % 2), "created_at": m, "items_subtotal": "20"} for i, m in ((1, "2023/02/01 0:0:0"), (2, "2022/02/01 0:0:0")) for n in range(5)]
    ).withColumnRenamed("line_seq", "at").withColumn("platform", F.lit("U")).withColumn("transaction_no", F.col("order_uid")).drop("order_uid")
    lines.repartition(3, "transaction_no").write.bucketBy(3, "transaction_no").option("path", str(tmp_path / "laid")).format("parquet").saveAsTable("laid_lines")
    exported = spark.table("laid_lines")
    plain = flows.prepare_orders(exported, ["at"])
    uids = plain.select("order_uid").distinct()
    bodies = []
    plans, stored = [], flows.checkpointed
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    monkeypatch.setattr(flows, "checkpointed", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stored(d))
    for prepared in (plain, flows.prepare_orders(exported, ["at"], laid_by=("platform", "transaction_no"))):
        plan = flows.create_orders(prepared, uids, empty_ledger, SETTINGS, phase="first")
        bodies.append(sorted((r.entity_id, r.request_id, r.body_json) for r in plan.requests.collect()))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert bodies[0] == bodies[1] and len(bodies[0]) == 2
    before_exchange = [plan.split("FileScan")[0].rsplit("Exchange hashpartitioning(order_uid", 1)[1] for plan in (plans[1], plans[3])]
    assert "Window" not in before_exchange[0] and "Window" in before_exchange[1]
    assert "Aggregate" in before_exchange[1]
    assert not any("regexp_extract(items_subtotal" in plan for plan in plans)  # amounts of an order are read once
