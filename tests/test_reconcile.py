from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartshift.operators import outbox, reconcile

LEGACY = "name string, email string, points int, credits int, tier string"
PLATFORM = "customer_id string, email string, credits int, points int"


@pytest.fixture
def stores(rows):
    legacy = rows(
        LEGACY,
        ("Ann", "User1@Example.com", 5, 0, "VIP"),
        ("Bob", "user2@example.com", 0, 0, "VIP"),
        ("Cas", "user3@example.com", None, 3, "一般"),
        ("Dee", "user4@example.com", None, None, None),
        ("Eve", None, 7, 0, "VVIP"),
        ("Fay", "user6@example.com", 0, 0, "VIP"),
    )
    platform = rows(
        PLATFORM,
        ("p1", "user1@example.com", 0, 0),
        ("p2", "user2@example.com", 0, 0),
        ("p3", "user3@example.com", 0, None),
        ("p8", "user8@example.com", 0, 9),
        ("p9", "user9@example.com", None, None),
        ("p0", None, 4, 0),
    )
    return legacy, platform


def test_full_join_matches_lower_case_and_keeps_both_sides(stores, collect):
    recon = reconcile.points_recon(*stores)
    assert recon.columns == list(reconcile.POINTS_COLUMNS)
    assert collect(recon) == sorted(
        [
            ("p1", "Ann", "User1@Example.com", 0, 0, 0, 5),
            ("p3", "Cas", "user3@example.com", 0, None, 3, None),
            (None, "Eve", None, None, None, 0, 7),
            ("p8", None, None, 0, 9, None, None),
            ("p0", None, None, 4, 0, None, None),
        ],
        key=lambda t: [(x is None, str(x)) for x in t],
    )


def test_earlier_versions_match_as_written(stores, collect):
    inner = reconcile.points_recon(*stores, how="inner")
    assert collect(inner, "customer_id") == [("p3",)]
    left = reconcile.points_recon(*stores, how="left")
    assert collect(left, "full_name", "customer_id") == [("Ann", None), ("Cas", "p3"), ("Eve", None)]


def test_full_join_equals_the_plain_one(rows, collect):
    left = rows("k string, a int", ("x", 1), ("x", 2), ("y", 3), (None, 4), (None, 5))
    right = rows("k string, b int", ("x", 1), ("x", 2), ("z", 3), (None, 4))
    assert collect(reconcile.full_join(left, right, "k"), "k", "a", "b") == collect(
        left.join(right, "k", "full"), "k", "a", "b"
    )


def test_special_tiers_drop_the_right_only_part_from_the_plan(stores, collect):
    tags = reconcile.tag_recon(*stores)
    assert collect(tags) == [
        ("p1", "Ann", "User1@Example.com", "VIP"),
        ("p2", "Bob", "user2@example.com", "VIP"),
        (None, "Eve", None, "VVIP"),
        (None, "Fay", "user6@example.com", "VIP"),
    ]
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "FullOuter" not in plan


def test_tag_plan_and_requests(stores, collect):
    plan = reconcile.tag_plan(reconcile.tag_recon(*stores))
    assert collect(plan, "full_name", "outcome", F.col("tags")[0]) == [
        ("Ann", "ok", "0325-VIP"),
        ("Bob", "ok", "0325-VIP"),
        ("Eve", "no_platform_id", "0325-VVIP"),
        ("Fay", "no_platform_id", "0325-VIP"),
    ]
    sent = outbox.tag_requests(plan).orderBy("entity_id").collect()
    assert [(r.method, r.path, r.body_json) for r in sent] == [
        ("PATCH", "/customers/p1/tags", '{"tags":["0325-VIP"],"update_mode":"add"}'),
        ("PATCH", "/customers/p2/tags", '{"tags":["0325-VIP"],"update_mode":"add"}'),
    ]


RECON = "customer_id string, email string, legacy_points int, legacy_credits int, " \
    "platform_credits int, platform_points int"


@pytest.fixture
def recon(rows):
    return rows(
        RECON,
        ("same", "a", 5, 0, 0, 0),
        ("more", "b", 9, 0, 0, 0),
        ("none", "c", None, 0, 0, 0),
        ("lost", "d", 1, 0, 0, 0),
        ("twice", "e", 1, 0, 0, 0),
        ("twice", "f", 2, 0, 0, 0),
        (None, "g", 3, 0, 0, 0),
        (None, "h", 4, 0, 0, 0),
    )


@pytest.fixture
def balances(rows):
    return rows(
        "customer_id string, balance int", ("same", 5), ("more", 5), ("none", 4), ("twice", 0)
    )


def test_points_plan(recon, balances, collect):
    plan = reconcile.points_plan(recon, balances)
    assert collect(plan, "email", "outcome", "point_diff") == [
        ("a", "no_diff", 0),
        ("b", "change", 4),
        ("c", "change", -4),
        ("d", "no_balance", None),
        ("e", "duplicate", 1),
        ("f", "duplicate", 2),
        ("g", "no_platform_id", None),
        ("h", "no_platform_id", None),
    ]
    sent = outbox.points_requests(plan).orderBy("entity_id").collect()
    assert [(r.path, r.body_json) for r in sent] == [
        (
            f"/customers/{who}/member_points",
            f'{{"value":{diff},"remarks":"舊站點數","email_target":1,"sms_notification_target":1}}',
        )
        for who, diff in (("more", 4), ("none", -4))
    ]
    below = reconcile.points_plan(recon, balances, below_id="none")
    assert collect(below, "email") == [("b",), ("d",)]


def test_latest_balance_wins(rows, collect):
    snapshot = rows(
        "customer_id string, balance int, fetched_at timestamp",
        ("a", 1, datetime(2024, 1, 1)),
        ("a", 2, datetime(2024, 1, 2)),
        ("b", 3, datetime(2024, 1, 1)),
    )
    assert collect(reconcile.latest_balances(snapshot)) == [("a", 2), ("b", 3)]


@pytest.mark.parametrize(
    "http, balance, legacy, status",
    [
        (200, 5, 5, "success"),
        (200, 4, 5, "wrong"),
        (200, 0, None, "wrong"),
        (200, None, 5, "wrong"),
        (422, 5, 5, "fail"),
        (None, 5, 5, "fail"),
    ],
)
def test_points_verdict(rows, http, balance, legacy, status):
    answered = rows("http_status int, point_balance int, legacy_points int", (http, balance, legacy))
    assert reconcile.points_verdict(answered).first().status == status


def test_points_audit_is_false_when_anything_is_missing(rows, collect):
    recon = rows(
        "customer_id string, legacy_points int",
        ("ok", 5), ("off", 5), ("nolegacy", None), ("nobalance", 5), ("neither", None), (None, 1),
    )
    balances = rows("customer_id string, balance int", ("ok", 5), ("off", 4), ("nolegacy", 0))
    audited = reconcile.points_audit(recon, balances)
    assert collect(audited, "customer_id", "verified") == [
        ("neither", False), ("nobalance", False), ("nolegacy", False), ("off", False),
        ("ok", True), (None, False),
    ]


def test_differences_within_one_table(rows, collect):
    table = rows(
        "customer_id string, legacy_credits int, platform_credits int, legacy_points int, "
        "platform_points int",
        ("a", 10, 4, 1, 1), ("b", None, 4, 2, None),
    )
    diffs = reconcile.table_differences(table)
    assert collect(diffs, "customer_id", "credit_diff", "point_diff") == [("a", 6, 0), ("b", -4, 2)]
    assert outbox.credits_requests(diffs).count() == 0
    sent = outbox.credits_requests(diffs, enabled=True).orderBy("entity_id").collect()
    assert [(r.path, r.body_json) for r in sent] == [
        ("/customers/a/store_credits", '{"value":6,"remarks":"搬站"}'),
        ("/customers/b/store_credits", '{"value":-4,"remarks":"搬站"}'),
    ]


def test_search_resolution(rows, collect):
    wanted = rows("q string", ("none",), ("one",), ("two",), ("one",))
    hits = rows("q string, id string", ("one", "x"), ("two", "y"), ("two", "z"), ("other", "w"))
    assert collect(reconcile.resolve_hits(wanted, hits, "q", "id")) == [
        ("none", 0, "not_found", None), ("one", 1, "matched", "x"), ("two", 2, "ambiguous", None)
    ]


def test_found_balances_become_snapshot_rows(rows, collect):
    wanted = rows("q string", ("none",), ("one",), ("two",))
    hits = rows(
        "q string, customer_id string, balance int",
        ("one", "c1", 5), ("two", "c2", 6), ("two", "c3", 7),
    )
    at = F.lit(datetime(2024, 1, 1))
    assert collect(reconcile.found_balances(wanted, hits, "q", at)) == [
        ("c1", 5, datetime(2024, 1, 1))
    ]


def test_one_row_each(rows, collect):
    ids = rows("id string", ("a",), ("b",), ("c",))
    table = rows("id string", ("a",), ("b",), ("b",))
    assert collect(reconcile.one_row_each(ids, table, "id")) == [
        ("a", 1, "ok"), ("b", 2, "duplicate"), ("c", 0, "missing")
    ]


def test_tag_verdict(rows, collect):
    answered = rows("id string, tags array<string>", ("a", ["x"]), ("b", []), ("c", None))
    assert collect(reconcile.tag_verdict(answered), "id", "status") == [
        ("a", "success"), ("b", "fail"), ("c", "fail")
    ]


def test_the_last_search_counts_and_only_if_it_is_later_than_the_record(rows):
    wanted = rows("k string", *[(k,) for k in "abcdefg"])
    searches = rows(
        "k string, searched_at int, id string",
        ("a", 1, "A1"), ("a", 2, "A2"),  # the last one counts
        ("b", 1, "B1"), ("b", 2, None),  # found nothing the last time
        ("c", 1, "C1"),  # older than the record
        ("d", 3, "D1"),  # later than the record
        ("e", 2, "E1"), ("e", 2, "E2"),
        ("f", 5, "F1"),  # as old as the record
    )
    recorded = rows("k string, value string, ts int", ("c", "C0", 2), ("d", "D0", 2), ("f", "F0", 5), ("g", "G0", 1))
    got = reconcile.resolve_as_of(wanted, searches, recorded, "k", "id").collect()
    assert sorted((r.k, r.n_hits, r.outcome, r.id, r.as_of) for r in got) == [
        ("a", 1, "matched", "A2", 2),
        ("b", 0, "not_found", None, 2),
        ("c", None, "recorded", "C0", 2),
        ("d", 1, "matched", "D1", 3),
        ("e", 2, "ambiguous", None, 2),
        ("f", None, "recorded", "F0", 5),
        ("g", None, "recorded", "G0", 1),
    ]
