from datetime import date
from decimal import Decimal

import pytest

from cartshift import fixed_values as fixed
from cartshift.operators import cleaning
from cartshift.sources.schemas import LEGACY_CUSTOMERS


@pytest.fixture
def customers(spark):
    fields = [f.split()[0] for f in LEGACY_CUSTOMERS.split(", ")]

    def build(*dicts):
        values = [
            tuple(({"email": f"user{i}@example.com"} | d).get(f) for f in fields)
            for i, d in enumerate(dicts, start=1)
        ]
        return spark.createDataFrame(values, LEGACY_CUSTOMERS)

    return build


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_projection_has_the_target_layout(customers):
    projected = cleaning.project_customers(customers({}))
    assert projected.columns == [*fixed.UPLOAD_HEADINGS, "original_address"]
    assert len(projected.columns) == 34
    types = dict(projected.dtypes)
    assert types["birthday"] == "date" and types["member_points"] == "int"


@pytest.mark.parametrize("name, full_name", [(None, "使用者"), ("", "使用者"), ("Ann", "Ann")])
def test_names(customers, name, full_name):
    assert one(cleaning.project_customers(customers({"name": name})), "full_name") == (full_name,)


@pytest.mark.parametrize(
    "note, expected",
    [("", None), (None, "舊站-會員備註-,"), ("vip", "舊站-會員備註-vip,")],
)
def test_a_missing_note_still_gets_the_prefix(customers, note, expected):
    assert one(cleaning.project_customers(customers({"note": note})), "note") == (expected,)


def test_phone_points_and_birthday(customers, collect):
    df = customers(
        {"phone": "", "points": 0, "credits": 5, "birthday": ""},
        {"phone": None, "points": None, "credits": 0, "birthday": "2011-1-5"},
        {"phone": "0900000001", "points": 5, "birthday": "2011-13-45"},
    )
    projected = cleaning.project_customers(df)
    columns = ("email_address", "country_calling_code", "member_points", "store_credits", "birthday")
    assert collect(projected, *columns) == [
        ("user1@example.com", None, None, 5, None),
        ("user2@example.com", None, None, None, date(2011, 1, 5)),
        ("user3@example.com", "886", 5, None, None),
    ]
    assert collect(cleaning.birthday_rejects(df), "email") == [("user3@example.com",)]


def test_earlier_projection(customers, rows):
    from pyspark.sql import functions as F

    df = customers({"tier": "VIP", "note": "n"}).withColumn("total_spend", F.lit(0))
    projected = cleaning.project_customers_with_tier(df)
    assert one(projected, "tags", "note", "total_spend") == ("舊站-會員級別-VIP,", "n", None)
    spent = cleaning.project_customers_with_tier(df.withColumn("total_spend", F.lit(7)))
    assert one(spent, "total_spend") == (Decimal(7),)


@pytest.mark.parametrize(
    "address, kept, city",
    [
        ("南投門市", "", None),
        ("南投縣埔里市", "南投縣埔里市", "南投縣"),
        ("台北市大安區市", "台北市大安區市", "台北市"),
        ("市區1號", "市區1號", "市"),
        ("北市x", "北市x", "北市"),
        ("nowhere", "nowhere", None),
        (None, None, None),
        ("新竹巿東區", "新竹巿東區", None),
    ],
)
def test_customer_addresses(customers, address, kept, city):
    df = cleaning.project_customers(customers({"address": address}))
    cleaned = cleaning.customer_city(cleaning.blank_pickup_shops(df))
    assert one(cleaned, "original_address", "address_city") == (kept, city)


def test_late_birthdays(customers, collect):
    df = cleaning.project_customers(
        customers({"birthday": "2010-12-31"}, {"birthday": "2011-01-01"}, {"birthday": ""})
    )
    assert collect(cleaning.drop_late_birthdays(df), "email_address", "birthday") == [
        ("user1@example.com", date(2010, 12, 31)),
        ("user2@example.com", None),
        ("user3@example.com", None),
    ]


@pytest.mark.parametrize(
    "phone, mobile, noted",
    [
        ("0900-000-001", "0900000001", "舊站電話-0900-000-001。"),
        ("090000000", None, "舊站電話-090000000。"),
        ("0200000001", None, "舊站電話-0200000001。"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_phone_is_noted_before_it_is_cleaned(customers, phone, mobile, noted):
    df = cleaning.clean_customers(
        cleaning.project_customers(customers({"phone": phone, "note": ""}))
    )
    code = None if mobile is None else "886"
    assert one(df, "mobile_number", "note", "country_calling_code") == (mobile, noted, code)


def test_phone_is_appended_to_an_existing_note(customers):
    df = cleaning.note_phone(
        cleaning.project_customers(customers({"phone": "0900000001", "note": "x"}))
    )
    assert one(df, "note") == ("舊站-會員備註-x,舊站電話-0900000001。",)


def test_recipient_needs_city_and_phone_and_survives_a_shared_phone(customers, collect):
    shared = {"phone": "0900000001", "address": "台北市大安區1號", "name": "Ann"}
    df = cleaning.clean_customers(
        cleaning.project_customers(
            customers(
                shared,
                shared,
                shared | {"phone": ""},
                shared | {"address": "nowhere", "phone": "0900000002"},
            )
        )
    )
    columns = (
        "email_address",
        "mobile_number",
        "country_calling_code",
        "address_recipient_name",
        "address_recipient_phone_number",
        "address_1",
        "address_country",
    )
    block = ("Ann", "0900000001", "大安區1號", "TW")
    assert collect(df, *columns) == [
        ("user1@example.com", "0900000001", "886", *block),
        ("user2@example.com", None, None, *block),
        ("user3@example.com", None, None, None, None, None, None),
        ("user4@example.com", "0900000002", "886", None, None, None, None),
    ]
    phones = [r.mobile_number for r in df.collect() if r.mobile_number]
    assert len(phones) == len(set(phones))


def test_texts_over_the_limits_are_reported(customers, collect):
    df = cleaning.project_customers(
        customers({"name": "x" * 101}, {"name": "x" * 100, "address": "y" * 256}, {"name": None})
    )
    report = cleaning.too_long(df, cleaning.customer_length_limits(), "email_address")
    assert collect(report) == [
        ("user1@example.com", "full_name", 101), ("user2@example.com", "original_address", 256)
    ]


def test_city_report_and_fixes(customers, rows, collect):
    df = cleaning.customer_city(
        cleaning.project_customers(
            customers({"address": "台北市"}, {"address": "臺比市"}, {"address": None})
        )
    )
    known = rows("city string", ("台北市",))
    assert collect(cleaning.unknown_cities(df, "address_city", known)) == [("臺比市",)]
    fixes = rows("wrong string, right string", ("臺比市", "台北市"))
    fixed_cities = cleaning.apply_city_fixes(df, fixes, "address_city")
    assert fixed_cities.columns == df.columns
    assert collect(fixed_cities, "email_address", "address_city") == [
        ("user1@example.com", "台北市"),
        ("user2@example.com", "台北市"),
        ("user3@example.com", None),
    ]


# --- orders


@pytest.mark.parametrize(
    "address, city",
    [
        ("台北市大安區", "台北市"),
        ("南投縣埔里", "南投縣"),
        ("東門市場1號", None),
        ("新竹巿東區", "before"),
        ("x", "before"),
        (None, "before"),
    ],
)
def test_order_city(order_lines, address, city):
    lines = order_lines({"order_uid": "1", "recipient_address": address, "recipient_city": "before"})
    assert one(cleaning.order_city(lines), "recipient_city") == (city,)


def test_lookalike_mark_is_repaired_too_late_unless_asked(order_lines):
    lines = order_lines(
        {"order_uid": None, "platform": "U", "transaction_no": "1", "recipient_address": "新竹巿東區"}
    )
    columns = ("order_uid", "recipient_city", "recipient_address")
    assert one(cleaning.clean_orders(lines), *columns) == ("U1", None, "新竹市東區")
    repaired = cleaning.clean_orders(lines, normalize_first=True)
    assert one(repaired, *columns) == ("U1", "新竹市", "新竹市東區")


def test_order_uid_needs_both_parts(order_lines):
    lines = order_lines({"order_uid": "", "platform": None, "transaction_no": "1"})
    assert one(cleaning.compose_order_uid(lines), "order_uid") == (None,)


@pytest.mark.parametrize(
    "created, short, phone",
    [
        ("2022/01/01 00:00:00", "900000001", "old"),
        ("2023/01/01 00:00:00", "900000001", "0900000001"),
        ("2023/01/01 00:00:00", "", ""),
        ("2023/01/01 00:00:00", None, ""),
        ("2024/01/01 00:00:00", None, "old"),
        (None, "900000001", "old"),
    ],
)
def test_phone_restored_for_one_year(order_lines, created, short, phone):
    lines = order_lines(
        {"order_uid": "1", "created_at": created, "recipient_phone_no0": short,
         "recipient_phone": "old"}
    )
    assert one(cleaning.restore_phone(lines), "recipient_phone") == (phone,)


def test_purging_order_ids_keeps_the_lines(order_lines, collect):
    lines = order_lines(
        {"order_uid": "1", "recipient_name": "", "delivery_type": "尚未選擇"},
        {"order_uid": "1", "recipient_name": "A", "delivery_type": "尚未選擇"},
        {"order_uid": "2", "recipient_name": None, "delivery_type": "尚未選擇"},
        {"order_uid": "3", "recipient_name": "", "delivery_type": "home"},
    )
    bad = cleaning.without_recipient(lines)
    assert bad.count() == 1
    left = cleaning.purge_order_uids(cleaning.distinct_order_uids(lines), bad)
    assert collect(left) == [("2",), ("3",)]


def test_fraction_amounts(order_lines, collect):
    lines = order_lines(
        {"order_uid": "1", "unit_price": "1.5"},
        {"order_uid": "2", "items_subtotal": "3.0"},
        {"order_uid": "3"},
    )
    assert collect(cleaning.fraction_amounts(lines), "order_uid") == [("1",), ("2",)]
