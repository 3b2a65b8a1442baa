"""Customer and order cleaning. Each rule rewrites columns; the order matters."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import (
    contains,
    ending_at,
    has_text,
    join_skipping_nulls,
    lenient_date,
    zero_to_null,
)
from cartshift.operators.grouping import attach, keep_on_smallest


def nothing(data_type: str) -> Column:
    return F.lit(None).cast(data_type)


def fill_target(df: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    """The target table's columns in order; those ``df`` lacks are NULL."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(types.get(c, "string")).alias(c)
            for c in columns
        ]
    )


# --- customers -----------------------------------------------------------------


def _common_projection(customers: DataFrame) -> dict[str, Column]:
    return {
        "full_name": F.coalesce(
            F.nullif(F.col("name"), F.lit("")), F.lit(fixed.DEFAULT_CUSTOMER_NAME)
        ),
        "email_address": F.col("email"),
        "country_calling_code": F.when(F.col("phone") != "", fixed.CALLING_CODE),
        "mobile_number": F.col("phone"),
        "birthday": lenient_date(F.col("birthday")),
        "is_member": F.lit(fixed.MEMBER_FLAG),
        "member_points": zero_to_null(F.col("points")),
        "store_credits": zero_to_null(F.col("credits")),
        "original_address": F.col("address"),
    }


def project_customers(customers: DataFrame) -> DataFrame:
    """Legacy customers in the target layout, note prefixed, no tier tag.

    A missing note still gets the prefix: only an empty one is dropped.
    """
    note = join_skipping_nulls(
        F.lit(fixed.CUSTOMER_NOTE_PREFIX), F.col("note"), F.lit(fixed.CUSTOMER_LIST_END)
    )
    columns = _common_projection(customers) | {
        "tags": nothing("string"),
        "note": F.when(F.col("note") == "", nothing("string")).otherwise(note),
        "total_spend": nothing("decimal(18,4)"),
    }
    return _target_customers(customers, columns)


def project_customers_with_tier(customers: DataFrame) -> DataFrame:
    """The earlier layout: tier as a tag, note unchanged, spend kept unless zero."""
    columns = _common_projection(customers) | {
        "tags": join_skipping_nulls(
            F.lit(fixed.CUSTOMER_TIER_TAG_PREFIX), F.col("tier"), F.lit(fixed.CUSTOMER_LIST_END)
        ),
        "note": F.col("note"),
        "total_spend": zero_to_null(F.col("total_spend")),
    }
    return _target_customers(customers, columns)


def _target_customers(customers: DataFrame, columns: dict[str, Column]) -> DataFrame:
    projected = customers.select(*[c.alias(n) for n, c in columns.items()])
    layout = [*fixed.UPLOAD_HEADINGS, fixed.ORIGINAL_ADDRESS]
    return fill_target(projected, layout, fixed.TARGET_CUSTOMER_TYPES)


def birthday_rejects(customers: DataFrame) -> DataFrame:
    """Customers whose birthday text is neither empty nor a date."""
    return customers.where(has_text(F.col("birthday")) & lenient_date(F.col("birthday")).isNull())


def blank_pickup_shops(df: DataFrame, address: str = "original_address") -> DataFrame:
    text = F.col(address)
    return df.withColumn(
        address, F.when(contains(text, fixed.PICKUP_SHOP_MARK), "").otherwise(text)
    )


def city_in(text: Column, first: str, second: str, length: int, barred: str | None) -> Column:
    """City part of an address: what ends at the first mark, else at the second.

    With ``barred`` set, a part found by the second mark is NULL if it contains that.
    """
    by_second = ending_at(text, second, length)
    if barred is not None:
        by_second = F.when(~contains(by_second, barred), by_second)
    return F.when(contains(text, first), ending_at(text, first, length)).when(
        contains(text, second), by_second
    )


def customer_city(
    df: DataFrame,
    address: str = "original_address",
    city: str = "address_city",
    marks: tuple[str, str] = (fixed.COUNTY_MARK, fixed.CITY_MARK),
    barred: str | None = None,
    length: int = fixed.CITY_NAME_LENGTH,
) -> DataFrame:
    """Set the city where the address has a mark; leave other rows as they are."""
    text = F.col(address)
    found = city_in(text, *marks, length, barred)
    marked = contains(text, marks[0]) | contains(text, marks[1])
    return df.withColumn(city, F.when(marked, found).otherwise(F.col(city)))


def drop_late_birthdays(
    df: DataFrame, birthday: str = "birthday", cutoff: str = fixed.BIRTHDAY_CUTOFF
) -> DataFrame:
    late = F.col(birthday) >= F.lit(cutoff).cast("date")
    return df.withColumn(birthday, F.when(late, None).otherwise(F.col(birthday)))


def note_phone(df: DataFrame, note: str = "note", phone: str = "mobile_number") -> DataFrame:
    """Append the phone as it is now to the note."""
    sentence = F.concat(F.lit(fixed.PHONE_NOTE_PREFIX), F.col(phone), F.lit(fixed.SENTENCE_END))
    return df.withColumn(
        note,
        F.when(has_text(F.col(phone)), join_skipping_nulls(F.col(note), sentence)).otherwise(
            F.col(note)
        ),
    )


def strip_hyphens(df: DataFrame, phone: str = "mobile_number") -> DataFrame:
    return df.withColumn(phone, F.replace(F.col(phone), F.lit("-"), F.lit("")))


def keep_mobiles(
    df: DataFrame,
    phone: str = "mobile_number",
    length: int = fixed.MOBILE_LENGTH,
    prefix: str = fixed.MOBILE_PREFIX,
) -> DataFrame:
    """NULL for everything that is not a mobile number."""
    text = F.col(phone)
    return df.withColumn(
        phone, F.when((F.length(text) == length) & text.startswith(prefix), text)
    )


def clear_calling_code(
    df: DataFrame, code: str = "country_calling_code", phone: str = "mobile_number"
) -> DataFrame:
    return df.withColumn(code, F.when(F.col(phone).isNotNull(), F.col(code)))


def fill_recipient(df: DataFrame) -> DataFrame:
    """Recipient block where both city and phone are known."""
    known = F.col("address_city").isNotNull() & F.col("mobile_number").isNotNull()
    block = {
        "address_recipient_name": F.col("full_name"),
        "address_country_calling_code_of_recipient_phone_number": F.lit(fixed.CALLING_CODE),
        "address_recipient_phone_number": F.col("mobile_number"),
        "address_1": F.replace(F.col("original_address"), F.col("address_city"), F.lit("")),
        "address_country": F.lit(fixed.COUNTRY_CODE),
    }
    return df.withColumns(
        {name: F.when(known, value).otherwise(F.col(name)) for name, value in block.items()}
    )


def unique_phones(df: DataFrame, collation: str | None = None) -> DataFrame:
    """A phone stays only with the smallest e-mail address that has it."""
    return keep_on_smallest(df, "mobile_number", "email_address", collation)


# The phone is noted before it is cleaned, and the recipient block is filled before
# shared phones are taken away; both are part of the contract.
CUSTOMER_RULES = (
    blank_pickup_shops,
    customer_city,
    drop_late_birthdays,
    note_phone,
    strip_hyphens,
    keep_mobiles,
    clear_calling_code,
    fill_recipient,
    unique_phones,
    clear_calling_code,
)


def clean_customers(
    projected: DataFrame, city_fixes: DataFrame | None = None, collation: str | None = None
) -> DataFrame:
    """All customer rules in order; ``city_fixes`` are applied once the city is set.

    ``collation`` orders the e-mail addresses that share a phone.
    """
    by_email = partial(unique_phones, collation=collation)
    rules = [by_email if rule is unique_phones else rule for rule in CUSTOMER_RULES]
    first, then = rules[:2], rules[2:]
    df = reduce(lambda d, rule: rule(d), first, projected)
    if city_fixes is not None:
        df = apply_city_fixes(df, city_fixes, "address_city")
    return reduce(lambda d, rule: rule(d), then, df)


def too_long(df: DataFrame, limits: dict[str, int], *keys: str) -> DataFrame:
    """One row per text over its column's limit: the keys, the column and the length."""
    over = [
        F.when(
            F.length(name) > limit,
            F.struct(F.lit(name).alias("column"), F.length(name).alias("length")),
        )
        for name, limit in limits.items()
    ]
    return df.select(*keys, F.inline(F.array_compact(F.array(*over))))


def customer_length_limits() -> dict[str, int]:
    return {
        name: fixed.TARGET_CUSTOMER_LENGTHS.get(name, fixed.TARGET_CUSTOMER_LENGTH)
        for name in [*fixed.UPLOAD_HEADINGS, fixed.ORIGINAL_ADDRESS]
        if name not in fixed.TARGET_CUSTOMER_TYPES
        and name not in fixed.TARGET_CUSTOMER_LONG_TEXTS
    }


# --- cities --------------------------------------------------------------------


def unknown_cities(df: DataFrame, city: str, known: DataFrame) -> DataFrame:
    """Distinct cities missing from the one-column ``known`` list: the manual check."""
    found = df.select(city).distinct().where(F.col(city).isNotNull())
    return found.join(known.select(F.col(known.columns[0]).alias(city)), city, "left_anti")


def apply_city_fixes(df: DataFrame, fixes: DataFrame, city: str) -> DataFrame:
    """Replace cities by ``fixes(wrong, right)``, one row per wrong city."""
    fixes = fixes.select(F.col("wrong").alias(city), F.struct("right").alias("fix"))
    corrected = F.when(F.col("fix").isNotNull(), F.col("fix.right")).otherwise(F.col(city))
    return attach(df, fixes, city).withColumn(city, corrected).select(*df.columns)


# --- orders --------------------------------------------------------------------


def order_city(lines: DataFrame) -> DataFrame:
    return customer_city(
        lines, "recipient_address", "recipient_city", barred=fixed.PICKUP_SHOP_MARK
    )


def repair_city_mark(lines: DataFrame, address: str = "recipient_address") -> DataFrame:
    return lines.withColumn(
        address,
        F.replace(
            F.col(address), F.lit(fixed.CITY_MARK_LOOKALIKE), F.lit(fixed.CITY_MARK)
        ),
    )


def restore_phone(lines: DataFrame, year: str = fixed.PHONE_RESTORE_YEAR) -> DataFrame:
    """Orders of one year lost the leading zero of the recipient's phone."""
    short = F.col("recipient_phone_no0")
    restored = F.when(has_text(short), F.concat(F.lit("0"), short)).otherwise("")
    that_year = F.col("created_at").startswith(year)
    return lines.withColumn(
        "recipient_phone", F.when(that_year, restored).otherwise(F.col("recipient_phone"))
    )


def compose_order_uid(lines: DataFrame) -> DataFrame:
    """Platform followed by number: the number alone is not unique."""
    return lines.withColumn("order_uid", F.concat(F.col("platform"), F.col("transaction_no")))


def clean_orders(lines: DataFrame, normalize_first: bool = False) -> DataFrame:
    """Order rules in order.

    The look-alike city mark is repaired after the city was taken, so such rows get
    none; ``normalize_first`` repairs it before.
    """
    cities = [order_city, repair_city_mark]
    if normalize_first:
        cities.reverse()
    rules = [*cities, compose_order_uid, restore_phone]
    return reduce(lambda d, rule: rule(d), rules, lines)


def fraction_amounts(lines: DataFrame) -> DataFrame:
    """Lines whose unit price or subtotal has a decimal point."""
    return lines.where(
        contains(F.col("unit_price"), ".") | contains(F.col("items_subtotal"), ".")
    )


def without_recipient(lines: DataFrame) -> DataFrame:
    """Lines with an empty recipient and no delivery type chosen."""
    return lines.where(
        (F.col("recipient_name") == "") & (F.col("delivery_type") == fixed.UNCHOSEN_DELIVERY)
    )


def distinct_order_uids(lines: DataFrame) -> DataFrame:
    return lines.select("order_uid").distinct()


def purge_order_uids(order_uids: DataFrame, bad_lines: DataFrame) -> DataFrame:
    """Order ids without those that own a bad line; the lines themselves stay."""
    return order_uids.join(distinct_order_uids(bad_lines), "order_uid", "left_anti")
