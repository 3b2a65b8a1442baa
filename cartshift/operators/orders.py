"""Order lines to order documents.

Input contract: one row per line, ``line_seq`` = 1..n in file order within an order,
given once at ingest. The first line is then ``line_seq = 1`` and needs no sort, and
``line_seq`` cuts even an order of a billion lines into blocks of a known size:

* per-order facts are aggregates, repeated once per block and joined on (order, block);
* a document is folded per block, so no task ever holds more than one block of lines.
  An order is one request at any size; the body of a giant is several pieces of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import (
    canonical,
    contains,
    fraction_of,
    has_text,
    leading_int,
    leading_number,
    round_half_up,
    whole_number,
)
from cartshift.operators.grouping import attach, key_list, number_within
from cartshift.session import checkpointed

# A block is 2**13 lines: what one task may hold of one order.
BLOCK_BITS = 13
UNIT = "unit"
LINE_TOTAL = "line_total"


@dataclass(frozen=True)
class OrderSettings:
    """Store settings of the target shop and the choices that have two readings.

    ``balance_basis``: the balance line compares the subtotal with the sum of unit
    prices (``unit``, as the legacy job did) or of price times quantity.
    ``null_text``: what a missing item code or name reads as in the item's name.
    """

    delivery_option_id: str
    payment_method_id: str
    placeholder_email: str = fixed.PLACEHOLDER_EMAIL
    balance_basis: str = UNIT
    null_text: str = "null"
    block_bits: int = BLOCK_BITS


# --- lines ---------------------------------------------------------------------


def with_line_seq(
    lines: DataFrame, file_order: list[str], line_no: str | None = None, laid_by: tuple[str, ...] = ()
) -> DataFrame:
    """Number the lines of each order once, at ingest; with ``line_no`` they also learn whether that number stood on
    an earlier line of the order (``again``), which spares :func:`drop_repeated_lines` its search. ``laid_by`` names
    columns by which the lines lie together already."""
    return number_within(lines, "order_uid", order_by=file_order, name="line_seq", again=line_no, laid_by=laid_by)


def line_amounts() -> dict[str, Column]:
    """The amounts that each line has for itself."""
    return {
        "unit_amount": round_half_up(whole_number(F.col("unit_price"))),
        "units": leading_int(F.col("quantity")),
    }


ORDER_AMOUNTS = ("subtotal_amount", "subtotal_rounded", "total_amount", "discount_amount", "shipping_amount")


def order_amounts(field: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The amounts of the order, which each of its lines repeats."""
    subtotal, total = field("items_subtotal"), leading_int(field("order_total"))
    discount, shipping = leading_int(field("discount_total")), leading_int(field("shipping_fee"))
    found = (leading_number(subtotal), round_half_up(whole_number(subtotal)), total, discount, shipping)
    return dict(zip(ORDER_AMOUNTS, found, strict=True))


def parse_amounts(lines: DataFrame) -> DataFrame:
    """Numbers out of the text amounts; NULL where there is none."""
    return lines.withColumns(line_amounts() | order_amounts())


def in_duplicate_months(
    created_at: Column,
    in_year: int = fixed.DUPLICATE_YEAR,
    months: tuple[int, int] = fixed.DUPLICATE_MONTHS,
) -> Column:
    """Created in the months whose orders were exported twice (text ``y/m/d h:m:s``)."""
    day = F.split_part(created_at, F.lit(" "), F.lit(1))
    year = leading_int(F.split_part(day, F.lit("/"), F.lit(1)))
    month = leading_int(F.split_part(day, F.lit("/"), F.lit(2)))
    inside = (year == in_year) & month.between(*months)
    return F.coalesce(inside, F.lit(False))


def line_block(seq: Column, block_bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(seq - 1, block_bits)


def per_block(orders: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Per-order rows repeated for each block of the order's lines."""
    blocks = F.sequence(F.lit(0).cast("bigint"), line_block(F.col("last_seq"), block_bits))
    return orders.withColumn("block", F.explode(blocks))


def onto_lines(
    lines: DataFrame, orders: DataFrame, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Inner join of per-order rows (with ``last_seq``) and lines, block by block.

    Both sides grow with the data, so neither may be broadcast.
    """
    return lines.withColumn("block", line_block(F.col("line_seq"), block_bits)).join(
        per_block(orders, block_bits).hint("merge"), ["order_uid", "block"]
    )


# Up to so many repeated numbers of one order come to each of its lines in one row.
NUMBERS_PER_ORDER = 64


def drop_repeated_lines(
    lines: DataFrame,
    affected: DataFrame | None = None,
    line_no: str = "line_order_no",
    stored: bool = False,
) -> DataFrame:
    """Keep the first line per line number, in the ``affected`` orders.

    Those are by default the orders whose first line was created in the months that
    were exported twice; other orders pass whole. A missing line number is a value of
    its own. Lines that were marked at ingest (``again``) only need to know whether their order is affected, which
    comes to them where they are. For others the list of line numbers that really occur twice in such orders is
    made and joined to them, by the order alone unless an order has very many of them: lines that were numbered by order
    are then not moved. ``stored`` says that ``affected`` comes from stored rows.
    """
    if "again" in lines.columns:
        return drop_marked_lines(lines, affected)
    if affected is None:
        affected = first_lines(lines).where(in_duplicate_months(F.col("created_at")))
    affected = key_list(affected.select("order_uid"), stored)
    twice = (
        lines.join(affected, "order_uid", "left_semi")
        .groupBy(F.col("order_uid").alias("uid"), F.col(line_no).alias("number"))
        .agg(F.count("*").alias("n"), F.min("line_seq").alias("first_seq"))
        .where("n > 1")
    )
    twice = checkpointed(twice)
    most = twice.groupBy("uid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= NUMBERS_PER_ORDER:
        found = F.collect_list(F.struct("number", "first_seq")).alias("repeated")
        per_order = key_list(twice.groupBy(F.col("uid").alias("order_uid")).agg(found), stored=True)
        later = F.exists(
            "repeated", lambda r: r["number"].eqNullSafe(F.col(line_no)) & (F.col("line_seq") > r["first_seq"])
        )
        kept = lines.join(per_order, "order_uid", "left").where(~F.coalesce(later, F.lit(False)))
        return kept.select(*lines.columns)
    same_line = (
        (F.col("order_uid") == F.col("uid"))
        & F.col(line_no).eqNullSafe(F.col("number"))
        & (F.col("line_seq") > F.col("first_seq"))
    )
    return lines.join(key_list(twice, stored=True), same_line, "left_anti")


def drop_marked_lines(lines: DataFrame, affected: DataFrame | None) -> DataFrame:
    """:func:`drop_repeated_lines` for lines that are marked."""
    if affected is None:
        affected = first_lines(lines).where(in_duplicate_months(F.col("created_at")))
    uids = affected.select("order_uid").distinct().withColumn("affected", F.lit(True))
    gone = F.col("again") & F.coalesce("affected", F.lit(False))
    return attach(lines, uids, "order_uid").where(~gone).drop("affected")


# --- orders --------------------------------------------------------------------


def first_lines(lines: DataFrame) -> DataFrame:
    """The line that speaks for its order."""
    return lines.where(F.col("line_seq") == 1)


def line_sum_columns() -> list[Column]:
    """Sums of the rounded prices, and lines without a number."""
    price, units = F.col("unit_amount"), F.col("units")
    return [
        F.sum(price).alias("unit_sum"),
        F.sum(price * units).alias("line_sum"),
        F.count_if(price.isNull() | units.isNull()).alias("bad_lines"),
    ]


CONTENT = tuple(f"content_{i}" for i in range(4))


LINE_DIGEST = "line_digest"


def with_digest(lines: DataFrame) -> DataFrame:
    """The digest of each line, in a column so that it is worked out once."""
    return lines.withColumn(LINE_DIGEST, F.md5(canonical(*map(F.col, ITEM_COLUMNS))))


def content_sums() -> list[Column]:
    """A digest of an order's lines that is made from partial aggregates, of lines :func:`with_digest`.

    Every line has a digest of 128 bits of its place and of all that the document shows of it; the four
    quarters are summed. So the sums tell which line stands where, and neither blocks nor the order in
    which they are added count. A sum of two billion lines fits a long.
    """
    return [F.sum(_number_in(F.col(LINE_DIGEST), i)).alias(name) for i, name in enumerate(CONTENT)]


def _number_in(line: Column, i: int) -> Column:
    return F.conv(F.substr(line, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint")


# An order's header and lines in one row: its first block of lines, and whether there are lines behind it.
FIRST_BLOCK, HEADER = "first_block", "header"
SUMS = ("unit_sum", "line_sum", "bad_lines", *CONTENT, "last_seq")


def order_rows(lines: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per order, out of one aggregate on the order: ``header`` (its first line, NULL without one), the sums
    of :func:`line_sums` and the lines of its first block, without repeated lines in the ``affected`` orders.

    Lines are marked (``again``). As no other fact about the order has to meet them first, lines that were numbered in
    a window are not moved again. A row holds one block of lines at most, whatever the order's size.
    """
    fields = [c for c in lines.columns if c not in {"order_uid", "line_seq", "again", *ITEM_COLUMNS}]
    price, units = F.col("unit_amount"), F.col("units")
    rows = with_digest(lines).select(
        "order_uid",
        "again",
        "line_seq",
        F.when(F.col("line_seq") == 1, F.struct(*fields)).alias(HEADER),
        F.when(line_block(F.col("line_seq"), block_bits) == 0, F.struct(*ITEM_COLUMNS, "again")).alias("line"),
        price.alias("unit_sum"),
        (price * units).alias("line_sum"),
        F.when(price.isNull() | units.isNull(), 1).otherwise(0).alias("bad_lines"),
        *[_number_in(F.col(LINE_DIGEST), i).alias(name) for i, name in enumerate(CONTENT)],
        F.col("line_seq").alias("last_seq"),
    )

    block = F.when(F.col("affected"), F.filter(FIRST_BLOCK, lambda row: ~row["again"])).otherwise(F.col(FIRST_BLOCK))
    first = F.sort_array(F.transform(block, lambda row: row.dropFields("again"))).alias(FIRST_BLOCK)
    return summed_orders(rows, F.collect_list("line").alias(FIRST_BLOCK)).select(
        "order_uid", HEADER, "affected", first, *SUMS
    )


def summed_orders(parts: DataFrame, *more: Column, by: tuple[str, ...] = ("order_uid",)) -> DataFrame:
    """One row per order of lines or of their blocks: the ``header``, whether it is ``affected``, the sums without
    repeated lines (``again``) if it is, and ``more``. ``by`` may name more that all parts of an order share."""

    def added(name: str, value: Column) -> Column:
        return (F.max if name == "last_seq" else F.sum)(value)

    once = ~F.col("again")
    summed = parts.groupBy(*by).agg(
        F.max(HEADER).alias(HEADER),
        *more,
        *[added(name, F.col(name)).alias(f"all_{name}") for name in SUMS],
        *[added(name, F.when(once, F.col(name))).alias(f"once_{name}") for name in SUMS],
    )
    affected = in_duplicate_months(F.col(HEADER)["created_at"])
    chosen = {n: F.when(F.col("affected"), F.col(f"once_{n}")).otherwise(F.col(f"all_{n}")) for n in SUMS}
    return summed.withColumn("affected", affected).withColumns(chosen)


def line_sums(lines: DataFrame, *more: Column) -> DataFrame:
    """Per order: :func:`line_sum_columns`, :func:`content_sums`, the last line and ``more``."""
    last = F.max("line_seq").alias("last_seq")
    return with_digest(lines).groupBy("order_uid").agg(*line_sum_columns(), *content_sums(), last, *more)


def fold_orders(
    lines: DataFrame, headers: DataFrame | None = None, basis: str = UNIT
) -> DataFrame:
    """One row per order: header fields, amounts and the balance still to book."""
    headers = first_lines(lines).drop("line_seq") if headers is None else headers
    return book_amounts(headers.join(line_sums(lines).hint("merge"), "order_uid"), basis)


def book_amounts(orders: DataFrame, basis: str = UNIT) -> DataFrame:
    """Bonus, subtotal, total and balance of orders that have their line sums."""
    compared = {UNIT: "unit_sum", LINE_TOTAL: "line_sum"}[basis]
    implied = (
        F.col("subtotal_amount")
        + F.col("shipping_amount")
        - F.col("total_amount")
        - F.col("discount_amount")
    )
    return (
        orders.withColumn("bonus", F.when(implied > 0, implied).otherwise(0))
        .withColumn("bonus_whole", F.floor("bonus").cast("bigint"))
        .withColumn("deducted", F.col("discount_amount") + F.col("bonus_whole"))
        .withColumn("subtotal", F.col("total_amount") + F.col("deducted"))
        .withColumn("total", F.col("total_amount"))
        .withColumn("balance", F.col("subtotal_rounded") - F.col(compared))
    )


def bad_amounts() -> Column:
    """Orders in which a number could not be read; they cannot become a request."""
    return (
        (F.col("bad_lines") > 0)
        | F.col("total_amount").isNull()
        | F.col("discount_amount").isNull()
        | F.col("shipping_amount").isNull()
        | F.col("subtotal_rounded").isNull()
    )


def customer_email(email: Column, placeholder: str = fixed.PLACEHOLDER_EMAIL) -> Column:
    """The address, or a placeholder if missing or of a closed account."""
    usable = has_text(email) & ~contains(email, fixed.CLOSED_ACCOUNT_MARK)
    return F.when(usable, email).otherwise(placeholder)


def remark(labels: dict[str, str] = fixed.REMARK_LABELS) -> Column:
    """``label: value。`` for every column that has a value, in the labels' order."""
    parts = [
        F.when(
            has_text(F.col(name).cast("string")),
            F.concat(F.lit(f"{label}: "), F.col(name), F.lit(fixed.SENTENCE_END)),
        )
        for name, label in labels.items()
    ]
    return F.concat_ws("", *parts)


def delivery_address() -> Column:
    """Recipient; the address itself only where a city is known."""
    city = F.col("recipient_city")
    known = has_text(city)
    phone = F.col("recipient_phone")
    return F.struct(
        F.col("recipient_name"),
        F.when(has_text(phone), phone)
        .otherwise(fixed.PLACEHOLDER_PHONE)
        .alias("recipient_phone"),
        F.when(known, F.col("recipient_address")).alias("address_1"),
        F.when(known, F.col("postcode")).alias("postcode"),
        F.when(known, city).alias("city"),
        F.when(known, fixed.COUNTRY_CODE).alias("country_code"),
    )


def subtotal_fraction(subtotal: Column) -> tuple[Column, Column]:
    """Whether a text subtotal has a decimal point, and the digits after it."""
    return contains(subtotal, "."), fraction_of(subtotal)


# --- items ---------------------------------------------------------------------

ITEM_COLUMNS = ("line_seq", "item_code", "item_name", "unit_amount", "units")


def _item(kind: str, price: Column, name: Column, text: Column, units: Column, total: Column):
    return F.struct(
        F.lit(kind).alias("item_type"),
        price.cast("bigint").alias("item_price"),
        F.struct(name.alias("name"), text.cast("string").alias("price")).alias("item_data"),
        units.cast("bigint").alias("quantity"),
        total.cast("bigint").alias("total"),
    )


def product_item(line: Callable[[str], Column], null_text: str) -> Column:
    """A product line; the last one of an order bears a negative balance.

    The balance changes the line's price and total but not the price shown as text.
    ``line`` gives a field of the line: a column, or a field of an array element.
    """
    price, units = line("unit_amount"), line("units")
    over = (line("line_seq") == F.col("last_seq")) & (F.col("balance") < 0)
    share = F.when(over, F.col("balance")).otherwise(0)
    code = F.coalesce(line("item_code").cast("string"), F.lit(null_text))
    name = F.coalesce(line("item_name").cast("string"), F.lit(null_text))
    return _item(
        fixed.PRODUCT_ITEM,
        price + share,
        F.concat(code, F.lit("-"), name),
        price,
        units,
        price * units + share,
    )


def closing_items() -> Column:
    """The items after the products: balance if positive, shipping, discount, marker."""
    one, none = F.lit(1), F.lit(None)
    balance, shipping, deducted = F.col("balance"), F.col("shipping_amount"), F.col("deducted")
    booked = _item(fixed.PRODUCT_ITEM, balance, F.lit(fixed.BALANCE_NAME), balance, one, balance)
    always = F.array(
        _item(
            fixed.PRODUCT_ITEM,
            shipping,
            F.lit(fixed.SHIPPING_NAME),
            F.col("shipping_fee"),
            one,
            shipping,
        ),
        _item(fixed.DISCOUNT_ITEM, deducted, F.lit(fixed.DISCOUNT_NAME), none, none, deducted),
        _item(
            fixed.PRODUCT_ITEM,
            F.lit(0),
            F.concat(F.lit(fixed.MARKER_PREFIX), F.col("order_uid").cast("string")),
            F.lit("0"),
            one,
            F.lit(0),
        ),
    )
    return F.when(balance > 0, F.concat(F.array(booked), always)).otherwise(always)


def order_items(lines: DataFrame, orders: DataFrame, null_text: str = "null") -> DataFrame:
    """All items of all orders, one row each; ``position`` gives their order.

    The closing items come out of the order's last line, so orders are folded once.
    """
    lines = lines.select("order_uid", *ITEM_COLUMNS)
    facts = orders.select(
        "order_uid", "last_seq", "balance", "shipping_amount", "shipping_fee", "deducted"
    )
    product = F.array(product_item(F.col, null_text))
    is_last = F.col("line_seq") == F.col("last_seq")
    items = F.when(is_last, F.concat(product, closing_items())).otherwise(product)
    return (
        onto_lines(lines, facts)
        .select("order_uid", "line_seq", F.posexplode(items).alias("place", "item"))
        .select("order_uid", (F.col("line_seq") + F.col("place")).alias("position"), "item.*")
    )


def delivery_address_json() -> Column:
    """The address as JSON: a missing recipient is an explicit null, other missing fields are left out."""
    address = delivery_address()
    name = F.to_json(F.array("recipient_name"), {"ignoreNullFields": "false"})
    rest = F.to_json(address.dropFields("recipient_name"))
    return F.concat(
        F.lit('{"recipient_name":'),
        F.substr(name, F.lit(2), F.length(name) - 2),
        F.lit(","),
        F.substr(rest, F.lit(2)),
    )


# What a document holds besides its head and its tail: the closing items, and its lines by their digest.
DOCUMENT_FACTS = ("balance", "shipping_amount", "shipping_fee", "deducted", "last_seq", *CONTENT)
# What is worked out for an order; the rest of its document stands in its header.
ORDER_FACTS = ("subtotal", "total", *DOCUMENT_FACTS)


def order_documents(
    lines: DataFrame, orders: DataFrame, settings: OrderSettings
) -> DataFrame:
    """Order documents as text: ``order_uid, piece, pieces, body_text, facts``.

    The texts of an order's pieces, joined in order, are one JSON document: everything before the items
    stands in the first piece, everything after them in the last, and each piece has the items of one block of
    lines. ``facts`` are the order's own fields and sums with the digest of its lines: they differ if the documents
    do, and are the same whatever the size of a block. ``orders`` come with :func:`line_sums`. Lines that are stored by
    blocks of this size bring their ``block``, and are folded where they are. If they bring the ``header`` too, on the first
    line of orders of one block, ``orders`` need not have what stands in it.
    """
    bits = settings.block_bits
    if "block" not in lines.columns:
        lines = lines.withColumn("block", line_block(F.col("line_seq"), bits))
    line = F.struct(*ITEM_COLUMNS)
    header = [F.max(HEADER).alias(HEADER)] if HEADER in lines.columns else []
    blocks = lines.groupBy("order_uid", "block").agg(F.sort_array(F.collect_list(line)).alias("lines"), *header)
    joined = blocks.join(per_block(orders, bits).hint("merge"), ["order_uid", "block"])
    if header:
        fields = [c for c in joined.select(f"{HEADER}.*").columns if c not in joined.columns]
        joined = joined.select("*", *[F.col(HEADER)[c].alias(c) for c in fields])
    return _documents(joined, settings)


def first_block_documents(orders: DataFrame, settings: OrderSettings) -> DataFrame:
    """:func:`order_documents` of orders that have no line behind their ``first_block``: each is made from its row."""
    return _documents(orders.withColumns({"block": F.lit(0).cast("bigint"), "lines": F.col(FIRST_BLOCK)}), settings)


def _documents(joined: DataFrame, settings: OrderSettings) -> DataFrame:
    """Blocks of ``lines`` with the order's row, as pieces of documents."""
    bits = settings.block_bits
    is_first, is_last = F.col("block") == 0, F.col("block") == line_block(F.col("last_seq"), bits)
    products = F.transform("lines", lambda row: product_item(row.getField, settings.null_text))
    items = F.to_json(F.when(is_last, F.concat(products, closing_items())).otherwise(products))
    start = F.to_json(
        F.struct(
            F.lit(settings.delivery_option_id).alias("delivery_option_id"),
            F.lit(settings.payment_method_id).alias("payment_method_id"),
            customer_email(F.col("customer_email"), settings.placeholder_email).alias(
                "customer_email"
            ),
            F.col("subtotal"),
            F.col("total"),
        )
    )
    before = F.concat(F.lit('{"order":'), F.substr(start, F.lit(1), F.length(start) - 1), F.lit(',"items":['))
    remarks = F.to_json(F.struct(remark().alias("order_remarks")))
    after = F.concat(
        F.lit('],"delivery_address":'),
        delivery_address_json(),
        F.lit(","),
        F.substr(remarks, F.lit(2)),
        F.lit("}"),
    )
    return joined.select(
        "order_uid",
        (F.col("block") + 1).alias("piece"),
        (line_block(F.col("last_seq"), bits) + 1).alias("pieces"),
        F.concat(
            F.when(is_first, before).otherwise(","),
            F.substr(items, F.lit(2), F.length(items) - 2),
            F.when(is_last, after).otherwise(""),
        ).alias("body_text"),
        canonical(before, after, *map(F.col, DOCUMENT_FACTS), F.lit(settings.null_text)).alias("facts"),
    )
