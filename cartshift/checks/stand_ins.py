"""The shared test tables dressed as the stores' tables.

The test tables hold no shops, so their columns are renamed or combined into the
shapes the operators expect. Every row of a table is used. The oracles derive the
same columns in SQL.
"""

from __future__ import annotations

import uuid
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators.orders import line_sum_columns, line_sums, with_line_seq
from cartshift.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: Column) -> Column:
    return column.cast("string")


def by_case(key: Column, cases: dict[int, Column | str | None], other=None) -> Column:
    chosen = F
    for value, result in cases.items():
        chosen = chosen.when(key == value, result)
    return chosen.otherwise(other)


def _address(spread: Column, number: Column) -> Column:
    return by_case(
        spread % 7,
        {
            0: F.concat(F.lit("台北市大安區"), text(number)),
            1: F.concat(F.lit("南投縣埔里鎮"), text(number)),
            2: F.concat(F.lit("東門市場"), text(number), F.lit("號")),
            3: F.lit("南投門市"),
            4: F.concat(F.lit("市區"), text(number)),
            5: F.concat(F.lit("新竹巿東區"), text(number)),
        },
    )


# --- customers -----------------------------------------------------------------


def legacy_customers(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    k, n, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    phone = F.concat(F.lit("09"), F.lpad(text(k % 400), 8, "0"))
    return customer.select(
        by_case(n, {0: "", 1: None}, F.col("c_name")).alias("name"),
        F.concat(F.when(n < 12, "U").otherwise("u"), text(k), F.lit("@Example.com")).alias("email"),
        by_case(
            n % 6,
            {
                0: "",
                1: None,
                2: F.concat(F.left(phone, F.lit(4)), F.lit("-"), F.right(phone, F.lit(6))),
                3: F.concat(F.lit("02"), F.lpad(text(k), 7, "0")),
            },
            phone,
        ).alias("phone"),
        F.when(k % 11 == 0, "")
        .otherwise(F.concat_ws("-", text(k % 70 + 1950), text(k % 13 + 1), text(k % 28 + 1)))
        .alias("birthday"),
        by_case(n % 4, {0: "", 1: None}, F.concat(F.lit("note "), segment)).alias("note"),
        F.when(n != 3, F.floor(F.col("c_acctbal") / 1000)).cast("int").alias("points"),
        (n % 3).cast("int").alias("credits"),
        _address(n, k).alias("address"),
        F.when(segment == "MACHINERY", fixed.STANDARD_TIER)
        .when(segment != "BUILDING", segment)
        .alias("tier"),
        (k % 3 * 100).cast("decimal(18,4)").alias("total_spend"),
    )


def customers_sharing_emails(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy customers of which some have the e-mail of the one before."""
    n = F.regexp_extract("email", "[0-9]+", 0).cast("bigint")
    shared = F.concat(F.lit("U"), text(n - 1), F.lit("@Example.com"))
    return legacy_customers(spark, folder).withColumn(
        "email", F.when(n % 40 == 1, shared).otherwise(F.col("email"))
    )


def platform_customers(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought")
    )
    return users.select(
        F.concat(F.lit("P"), text(F.col("user_id"))).alias("customer_id"),
        F.concat(F.lit("u"), text(F.col("user_id") * 20), F.lit("@example.com")).alias("email"),
        (F.col("bought") % 5).cast("int").alias("credits"),
        (F.col("n") % 7).cast("int").alias("points"),
    )


def balance_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Looked-up balances over time; small values stand for lookups that failed."""
    value = F.col("value")
    return table(spark, folder, "events").select(
        F.concat(F.lit("P"), text(F.col("user_id"))).alias("customer_id"),
        F.when(value > 30, F.floor(value) % 10).cast("int").alias("balance"),
        F.col("ts").alias("fetched_at"),
        "event_id",
    )


def customer_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an answer of a platform customer."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("P"), text(F.col("user_id"))).alias("customer_id"),
        "event_id",
        F.when(kind == "error", 422).when(kind == "click", 500).otherwise(200).alias("http_status"),
        (F.floor("value") % 10).cast("int").alias("point_balance"),
        F.when(kind == "error", F.array().cast("array<string>"))
        .when(kind != "click", F.array(kind))
        .alias("tags"),
    )


# --- orders --------------------------------------------------------------------

STATES = {
    "1-URGENT": fixed.FINISHED,
    "3-MEDIUM": fixed.CANCELLED,
    "4-NOT SPECIFIED": "新訂單",
    "5-LOW": "待確認",
}


def order_amounts() -> dict[str, Column]:
    k = F.col("o_orderkey")
    return {
        "total_amount": F.floor("o_totalprice").cast("bigint"),
        "discount_amount": (k % 50).cast("bigint"),
        "shipping_amount": (k % 3 * 20 + 60).cast("bigint"),
        "shipping_fee": text(k % 3 * 20 + 60),
    }


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def amount_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Only the amounts of the order headers."""
    orders = table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("order_uid"), *named(order_amounts()))


def legacy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One header row per order, as on an order's first line."""
    return table(spark, folder, "orders").select(*named(legacy_columns()))


def legacy_columns() -> dict[str, Column]:
    k, c, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    day = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")
    shipping = F.when(F.col("o_orderstatus") == "P", "已出貨").otherwise("出貨中")
    states = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATES.items())])
    none = F.lit(None).cast("string")
    return {
        "order_uid": k,
        "platform": F.col("o_orderstatus"),
        "transaction_no": text(k),
        "platform_order_id": by_case(k % 10, {0: None, 1: ""}, F.concat(F.lit("S"), text(k))),
        "created_at": day,
        "order_status": F.coalesce(F.try_element_at(states, priority), shipping),
        "payment_info": priority,
        "paid_at": by_case(c % 3, {0: None, 1: ""}, day),
        "shipped_at": by_case(c % 4, {0: "", 1: None}, day),
        "allocated_at": none,
        "delivery_state": F.lit(""),
        "delivery_type": F.when(priority == "5-LOW", fixed.UNCHOSEN_DELIVERY).otherwise(priority),
        "shop_note": by_case(k % 5, {0: "", 1: None}, F.concat(F.lit("memo "), text(k))),
        "cancel_reason": none,
        "buyer_note": none,
        "delivery_note": none,
        "recipient_name": F.when(c % 25 == 0, "").otherwise(F.concat(F.lit("Name "), text(c))),
        "recipient_phone": by_case(c % 6, {0: None, 1: ""}, F.concat(F.lit("tel"), text(c))),
        "recipient_phone_no0": by_case(c % 5, {0: None, 1: ""}, F.concat(F.lit("9"), F.lpad(text(c), 8, "0"))),
        "recipient_city": none,
        "recipient_address": _address(k, c),
        "postcode": F.lpad(text(c % 1000), 3, "0"),
        "customer_email": by_case(
            k % 9,
            {0: None, 1: "", 2: F.concat(F.lit("x"), text(k), F.lit(fixed.CLOSED_ACCOUNT_MARK))},
            F.concat(F.lit("c"), text(c), F.lit("@example.com")),
        ),
        **order_amounts(),
    }


LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def numbered_lines(spark: SparkSession, folder: str, line_no: str | None = None) -> DataFrame:
    """Line items in file order; the table has no line key, so all columns order it."""
    return with_line_seq(_line_items(spark, folder), LINE_ORDER, line_no)


def parsed(lines: DataFrame, *more: str) -> DataFrame:
    """Line items as parsed order lines."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.select(
        "order_uid",
        *more,
        F.col("l_partkey").alias("item_code"),
        F.col("l_suppkey").alias("item_name"),
        F.floor(price + 0.5).cast("bigint").alias("unit_amount"),
        F.col("l_quantity").cast("bigint").alias("units"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("line_amount"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(numbered_lines(spark, folder), "line_seq")


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "order_uid")


def _with_subtotal(headers: DataFrame, sums: DataFrame) -> DataFrame:
    half = F.lit(0.5).cast("decimal(2,1)")
    rounded = F.floor(F.col("subtotal_amount") + half).cast("bigint")
    sums = sums.withColumn("subtotal_rounded", rounded)
    return headers.join(sums.hint("merge"), "order_uid")


def _subtotal() -> Column:
    return F.sum("line_amount").cast("decimal(28,6)").alias("subtotal_amount")


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Order headers with the subtotal their lines add up to."""
    subtotals = parsed(_line_items(spark, folder)).groupBy("order_uid").agg(_subtotal())
    return _with_subtotal(legacy_orders(spark, folder), subtotals)


def summed_orders(headers: DataFrame, folder: str) -> DataFrame:
    """Order headers with all their line sums, from one aggregate.

    Freshly numbered lines have no gaps, so the number of lines is the last line's.
    """
    lines = parsed(_line_items(headers.sparkSession, folder))
    last = F.count("*").alias("last_seq")
    sums = lines.groupBy("order_uid").agg(*line_sum_columns(), last, _subtotal())
    return _with_subtotal(headers, sums)


def orders_of(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Order headers with all sums of their numbered lines, whose place counts."""
    return _with_subtotal(headers, line_sums(lines, _subtotal()))


# --- the raw order export --------------------------------------------------------

# The test orders are this much older than the months that were exported twice.
EXPORT_YEARS_LATER = 24
# The number is there already, and amounts are texts of other names.
UNEXPORTED = ("transaction_no", "order_uid", "total_amount", "discount_amount", "shipping_amount")


def _money(column: str) -> Column:
    return text(F.col(column).cast("decimal(18,2)"))


def _order_key() -> Column:
    return F.col("transaction_no").cast("bigint")


def export_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Order headers as exported: amounts are texts, some unreadable, and some platforms are missing."""
    k = _order_key()
    number = text(F.col("o_orderkey")).alias("transaction_no")
    orders, prices = table(spark, folder, "orders"), table(spark, folder, "orders")
    # The texts are made after the join, so that it shuffles numbers only.
    priced = orders.select(number, "*").join(prices.select(number, F.col("o_totalprice").alias("price")), "transaction_no")
    year = F.left("created_at", F.lit(4)).cast("int") + EXPORT_YEARS_LATER
    exported = {name: column for name, column in legacy_columns().items() if name not in UNEXPORTED}
    return (
        priced.select("transaction_no", *named(exported), _money("price").alias("price"))
        .withColumns(
            {
                "platform": F.when(k % 43 != 0, F.col("platform")),
                "platform_order_id": by_case(k % 10, {0: F.concat(F.lit("S"), text(k)), 1: ""}),
                "created_at": F.concat(text(year), F.substr("created_at", F.lit(5))),
                "items_subtotal": by_case(k % 37, {0: "x", 1: ""}, F.col("price")),
                "order_total": F.col("price"),
                "discount_total": F.when(k % 41 == 0, "").otherwise(text(k % 50)),
            }
        )
        .drop("price")
    )


def _by_transaction(rows: DataFrame) -> DataFrame:
    """Rows that come partitioned by their transaction, stored in buckets of it: what is read several times is not
    shuffled again."""
    spark = rows.sparkSession
    name, buckets = f"export_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.bucketBy(buckets, "transaction_no").option("path", f"{shared_folder(spark)}/{name}")
    writer.option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def export_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as exported: each line repeats its order's columns."""
    unreadable = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 40)
    items = table(spark, folder, "lineitem").select(text(F.col("l_orderkey")).alias("transaction_no"), *LINE_ORDER)
    heads = _by_transaction(export_heads(spark, folder))
    # The texts of lines are made after the join, so that numbers are shuffled and stored.
    return heads.join(_by_transaction(items.repartition("transaction_no")), "transaction_no").select(
        "transaction_no",
        *LINE_ORDER,
        text(F.col("l_linenumber")).alias("line_order_no"),
        text(F.col("l_partkey")).alias("item_code"),
        text(F.col("l_suppkey")).alias("item_name"),
        F.when(unreadable, "n/a").otherwise(_money("l_extendedprice")).alias("unit_price"),
        F.concat(text(F.col("l_quantity").cast("bigint")), F.lit(" pcs")).alias("quantity"),
        *[c for c in heads.columns if c != "transaction_no"],
    )


def export_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What is recorded about each exported order: its platform id, or something else."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        F.lit("order").alias("entity"),
        F.concat("o_orderstatus", text(k)).alias("entity_id"),
        F.when(c % 3 == 0, "platform_order_id").otherwise("note").alias("field"),
        F.concat(F.lit("L"), text(c)).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


# --- answers and ledger --------------------------------------------------------


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search results per order: an order has no line, one line or several."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("order_uid"), F.col("l_partkey").alias("platform_order_id")
    )


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as outcomes written over time."""
    return table(spark, folder, "events").select(
        F.lit("customer").alias("entity"),
        text(F.col("user_id")).alias("entity_id"),
        F.col("event_type").alias("field"),
        F.lpad(text(F.col("event_id")), 12, "0").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def customer_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as outcomes of every third customer, each kind in a field of its own."""
    fields = {"purchase": "points_status", "error": "points_verified", "click": "tag_status"}
    return table(spark, folder, "events").select(
        F.lit("customer").alias("entity"),
        F.concat(F.lit("P"), text(F.col("user_id") * 3)).alias("entity_id"),
        by_case(F.col("event_type"), fields, F.col("event_type")).alias("field"),
        text(F.col("event_id")).alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def order_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as outcomes of their orders: returned ones are recorded platform ids."""
    return table(spark, folder, "lineitem").select(
        F.lit("order").alias("entity"),
        text(F.col("l_orderkey")).alias("entity_id"),
        F.when(F.col("l_returnflag") == "R", "platform_order_id").otherwise("note").alias("field"),
        F.concat(F.lit("L"), F.lpad(text(F.col("l_partkey")), 9, "0")).alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
