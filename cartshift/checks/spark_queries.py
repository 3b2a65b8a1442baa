"""Every operator as a query over the shared test tables, whole tables each time."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.checks import stand_ins as given
from cartshift.functions import coercion
from cartshift.operators import (
    catalog,
    cleaning,
    grouping,
    ledger,
    orders,
    outbox,
    paging,
    reconcile,
    status,
)
from cartshift.plans import flows
from cartshift.session import shared_folder, tune
from cartshift.sources import order_store, readers, writers
from cartshift.sources.ledger_store import LedgerStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SETTINGS = orders.OrderSettings(delivery_option_id="delivery-1", payment_method_id="payment-1")


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), folder)

    QUERIES[build.__name__] = run
    return run


# --- order documents -----------------------------------------------------------


def _items(spark, folder, basis):
    lines = given.order_lines(spark, folder)
    heads = given.amount_headers(spark, folder)
    folded = orders.book_amounts(given.summed_orders(heads, folder), basis)
    return orders.order_items(lines, folded).select(
        "order_uid",
        "position",
        "item_type",
        "item_price",
        F.col("item_data.name").alias("item_name"),
        F.col("item_data.price").alias("price_text"),
        "quantity",
        "total",
    )


@query
def order_items_long(spark, folder):
    return _items(spark, folder, orders.UNIT)


@query
def order_items_long_line_total(spark, folder):
    return _items(spark, folder, orders.LINE_TOTAL)


@query
def order_headers(spark, folder):
    heads = given.legacy_orders(spark, folder)
    folded = orders.book_amounts(given.summed_orders(heads, folder))
    return folded.select(
        "order_uid",
        orders.customer_email(F.col("customer_email")).alias("customer_email"),
        "subtotal",
        "total",
        F.col("bonus").cast("decimal(18,2)").alias("bonus"),
        "bonus_whole",
        orders.remark().alias("order_remarks"),
    )


def _balance(spark, folder, basis):
    lines = given.order_lines(spark, folder)
    folded = orders.fold_orders(lines, given.order_headers(spark, folder), basis)
    return folded.select("order_uid", "subtotal_rounded", "unit_sum", "line_sum", "balance")


@query
def order_balance_unit(spark, folder):
    return _balance(spark, folder, orders.UNIT)


@query
def order_balance_line(spark, folder):
    return _balance(spark, folder, orders.LINE_TOTAL)


@query
def create_order_json(spark, folder):
    lines = given.order_lines(spark, folder)
    heads = cleaning.order_city(given.legacy_orders(spark, folder))
    folded = orders.book_amounts(given.orders_of(heads, lines))
    documents = orders.order_documents(lines, folded, SETTINGS)
    return outbox.whole_order_requests(documents, "first")


@query
def address_struct_flat(spark, folder):
    heads = cleaning.order_city(given.legacy_orders(spark, folder))
    return heads.select("order_uid", orders.delivery_address().alias("a")).select(
        "order_uid", "a.*"
    )


@query
def email_fallback(spark, folder):
    heads = given.legacy_orders(spark, folder)
    return heads.select(
        "order_uid", orders.customer_email(F.col("customer_email")).alias("customer_email")
    )


@query
def lines_deduped_window(spark, folder):
    dates = given.legacy_orders(spark, folder).select("order_uid", "created_at")
    affected = dates.where(orders.in_duplicate_months(F.col("created_at"), 1995, (1, 6)))
    lines = given.numbered_lines(spark, folder, "l_linenumber")
    return orders.drop_repeated_lines(lines, affected, "l_linenumber").drop("again").join(dates, "order_uid")


@query
def lines_deduped_by_list(spark, folder):
    """The same for lines that were not marked at ingest."""
    dates = given.legacy_orders(spark, folder).select("order_uid", "created_at")
    affected = dates.where(orders.in_duplicate_months(F.col("created_at"), 1995, (1, 6)))
    lines = given.numbered_lines(spark, folder)
    return orders.drop_repeated_lines(lines, affected, "l_linenumber").join(dates, "order_uid")


@query
def line_numbers(spark, folder):
    return given.numbered_lines(spark, folder)


@query
def order_lines_of_ids(spark, folder):
    """The lines of all orders, by a list that also names as many that do not exist and one without an id."""
    keys = given.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_uid"))
    unknown = keys.select((-1 - F.col("order_uid")).alias("order_uid"))
    wanted = keys.unionAll(unknown).unionAll(spark.range(1).select(F.lit(None).cast("long")))
    lines = given.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "order_uid")
    return readers.lines_of_orders(lines, wanted)


@query
def amounts_parsed(spark, folder):
    events = given.table(spark, folder, "events").select(
        "event_id",
        F.regexp_extract("props", r":\s*([^}]*)", 1).alias("quantity"),
        F.when(F.col("event_type") == "click", "")
        .when(F.col("event_type") == "error", F.col("props"))
        .otherwise(given.text(F.col("value").cast("decimal(18,2)")))
        .alias("unit_price"),
    )
    parsed = events.withColumns(
        {
            "items_subtotal": F.concat(F.col("unit_price"), F.lit("x")),
            "order_total": F.col("quantity"),
            "discount_total": F.col("unit_price"),
            "shipping_fee": F.col("quantity"),
        }
    )
    return orders.parse_amounts(parsed).select(
        "event_id",
        "unit_amount",
        "units",
        F.col("subtotal_amount").cast("decimal(18,2)").alias("subtotal_amount"),
        "subtotal_rounded",
        "discount_amount",
    )


def _price_texts(spark, folder):
    """Extended prices as text, whole amounts without a decimal point."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    whole = price.cast("bigint")
    shown = F.when(price == whole, given.text(whole)).otherwise(given.text(price))
    return given.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_uid"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        shown.alias("unit_price"),
        shown.alias("items_subtotal"),
    )


@query
def fraction_amount_first(spark, folder):
    amounts = cleaning.fraction_amounts(_price_texts(spark, folder))
    first = grouping.first_per_key(
        amounts, "order_uid", order_by=["l_linenumber", "l_partkey", "l_suppkey"]
    )
    return first.withColumn("fraction", coercion.fraction_of(F.col("items_subtotal")))


@query
def subtotal_fractions(spark, folder):
    is_fraction, fraction = orders.subtotal_fraction(F.col("items_subtotal"))
    # Subtotals as people leave them: further digits, letters, a second point, a point at the end.
    endings = {0: "99999", 1: "x", 2: ".2", 3: "."}
    ending = given.by_case(F.col("l_partkey") % 5, endings, "")
    prices = _price_texts(spark, folder).withColumn("items_subtotal", F.concat("items_subtotal", ending))
    return prices.select(
        "order_uid",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "items_subtotal",
        is_fraction.alias("is_fraction"),
        fraction.alias("fraction"),
    )


# --- order ids and cleaning ----------------------------------------------------


def _composed(spark, folder):
    return cleaning.compose_order_uid(given.legacy_orders(spark, folder))


@query
def order_uid_range(spark, folder):
    """The id range is the operator."""
    uids = _composed(spark, folder).select("order_uid", "transaction_no")
    return paging.id_range(uids, "order_uid", "F100", "F200")


@query
def order_uid_range_collated(spark, folder):
    """An id range without regard to case, from a table that is stored in slices of that order."""
    k = F.col("o_orderkey")
    key = F.concat(given.by_case(k % 3, {0: F.lower("o_orderstatus")}, F.col("o_orderstatus")), given.text(k))
    uids = given.table(spark, folder, "orders").select(F.when(k % 41 != 0, key).alias("order_uid"), "o_orderkey")
    path = f"{shared_folder(spark)}/uids-{uuid.uuid4().hex}"
    writers.write_collated(uids, path, "order_uid", "UTF8_LCASE", 16)
    return readers.read_collated_range(spark, path, "F100", "f9")


@query
def order_uids_distinct(spark, folder):
    lines = given.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("platform"),
        given.text(F.col("l_orderkey")).alias("transaction_no"),
    )
    return cleaning.distinct_order_uids(cleaning.compose_order_uid(lines))


def _bad_order_lines(spark, folder):
    lines = given.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_uid"),
        F.when(F.col("l_linestatus") == "F", "").otherwise("x").alias("recipient_name"),
        F.when(F.col("l_returnflag") == "R", fixed.UNCHOSEN_DELIVERY)
        .otherwise("home")
        .alias("delivery_type"),
    )
    return cleaning.without_recipient(lines)


@query
def orders_purged(spark, folder):
    uids = given.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_uid"))
    return cleaning.purge_order_uids(uids, _bad_order_lines(spark, folder))


@query
def lines_without_recipient_count(spark, folder):
    return _bad_order_lines(spark, folder).agg(F.count("*").alias("n"))


def _order_columns(df):
    return df.select("order_uid", "recipient_city", "recipient_address", "recipient_phone")


@query
def orders_cleaned(spark, folder):
    return _order_columns(cleaning.clean_orders(given.legacy_orders(spark, folder)))


@query
def orders_cleaned_normalized(spark, folder):
    heads = given.legacy_orders(spark, folder)
    return _order_columns(cleaning.clean_orders(heads, normalize_first=True))


@query
def phone_restored(spark, folder):
    restored = cleaning.restore_phone(given.legacy_orders(spark, folder), "1995")
    return restored.select("order_uid", "recipient_phone")


@query
def segment_tail_token(spark, folder):
    no_city = F.lit(None).cast("string")
    customers = given.table(spark, folder, "customer").withColumn("city", no_city)
    found = cleaning.customer_city(
        customers, "c_mktsegment", "city", marks=("T", "E"), barred="CHI"
    )
    return found.select("c_custkey", "city")


@query
def cities_unknown(spark, folder):
    heads = cleaning.order_city(given.legacy_orders(spark, folder))
    known = given.legacy_customers(spark, folder).select(F.left("address", F.lit(3)))
    return cleaning.unknown_cities(heads, "recipient_city", known)


@query
def cities_fixed(spark, folder):
    """Nation names as cities, corrected by the regions' names."""
    customers = given.table(spark, folder, "customer").join(
        given.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    fixes = given.table(spark, folder, "region").select(
        F.concat(F.lit("NATION_"), given.text(F.col("r_regionkey"))).alias("wrong"),
        F.col("r_name").alias("right"),
    )
    return cleaning.apply_city_fixes(customers.select("c_custkey", "n_name"), fixes, "n_name")


# --- customers -----------------------------------------------------------------


@query
def customers_projected(spark, folder):
    return cleaning.project_customers(given.legacy_customers(spark, folder)).select(
        "full_name",
        "email_address",
        "country_calling_code",
        "mobile_number",
        "birthday",
        "is_member",
        "tags",
        "note",
        "member_points",
        "store_credits",
        "original_address",
    )


@query
def customers_projected_tier(spark, folder):
    projected = cleaning.project_customers_with_tier(given.legacy_customers(spark, folder))
    return projected.select("email_address", "tags", "note", "total_spend", "member_points")


@query
def customers_cleaned(spark, folder):
    cleaned = cleaning.clean_customers(
        cleaning.project_customers(given.legacy_customers(spark, folder))
    )
    return cleaned.select(
        "email_address",
        "mobile_number",
        "country_calling_code",
        "birthday",
        "note",
        "original_address",
        "address_city",
        "address_recipient_name",
        "address_country_calling_code_of_recipient_phone_number",
        "address_recipient_phone_number",
        "address_1",
        "address_country",
    )


@query
def birthday_rejects(spark, folder):
    rejects = cleaning.birthday_rejects(given.legacy_customers(spark, folder))
    return rejects.select("email", "birthday")


@query
def customers_too_long(spark, folder):
    """Page addresses, names and whole documents against the customer table's limits."""
    documents = given.table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("address_1"), F.col("source").alias("full_name")
    )
    limits = cleaning.customer_length_limits()
    return cleaning.too_long(
        documents, {name: limits[name] for name in ("address_1", "full_name")}, "doc_id"
    )


@query
def date_cutoff_null(spark, folder):
    dates = given.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("birthday")
    )
    return cleaning.drop_late_birthdays(dates, cutoff="1996-01-01")


@query
def phone_like_cleaning(spark, folder):
    projected = cleaning.project_customers(given.legacy_customers(spark, folder))
    noted = cleaning.note_phone(projected)
    mobiles = cleaning.keep_mobiles(cleaning.strip_hyphens(noted))
    return cleaning.clear_calling_code(mobiles).select(
        "email_address", "mobile_number", "country_calling_code", "note"
    )


@query
def recipient_block(spark, folder):
    projected = cleaning.project_customers(given.legacy_customers(spark, folder))
    repaired = cleaning.repair_city_mark(projected, "original_address")
    filled = cleaning.fill_recipient(cleaning.customer_city(repaired))
    return filled.select(
        "email_address",
        "address_city",
        "address_recipient_name",
        "address_recipient_phone_number",
        "address_1",
        "address_country",
    )


@query
def dup_phone_report(spark, folder):
    customers = given.legacy_customers(spark, folder)
    return grouping.duplicate_report(customers, "phone")


@query
def dup_key_report(spark, folder):
    return grouping.duplicate_report(given.table(spark, folder, "part"), "p_name")


@query
def dup_key_keep_min(spark, folder):
    parts = given.table(spark, folder, "part").select("p_partkey", "p_name")
    return grouping.keep_on_smallest(parts, "p_name", "p_partkey")


# --- products ------------------------------------------------------------------

VARIANT_KEY = ("p_brand", "p_type", "p_size")


@query
def variant_flag(spark, folder):
    return catalog.flag_variants(given.table(spark, folder, "part"), *VARIANT_KEY)


@query
def variant_projection(spark, folder):
    """A product code is a brand, type and size; pieces of it are its variants."""
    parts = given.table(spark, folder, "part").select(
        F.concat_ws("/", "p_brand", "p_type", given.text(F.col("p_size"))).alias("code"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("style"),
        given.text(F.col("p_partkey")).alias("size"),
        F.col("p_size").alias("stock"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("price"),
    )
    projected = catalog.project_products(catalog.flag_variants(parts), "logo.png")
    return projected.select(
        "product_handle",
        "product_name_chinese",
        "product_description_chinese",
        "product_summary_chinese",
        "online_store_status",
        "images",
        "sku",
        "price",
        "quantity",
        "specification_name_a_chinese",
        "variation_name_a_chinese",
        "variation_price",
        "variation_quantity",
    )


@query
def products_first_page(spark, folder):
    products = given.table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), "p_name"
    )
    return readers.first_products(products)


# --- reconciliation ------------------------------------------------------------


def _recon(spark, folder, how="full"):
    legacy = given.legacy_customers(spark, folder)
    return reconcile.points_recon(legacy, given.platform_customers(spark, folder), how)


@query
def recon_inner(spark, folder):
    legacy = given.legacy_customers(spark, folder).withColumn("email", F.lower("email"))
    platform = given.platform_customers(spark, folder)
    return reconcile.points_recon(legacy, platform, "inner")


@query
def recon_left(spark, folder):
    return _recon(spark, folder, "left")


@query
def recon_full(spark, folder):
    return _recon(spark, folder)


@query
def recon_full_null_rejecting(spark, folder):
    legacy = given.legacy_customers(spark, folder)
    return reconcile.tag_recon(legacy, given.platform_customers(spark, folder))


def _balances(spark, folder):
    return reconcile.latest_balances(given.balance_snapshot(spark, folder), "event_id")


@query
def balances_latest(spark, folder):
    return _balances(spark, folder)


def _points_plan(spark, folder):
    return reconcile.points_plan(_recon(spark, folder), _balances(spark, folder))


@query
def points_plan(spark, folder):
    return _points_plan(spark, folder).select(
        "customer_id", "email", "legacy_points", "balance", "point_diff", "outcome"
    )


@query
def points_outbox(spark, folder):
    return outbox.points_requests(_points_plan(spark, folder))


@query
def points_below_id(spark, folder):
    """The id bound is the operator: customers up to a given id."""
    plan = reconcile.points_plan(
        _recon(spark, folder), _balances(spark, folder), below_id="P5"
    )
    return plan.select("customer_id", "point_diff", "outcome")


@query
def points_verdict(spark, folder):
    answers = given.customer_answers(spark, folder).drop("tags")
    answered = _recon(spark, folder).join(answers, "customer_id")
    return reconcile.points_verdict(answered).select(
        "customer_id", "event_id", "http_status", "point_balance", "legacy_points", "status"
    )


@query
def points_audit(spark, folder):
    audited = reconcile.points_audit(_recon(spark, folder), _balances(spark, folder))
    return audited.select("customer_id", "email", "legacy_points", "balance", "verified")


@query
def table_differences(spark, folder):
    return reconcile.table_differences(_recon(spark, folder)).select(
        "customer_id", "email", "credit_diff", "point_diff"
    )


@query
def credits_outbox(spark, folder):
    known = _recon(spark, folder).where(F.col("customer_id").isNotNull())
    return outbox.credits_requests(reconcile.table_differences(known), enabled=True)


@query
def tag_plan(spark, folder):
    recon = recon_full_null_rejecting(spark, folder)
    return reconcile.tag_plan(recon).select(
        "customer_id", "email", F.col("tags")[0].alias("tag"), "outcome"
    )


@query
def tag_outbox(spark, folder):
    return outbox.tag_requests(reconcile.tag_plan(recon_full_null_rejecting(spark, folder)))


@query
def tag_verdict(spark, folder):
    judged = reconcile.tag_verdict(given.customer_answers(spark, folder))
    return judged.select("customer_id", "event_id", "status")


@query
def search_resolution(spark, folder):
    wanted = given.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_uid"))
    hits = given.search_hits(spark, folder)
    return reconcile.resolve_hits(wanted, hits, "order_uid", "platform_order_id")


@query
def search_resolution_as_of(spark, folder):
    """Events as searches that are repeated day by day, and as ids that were recorded in between."""
    events = given.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    ident = F.concat(F.left(kind, F.lit(1)), given.text(F.col("event_id")))
    searches = events.where(kind != "signup").select(
        F.col("user_id").alias("order_uid"),
        F.date_trunc("day", "ts").alias("searched_at"),
        F.when(kind.isin("click", "purchase"), ident).alias("platform_order_id"),
    )
    entered = events.where(kind == "signup").select(
        F.lit("order").alias("entity"),
        given.text(F.col("user_id")).alias("entity_id"),
        F.lit("platform_order_id").alias("field"),
        ident.alias("value"),
        "ts",
    )
    recorded = ledger.latest(entered).select(F.col("entity_id").cast("long").alias("order_uid"), "value", "ts")
    wanted = given.table(spark, folder, "customer").select(F.col("c_custkey").alias("order_uid"))
    found = reconcile.resolve_as_of(wanted, searches, recorded, "order_uid", "platform_order_id")
    return found.withColumn("as_of", F.unix_timestamp("as_of"))


@query
def found_balances(spark, folder):
    """Orders found by exactly one line, with the line's quantity as the balance."""
    wanted = given.table(spark, folder, "orders").select(F.col("o_orderkey").alias("query"))
    hits = given.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query"),
        F.col("l_partkey").alias("customer_id"),
        F.col("l_quantity").cast("int").alias("balance"),
    )
    at = F.lit("2024-01-01").cast("date")
    return reconcile.found_balances(wanted, hits, "query", at)


@query
def rows_per_customer(spark, folder):
    customers = given.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    bought = given.table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"))
    return reconcile.one_row_each(customers, bought, "user_id")


# --- statuses ------------------------------------------------------------------


def _decided(spark, folder):
    return status.decide_statuses(given.legacy_orders(spark, folder))


@query
def order_status(spark, folder):
    return _decided(spark, folder).select("order_uid", "order_to", "order_outcome")


@query
def payment_status(spark, folder):
    return _decided(spark, folder).select("order_uid", "payment_to", "payment_outcome")


@query
def delivery_status(spark, folder):
    return _decided(spark, folder).select("order_uid", "delivery_to", "delivery_outcome")


@query
def all_status_outbox(spark, folder):
    return outbox.status_requests(status.status_changes(_decided(spark, folder)), "second")


@query
def all_status_rejects(spark, folder):
    changes = status.status_changes(_decided(spark, folder))
    return changes.where(F.col("outcome") != status.OK).select("order_uid", "seq", "outcome")


@query
def outcome_summary(spark, folder):
    events = given.table(spark, folder, "events")
    kind = F.col("event_type")
    code = F.when(kind == "error", 422).when(kind == "click", 500).otherwise(201)
    return status.outcome_summary(events.select(code.alias("http_status")))


# --- ledger --------------------------------------------------------------------


@query
def ledger_latest(spark, folder):
    newest = ledger.latest(given.event_ledger(spark, folder))
    return newest.select("entity", "entity_id", "field", "value")


@query
def ledger_compacted(spark, folder):
    """The newest outcomes out of a ledger that is appended to, compacted, and appended to again."""
    written = given.event_ledger(spark, folder)
    store = LedgerStore(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    month = F.month("ts") % 3
    for part in (month == 0, month == 1):
        store.append(written.where(part))
    store.compact()
    store.append(written.where(F.coalesce(month == 2, F.lit(True))))
    return ledger.latest(store.read()).select("entity", "entity_id", "field", "value")


@query
def ledger_entries(spark, folder):
    orders_ = given.legacy_orders(spark, folder)
    created = F.to_timestamp("created_at", "yyyy/MM/dd HH:mm:ss")
    return ledger.entries(
        orders_, "order", "order_uid", "platform_order_id", F.col("platform_order_id"), created
    ).select("entity", "entity_id", "field", "value")


def _text_keyed_orders(spark, folder):
    heads = given.legacy_orders(spark, folder).select("order_uid", "platform", "platform_order_id")
    return heads.withColumn("order_uid", given.text(F.col("order_uid")))


@query
def pending_after_ledger(spark, folder):
    recorded = given.order_ledger(spark, folder)
    return ledger.pending(
        _text_keyed_orders(spark, folder), recorded, "order", "platform_order_id", "order_uid"
    )


@query
def orders_not_created(spark, folder):
    return ledger.not_created(_text_keyed_orders(spark, folder))


@query
def platform_ids_written_back(spark, folder):
    recorded = given.order_ledger(spark, folder)
    return ledger.write_back(
        _text_keyed_orders(spark, folder), recorded, "order", "platform_order_id", "order_uid"
    )


@query
def orders_unrecorded(spark, folder):
    return ledger.unrecorded_orders(_text_keyed_orders(spark, folder), "P")


# --- exports and phases --------------------------------------------------------


@query
def page_numbers(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_name")
    return paging.with_pages(customers, ["c_name", "c_custkey"], 100)


@query
def page_slice(spark, folder):
    customers = given.table(spark, folder, "customer")
    return paging.slice_of(customers, ["c_name", "c_custkey"], 100, 200)


@query
def export_headings(spark, folder):
    projected = cleaning.project_customers(given.legacy_customers(spark, folder))
    headed = paging.with_headings(projected)
    return headed.select([f"`{c}`" for c in headed.columns])


@query
def phase_union(spark, folder):
    return _phases(spark, folder).groupBy("phase").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_order")
    )


def _phases(spark, folder):
    table = given.table(spark, folder, "orders").drop("o_totalprice")
    marks = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return readers.union_phases(
        {
            phase: table.where(F.col("o_orderpriority") == mark)
            for phase, mark in zip(fixed.PHASES, marks)
        }
    )


@query
def phase_union_pruned(spark, folder):
    return readers.of_phase(_phases(spark, folder), "third").select(
        "o_orderkey", "o_orderpriority", "phase"
    )


@query
def phase_reloaded(spark, folder):
    """One phase of a stored table, after a first load of other rows that the second one replaces."""
    path = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    table = _phases(spark, folder).drop("phase")
    for phase, mark in (("third", "1-URGENT"), ("second", "2-HIGH"), ("third", "3-MEDIUM")):
        writers.load_phase(table.where(F.col("o_orderpriority") == mark), path, phase, sort_by="o_orderkey")
    stored = readers.read_table(spark, path)
    return readers.of_phase(stored, "third").select("o_orderkey", "o_orderpriority", "phase")


@query
def jdbc_text_ranges(spark, folder):
    """The conditions by which a database is read in ranges of a text key, as filters: how many each row meets.

    The bounds come from the keys of an earlier, smaller load; there are rows without a key and outside of these.
    """
    customers = given.legacy_customers(spark, folder).withColumn("email", F.nullif("email", F.lit("")))
    earlier = given.table(spark, folder, "supplier").select(F.concat(F.lit("U"), "s_suppkey", F.lit("@Example.com")).alias("email"))
    keyed = customers.select(F.when(F.col("points").isNotNull(), F.col("email")).alias("email"), "name")
    bounds = readers.text_bounds(earlier, "email", 7, "UNICODE_CI")
    hits = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in readers.text_predicates("email", bounds, "UNICODE_CI")],
    )
    return keyed.select("email", "name", hits.alias("ranges"))


@query
def products_csv_read_back(spark, folder):
    """Parts as a product export with quotes, line breaks and bad numbers, and what reading it gives."""
    key, size = F.col("p_partkey"), F.col("p_size")
    ring = F.concat(F.lit('"'), "p_name", F.lit('",\n'), "p_brand")
    export = given.table(spark, folder, "part").select(
        F.concat(F.lit("P"), key).alias("商品編號"),
        given.by_case(key % 3, {0: ring, 1: F.concat("p_name", F.lit(",x"))}, F.col("p_name")).alias("商品名稱"),
        F.col("p_type").alias("樣式"),
        given.text(size).alias("尺寸"),
        given.by_case(size % 9, {0: "n/a", 1: F.concat(given.text(size), F.lit(".5"))}, given.text(size)).alias(
            fixed.PRODUCT_CSV_STOCK_HEADING
        ),
        given.by_case(key % 11, {0: "-"}, given.text(F.floor("p_retailprice"))).alias("售價"),
    )
    path = f"{shared_folder(spark)}/products-{uuid.uuid4().hex}"
    export.write.options(header=True, escape='"').csv(path)
    products, rejects = readers.read_products_csv(spark, path, multi_line=True)
    good = products.withColumn("reason", F.lit(None).cast("string"))
    texts = good.withColumns({c: given.text(F.col(c)) for c in ("stock", "price")})
    return texts.unionByName(rejects.drop(*readers.REJECT_PLACE))


@query
def purge_plan(spark, folder):
    """The id bound is the operator: customers above a given id."""
    customers = given.platform_customers(spark, folder)
    return outbox.purge_requests(customers, "P2", enabled=True)


@query
def customers_above(spark, folder):
    """The id bound is the operator: customers above a given id."""
    return readers.customers_above(given.platform_customers(spark, folder), "P2")


@query
def cancel_plan(spark, folder):
    created = given.legacy_orders(spark, folder).where(
        coercion.has_text(F.col("platform_order_id"))
    )
    return outbox.cancel_requests(created, enabled=True)


@query
def export_first_rows(spark, folder):
    """The rows of the one-file export; the limit is the operator."""
    return writers.first_rows(cleaning.project_customers(given.legacy_customers(spark, folder)))


@query
def export_page_rows(spark, folder):
    """The rows of the export by pages."""
    customers = cleaning.project_customers(given.legacy_customers(spark, folder))
    return writers.page_rows(customers, rows_per_page=100)


# --- whole flows ---------------------------------------------------------------


def _exported(spark, folder, laid_by=()):
    """Lines and ids of the raw export, ready for the flows."""
    lines = flows.prepare_orders(given.export_lines(spark, folder), given.LINE_ORDER, laid_by=laid_by)
    heads = cleaning.compose_order_uid(given.export_heads(spark, folder))
    return lines, flows.prepare_order_uids(lines, heads)


# The export's lines come by these columns, which make the order's id.
LAID_BY = ("platform", "transaction_no")


def _create_plan(spark, folder):
    lines, uids = _exported(spark, folder, LAID_BY)
    recorded = given.export_ledger(spark, folder)
    return flows.create_orders(lines, uids, recorded, SETTINGS, phase="first")


@query
def flow_create_orders(spark, folder):
    return outbox.whole_order_requests(_create_plan(spark, folder).documents, "first")


def _stored_plan(spark, folder):
    lines, uids = _exported(spark, folder, LAID_BY)
    store = order_store.store_orders(lines, shared_folder(spark))
    return flows.create_stored_orders(store, uids, given.export_ledger(spark, folder), SETTINGS, phase="first")


@query
def flow_create_stored_orders(spark, folder):
    """The same requests from order lines that are stored in buckets."""
    return outbox.whole_order_requests(_stored_plan(spark, folder).documents, "first")


@query
def flow_create_stored_rejects(spark, folder):
    return _stored_plan(spark, folder).rejects


@query
def flow_create_rejects(spark, folder):
    """A short list, kept as rows: the query that returns it reads no file."""
    return _create_plan(spark, folder).rejects.checkpoint()


def _status_plan(spark, folder):
    lines, uids = _exported(spark, folder)
    return flows.sync_statuses(lines, uids, given.export_ledger(spark, folder), phase="second")


@query
def flow_sync_statuses(spark, folder):
    return _status_plan(spark, folder).requests


@query
def flow_sync_rejects(spark, folder):
    return _status_plan(spark, folder).rejects


def _plan_rows(plan):
    """A plan's parts as one table: ``part, entity_id, detail``."""
    parts = {"request": (plan.requests, "body_json"), "settled": (plan.settled, "value"),
             "reject": (plan.rejects, "reason")}
    chosen = [
        rows.select(F.lit(part).alias("part"), "entity_id", F.col(detail).alias("detail"))
        for part, (rows, detail) in parts.items()
        if rows is not None
    ]
    return reduce(DataFrame.unionByName, chosen)


def _searched_at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query
def flow_recover_orders(spark, folder):
    found = given.search_hits(spark, folder).select(
        given.text(F.col("order_uid")).alias("query"), "platform_order_id"
    )
    recorded = given.order_ledger(spark, folder)
    lines = _text_keyed_orders(spark, folder)
    return _plan_rows(flows.recover_orders(lines, recorded, found, _searched_at(), "P"))


def _shared_recon(spark, folder):
    legacy = given.customers_sharing_emails(spark, folder)
    return reconcile.points_recon(legacy, given.platform_customers(spark, folder))


@query
def flow_plan_points(spark, folder):
    recorded = given.customer_ledger(spark, folder)
    snapshot = given.balance_snapshot(spark, folder)
    return _plan_rows(
        flows.plan_points(_shared_recon(spark, folder), recorded, snapshot, _searched_at())
    )


@query
def flow_audit_points(spark, folder):
    recorded = given.customer_ledger(spark, folder)
    snapshot = given.balance_snapshot(spark, folder)
    audited = flows.audit_points(_shared_recon(spark, folder), recorded, snapshot, _searched_at())
    return audited.select("entity", "entity_id", "field", "value")


@query
def flow_plan_tags(spark, folder):
    recon = reconcile.tag_recon(
        given.customers_sharing_emails(spark, folder), given.platform_customers(spark, folder)
    )
    return _plan_rows(flows.plan_tags(recon, given.customer_ledger(spark, folder)))
