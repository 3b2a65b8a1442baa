"""End-to-end flows. Each splits its input into requests, settled rows and rejects."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators import ledger as books
from cartshift.operators import grouping, outbox, reconcile, status
from cartshift.operators.catalog import flag_variants, project_products
from cartshift.operators.cleaning import (
    clean_customers,
    clean_orders,
    distinct_order_uids,
    project_customers,
    purge_order_uids,
    without_recipient,
)
from cartshift.operators.grouping import flag_later, join_side
from cartshift.operators.orders import (
    FIRST_BLOCK,
    ORDER_FACTS,
    SUMS,
    OrderSettings,
    bad_amounts,
    book_amounts,
    first_block_documents,
    first_lines,
    line_amounts,
    line_block,
    order_amounts,
    order_documents,
    order_rows,
    per_block,
    summed_orders,
    with_line_seq,
)
from cartshift.operators.paging import id_range
from cartshift.session import checkpointed
from cartshift.sources.order_store import OrderStore
from cartshift.sources.readers import FILE_ORDER, known_phase, lines_of_orders, of_phase

ORDER, CUSTOMER = "order", "customer"
PLATFORM_ORDER_ID = "platform_order_id"
POINTS_STATUS, POINTS_VERIFIED, TAG_STATUS = "points_status", "points_verified", "tag_status"


@dataclass(frozen=True)
class Plan:
    """What a flow decided. ``settled`` rows go to the ledger, ``rejects`` to a person."""

    requests: DataFrame | None
    settled: DataFrame | None
    rejects: DataFrame
    documents: DataFrame | None = None  # of orders to be created, what the requests were made of


def _rejected(rows: DataFrame, entity: str, key: str, reason: str | Column) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return rows.select(
        F.lit(entity).alias("entity"),
        F.col(key).cast("string").alias("entity_id"),
        reason.alias("reason"),
    )


def in_phase(table: DataFrame, phase: str) -> DataFrame:
    """The rows of a known phase; a table without that column is of one phase."""
    known_phase(phase)
    return of_phase(table, phase) if "phase" in table.columns else table


# --- orders --------------------------------------------------------------------


def prepare_orders(
    exported: DataFrame,
    file_order: list[str] | None = None,
    normalize_first: bool = False,
    laid_by: tuple[str, ...] = (),
) -> DataFrame:
    """Exported order lines, cleaned, numbered within their order and marked (``again``).

    ``file_order`` names the columns that give the place of a line in the export; those of
    ``readers.read_order_lines`` by default. They are not part of the result. ``laid_by`` names columns by which the
    lines of an export lie together already, so that most orders are numbered where they lie.
    """
    file_order = list(FILE_ORDER) if file_order is None else file_order
    cleaned = clean_orders(exported, normalize_first)
    return with_line_seq(cleaned, file_order, "line_order_no", laid_by).drop(*file_order)


def prepare_order_uids(lines: DataFrame, order_uids: DataFrame | None = None) -> DataFrame:
    """The ids to migrate: those of ``lines`` (or a given list), without orders that have no recipient."""
    order_uids = lines if order_uids is None else order_uids
    return purge_order_uids(distinct_order_uids(order_uids), without_recipient(lines))


def create_orders(
    lines: DataFrame,
    order_uids: DataFrame,
    ledger: DataFrame,
    settings: OrderSettings,
    phase: str,
    start: str | None = None,
    end: str | None = None,
) -> Plan:
    """Create requests for the orders of an id range that do not exist yet.

    ``lines`` are cleaned, numbered lines; of a table of all phases only the asked one counts. Orders already created, by
    their own column or by the ledger, need nothing. Wanted ids and one row per order, with its header, sums and
    first block of lines, are stored while the plan is built. Rejects and the documents of orders of one
    block come from these rows; lines are read again only if there are longer orders. A long list of wanted ids meets
    the orders when they are made: they take less than their lines, if these have to move to them.
    """
    lines, order_uids = in_phase(lines, phase), in_phase(order_uids, phase)
    wanted = id_range(order_uids.select("order_uid").distinct(), "order_uid", start, end)
    wanted = checkpointed(books.pending(wanted, ledger, ORDER, PLATFORM_ORDER_ID, "order_uid"))
    ours = id_range(lines, "order_uid", start, end)
    if "again" not in ours.columns:
        ours = flag_later(ours, "order_uid", "line_order_no", order="line_seq", name="again")
    few = wanted.count() <= grouping.BROADCAST_ROWS
    if few:
        ours = ours.join(F.broadcast(wanted), "order_uid", "left_semi")
    ours = ours.withColumns(line_amounts())
    rows = order_rows(ours, settings.block_bits)
    found = checkpointed(rows if few else rows.join(join_side(wanted), "order_uid", "left_semi"))
    firsts = found.where("header is not null").select("order_uid", "header.*", "affected", FIRST_BLOCK, *SUMS)
    firsts = firsts.withColumns(order_amounts())  # once per order
    orders = book_amounts(books.not_created(firsts), settings.balance_basis)
    good = orders.where(~bad_amounts())
    longer = line_block(F.col("last_seq"), settings.block_bits) > 0
    documents = first_block_documents(good.where(~longer), settings)
    long = good.where(longer)
    if not long.isEmpty():
        marked = ours.join(join_side(long.select("order_uid", "affected")), "order_uid")
        documents = documents.unionByName(order_documents(marked.where("not (affected and again)"), long, settings))
    no_lines = wanted.join(join_side(firsts.select("order_uid")), "order_uid", "left_anti")
    rejects = _rejected(no_lines, ORDER, "order_uid", "no_lines").unionByName(
        _rejected(orders.where(bad_amounts()), ORDER, "order_uid", "bad_amount")
    )
    return Plan(outbox.create_order_requests(documents, phase), None, rejects, documents)


def create_stored_orders(
    store: OrderStore,
    order_uids: DataFrame,
    ledger: DataFrame,
    settings: OrderSettings,
    phase: str,
    start: str | None = None,
    end: str | None = None,
) -> Plan:
    """:func:`create_orders` from stored order lines, with the same result and without a shuffle of lines.

    What is looked up and added up are the rows of blocks; one row per order of sums and amounts is stored. Lines meet
    it in their own bucket, where repeated ones leave and the rest is folded, with the header on the first of them.
    ``settings.block_bits`` is that of the store.
    """
    spark = order_uids.sparkSession
    settings = replace(settings, block_bits=store.block_bits)
    blocks, lines = in_phase(store.read_blocks(spark), phase), in_phase(store.read_lines(spark), phase)
    order_uids = in_phase(order_uids, phase)
    wanted = id_range(order_uids.select("order_uid").distinct(), "order_uid", start, end)
    wanted = checkpointed(books.pending(wanted, ledger, ORDER, PLATFORM_ORDER_ID, "order_uid"))
    found = checkpointed(_wanted_sums(id_range(blocks, "order_uid", start, end), wanted))
    firsts = found.where("header is not null").select("order_uid", "header.*", "affected", *SUMS)
    orders = book_amounts(books.not_created(firsts), settings.balance_basis)
    good = orders.where(~bad_amounts())
    longer = line_block(F.col("last_seq"), settings.block_bits) > 0

    def kept(some: DataFrame) -> DataFrame:
        per_line = per_block(some.select("order_uid", "last_seq", "affected"), settings.block_bits).drop("last_seq")
        return lines.join(per_line.hint("merge"), ["order_uid", "block"]).where("not (affected and again)")

    short, long = good.where(~longer), good.where(longer)
    documents = order_documents(kept(short), short.select("order_uid", *ORDER_FACTS), settings)
    if not long.isEmpty():  # their header is needed with every block
        heads = lines.join(_at_first_block(long.select("order_uid")).hint("merge"), ["order_uid", "block"])
        heads = heads.where("header is not null").select("order_uid", "header.*").drop(*ORDER_FACTS)
        whole = heads.join(join_side(long.select("order_uid", *ORDER_FACTS)), "order_uid")
        documents = documents.unionByName(order_documents(kept(long).drop("header"), whole, settings))
    no_lines = wanted.join(join_side(firsts.select("order_uid")), "order_uid", "left_anti")
    rejects = _rejected(no_lines, ORDER, "order_uid", "no_lines").unionByName(
        _rejected(orders.where(bad_amounts()), ORDER, "order_uid", "bad_amount")
    )
    return Plan(outbox.create_order_requests(documents, phase), None, rejects, documents)


def _at_first_block(orders: DataFrame) -> DataFrame:
    """With a ``block`` to join by; a literal would be taken out of the join, and with it the place of the rows."""
    return orders.withColumn("block", F.explode(F.array(F.lit(0).cast("bigint"))))


def _wanted_sums(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted order of its blocks. Those of one block stay in their bucket; only blocks of longer orders
    are gathered."""
    columns = ("order_uid", "header", "affected", *SUMS)
    long = blocks.where("block > 0 and order_uid is not null").select("order_uid").distinct()
    longer = not long.isEmpty()
    if longer:
        long = checkpointed(long)
    short = wanted.join(join_side(long), "order_uid", "left_anti") if longer else wanted
    ours = blocks.join(_at_first_block(short).hint("merge"), ["order_uid", "block"], "left_semi")
    found = summed_orders(ours, by=("order_uid", "block")).select(*columns)
    if longer:
        gathered = blocks.join(join_side(wanted.join(join_side(long), "order_uid", "left_semi")), "order_uid", "left_semi")
        found = found.unionByName(summed_orders(gathered).select(*columns))
    return found


def record_created(responses: DataFrame) -> DataFrame:
    """Ledger rows with the new order ids out of the create responses."""
    created = responses.where(status.failure_class(F.col("http_status")) == "success")
    return books.entries(
        created,
        ORDER,
        "entity_id",
        PLATFORM_ORDER_ID,
        F.get_json_object("answer", "$.id"),
        F.col("answered_at"),
    )


def sync_statuses(
    lines: DataFrame,
    order_uids: DataFrame,
    ledger: DataFrame,
    phase: str,
    start: str | None = None,
    end: str | None = None,
) -> Plan:
    """All three status requests of every order in an id range, decided in one pass."""
    lines, order_uids = in_phase(lines, phase), in_phase(order_uids, phase)
    wanted = id_range(order_uids.select("order_uid").distinct(), "order_uid", start, end)
    heads = lines_of_orders(id_range(first_lines(lines), "order_uid", start, end), wanted)
    heads = books.write_back(heads, ledger, ORDER, PLATFORM_ORDER_ID, "order_uid")
    changes = status.status_changes(status.decide_statuses(heads))
    refused = changes.where(F.col("outcome") != status.OK)
    no_lines = wanted.join(heads.select("order_uid"), "order_uid", "left_anti")
    rejects = _rejected(refused, ORDER, "order_uid", F.col("outcome")).unionByName(
        _rejected(no_lines, ORDER, "order_uid", "no_lines")
    )
    return Plan(outbox.status_requests(changes, phase), None, rejects)


def recover_orders(
    lines: DataFrame,
    ledger: DataFrame,
    found: DataFrame,
    searched_at: Column,
    platform: str = fixed.RECOVERY_PLATFORM,
) -> Plan:
    """Orders that were created but not recorded, from a search snapshot.

    ``found(query, platform_order_id)`` holds the hits; one hit settles the order.
    """
    lost = books.unrecorded_orders(lines, platform)
    lost = books.pending(lost, ledger, ORDER, PLATFORM_ORDER_ID, "order_uid")
    hits = found.withColumnRenamed("query", "order_uid")
    resolved = reconcile.resolve_hits(lost, hits, "order_uid", PLATFORM_ORDER_ID)
    matched = resolved.where(F.col("outcome") == "matched")
    settled = books.entries(
        matched, ORDER, "order_uid", PLATFORM_ORDER_ID, F.col(PLATFORM_ORDER_ID), searched_at
    )
    others = resolved.where(F.col("outcome") != "matched")
    rejects = _rejected(others, ORDER, "order_uid", F.col("outcome"))
    return Plan(None, settled, rejects)


# --- points --------------------------------------------------------------------


def plan_points(
    recon: DataFrame,
    ledger: DataFrame,
    snapshot: DataFrame,
    planned_at: Column,
    below_id: str | None = None,
) -> Plan:
    """Point requests for pending customers; those without a difference are settled."""
    open_rows = books.pending(recon, ledger, CUSTOMER, POINTS_STATUS, "customer_id")
    plan = reconcile.points_plan(open_rows, reconcile.latest_balances(snapshot), below_id)
    same = plan.where(F.col("outcome") == "no_diff")
    settled = books.entries(
        same, CUSTOMER, "customer_id", POINTS_STATUS, F.lit("no_diff"), planned_at
    )
    others = plan.where(~F.col("outcome").isin("no_diff", "change"))
    rejects = _rejected(others, CUSTOMER, "customer_id", F.col("outcome"))
    return Plan(outbox.points_requests(plan), settled, rejects)


def record_points(responses: DataFrame, recon: DataFrame) -> DataFrame:
    """Ledger rows ``success``, ``wrong`` or ``fail`` from the answers to point requests."""
    legacy = recon.select(F.col("customer_id").alias("entity_id"), "legacy_points")
    balance = F.get_json_object("answer", "$.point_balance").try_cast("int")
    answered = responses.withColumn("point_balance", balance).join(legacy, "entity_id", "left")
    judged = reconcile.points_verdict(answered)
    return books.entries(
        judged, CUSTOMER, "entity_id", POINTS_STATUS, F.col("status"), F.col("answered_at")
    )


def audit_points(
    recon: DataFrame, ledger: DataFrame, snapshot: DataFrame, checked_at: Column
) -> DataFrame:
    """Ledger rows telling whether the balance of each unchecked customer is right."""
    with_id = recon.where(F.col("customer_id").isNotNull())
    unchecked = books.pending(with_id, ledger, CUSTOMER, POINTS_VERIFIED, "customer_id")
    audited = reconcile.points_audit(unchecked, reconcile.latest_balances(snapshot))
    return books.entries(
        audited, CUSTOMER, "customer_id", POINTS_VERIFIED, F.col("verified"), checked_at
    )


# --- tags ----------------------------------------------------------------------


def plan_tags(recon: DataFrame, ledger: DataFrame) -> Plan:
    """Tag requests for customers of special tiers without an outcome."""
    open_rows = books.pending(recon, ledger, CUSTOMER, TAG_STATUS, "customer_id")
    plan = reconcile.tag_plan(open_rows)
    refused = plan.where(F.col("outcome") != status.OK)
    rejects = _rejected(refused, CUSTOMER, "email", F.col("outcome"))
    return Plan(outbox.tag_requests(plan), None, rejects)


def record_tags(responses: DataFrame) -> DataFrame:
    """Ledger rows ``success`` or ``fail`` from the answers to tag requests; a call that
    failed leaves none and is planned again."""
    responses = responses.where(status.failure_class(F.col("http_status")) == "success")
    tags = F.from_json(F.get_json_object("answer", "$.tags"), "array<string>")
    judged = reconcile.tag_verdict(responses.withColumn("tags", tags))
    return books.entries(
        judged, CUSTOMER, "entity_id", TAG_STATUS, F.col("status"), F.col("answered_at")
    )


# --- customers and products ----------------------------------------------------


def prepare_customers(
    legacy: DataFrame, city_fixes: DataFrame | None = None, collation: str | None = None
) -> DataFrame:
    """Legacy customers, cleaned, in the target layout."""
    return clean_customers(project_customers(legacy), city_fixes, collation)


def prepare_products(legacy: DataFrame, image_url: str) -> DataFrame:
    """Legacy products with their variants, in the target layout."""
    return project_products(flag_variants(legacy), image_url)
