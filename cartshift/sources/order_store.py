"""Order lines stored once in buckets, so that planning orders shuffles no line.

Lines stand in buckets of (order, block of lines), sorted by their number; a second table has the sums over each
block's lines, apart for repeated ones, and with the first block what a plan needs of the order's header. A giant order is spread over
the buckets by its blocks, so no bucket grows with one order. Looking up orders, adding them up and folding their documents
shuffle these rows of blocks and orders only; the lines are joined and folded where they lie.

A line keeps what is its own; the columns that an export repeats on every line of an order stand in ``header``, on
the first line, which speaks for its order. Lines are shuffled in this form, and documents take the header from there.

What a plan would otherwise work out from all lines each time is stored with them: their number in the order, their
amounts, and whether their line number stood on an earlier line (``again``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift.operators.grouping import flag_later
from cartshift.operators.orders import (
    BLOCK_BITS,
    HEADER,
    ITEM_COLUMNS,
    ORDER_AMOUNTS,
    content_sums,
    line_amounts,
    line_block,
    line_sum_columns,
    order_amounts,
    with_digest,
)

KEYS = ("order_uid", "block")
# What is a line's own, and what a plan has to know of a header before documents are made.
LINE_FIELDS = {"line_order_no", "unit_price", "quantity", *ITEM_COLUMNS}
PLAN_FIELDS = {"platform_order_id", "created_at", "shipping_fee", *ORDER_AMOUNTS}


@dataclass(frozen=True)
class OrderStore:
    """Names of the two tables, and how they were cut."""

    lines: str
    blocks: str
    buckets: int
    block_bits: int = BLOCK_BITS

    def read_lines(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.lines)

    def read_blocks(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.blocks)


def store_orders(
    lines: DataFrame,
    folder: str,
    buckets: int | None = None,
    block_bits: int = BLOCK_BITS,
    parsed: bool = False,
) -> OrderStore:
    """Store cleaned, numbered lines under ``folder``, a place that all executors share.

    Reading without an exchange needs at least as many buckets as ``spark.sql.shuffle.partitions`` has at that time;
    that many are made by default. ``parsed`` says that the amounts are there already.
    """
    spark = lines.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    store = OrderStore(f"order_lines_{mark}", f"order_blocks_{mark}", buckets, block_bits)
    rows = lines
    if "again" not in rows.columns:
        rows = flag_later(rows, "order_uid", "line_order_no", order="line_seq", name="again")
    rows = rows.withColumn("block", line_block(F.col("line_seq"), block_bits))
    marks, texts = {"line_seq", "again", *KEYS}, set() if parsed else {"unit_price", "quantity"}
    header = [c for c in rows.columns if c not in marks | LINE_FIELDS]
    own = [c for c in rows.columns if c in {"again", "phase", "line_order_no", *KEYS, *ITEM_COLUMNS} | texts]
    # Headers leave the lines, and numbers are made of texts, where each takes less: before the shuffle and after it.
    rows = rows.select(*own, F.when(F.col("line_seq") == 1, F.struct(*header)).alias(HEADER)).repartition(buckets, *KEYS)
    if not parsed:
        made = order_amounts(lambda name: F.col(HEADER)[name])
        whole = F.struct(*[F.col(HEADER)[c].alias(c) for c in header if c not in made], *[v.alias(c) for c, v in made.items()])
        rows = rows.withColumns(line_amounts() | {HEADER: F.when(F.col(HEADER).isNotNull(), whole)}).drop(*texts)
    _write(rows, store.lines, f"{folder}/{store.lines}", buckets, [*KEYS, "line_seq"])
    stored = store.read_lines(spark)
    last = F.max("line_seq").alias("last_seq")
    sums = with_digest(stored).groupBy(*KEYS, "again").agg(*line_sum_columns(), *content_sums(), last)
    planned = [F.col(HEADER)[c].alias(c) for c in stored.select(f"{HEADER}.*").columns if c in PLAN_FIELDS]
    firsts = stored.where("line_seq = 1").select(*KEYS, F.struct(*planned).alias("first"))
    sums = sums.join(firsts.hint("merge"), list(KEYS), "left")  # where the lines lie
    sums = sums.withColumn(HEADER, F.when(~F.col("again"), F.col("first"))).drop("first")
    _write(sums, store.blocks, f"{folder}/{store.blocks}", buckets, [*KEYS, "again"])
    return store


def _write(rows: DataFrame, table: str, path: str, buckets: int, order: list[str]) -> None:
    """``rows`` come partitioned into ``buckets`` by the keys; the writer sorts them."""
    (
        rows.write.bucketBy(buckets, *KEYS)
        .sortBy(*order)
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(table)
    )
