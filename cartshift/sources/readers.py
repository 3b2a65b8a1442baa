"""Reading staging tables, phases, CSV files and platform snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import has_text
from cartshift.operators.grouping import key_list, sample_bounds, slice_number
from cartshift.operators.ledger import LEDGER_SCHEMA
from cartshift.operators.paging import id_range
from cartshift.sources.schemas import text_schema


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower,
    upper,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A live staging table, read by ``partitions`` range queries on ``column``."""
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def text_bounds(
    keys: DataFrame, column: str, slices: int, collation: str | None = None
) -> list[str]:
    """Up to ``slices - 1`` keys that cut the texts of ``column`` into like shares, in the order of ``collation``.

    They come from a bounded sample, of an earlier load for instance; texts are missing and repeated as they
    like. Texts with a backslash are no bounds, as databases read these differently.
    """
    present = keys.select(column).where(has_text(F.col(column)) & ~F.contains(F.col(column), F.lit("\\")))
    return [bounds[0] for bounds in sample_bounds(present, [column], slices, collation)]


def text_predicates(column: str, bounds: list[str], collation: str | None = None) -> list[str]:
    """Conditions that share out all rows of a table by a text key: every row meets exactly one.

    The first also takes rows without a key, the first and the last what lies outside the bounds.
    ``collation`` is the database's name for the order of the bounds; it is written out, so that the database
    compares as the bounds were sorted, whatever its own default is.
    """
    key = f"{column} COLLATE {collation}" if collation else column
    quoted = ["'" + b.replace("'", "''") + "'" for b in bounds]
    if not quoted:
        return ["1 = 1"]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"{key} < {quoted[0]} OR {column} IS NULL", *between, f"{key} >= {quoted[-1]}"]


def read_jdbc_by_text(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    bounds: list[str],
    collation: str | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A live staging table, read by one query per range of a text key."""
    predicates = text_predicates(column, bounds, collation)
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})


# The slice of a stored row, and where a table keeps the bounds of its slices.
SLICE, BOUNDS = "key_slice", "_bounds"


def read_collated_range(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of a table by ``writers.write_collated`` with ``start <= key < end`` in its collation.

    Statistics know nothing of collations, so a collated comparison alone reads everything. The bounds tell the
    slices that a range can lie in; that is a filter on a number, which is pushed down.
    """
    kept = spark.read.parquet(f"{path}/{BOUNDS}").first()
    key, collation, bounds = kept["key"], kept["collation"], kept["bounds"]
    rows = spark.read.parquet(f"{path}/rows")
    for text, compare in ((start, "__ge__"), (end, "__le__")):
        if text is not None:
            one = spark.createDataFrame([(text,)], f"`{key}` string")
            slice_no = one.select(slice_number(one, key, bounds, collation)).first()[0]
            rows = rows.where(getattr(F.col(SLICE), compare)(F.lit(slice_no)))
    return id_range(rows, key, start, end, collation).drop(SLICE)


def known_phase(phase: str) -> str:
    if phase not in fixed.PHASES:
        raise ValueError(f"unknown phase {phase!r}, expected one of {fixed.PHASES}")
    return phase


def union_phases(tables: dict[str, DataFrame]) -> DataFrame:
    """All batches as one table with a ``phase`` column."""
    marked = [t.withColumn("phase", F.lit(known_phase(p))) for p, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def of_phase(table: DataFrame, phase: str) -> DataFrame:
    """One batch; on a table partitioned by phase only its files are read."""
    return table.where(F.col("phase") == known_phase(phase))


def lines_of_orders(
    lines: DataFrame, order_uids: DataFrame, stored: bool = False
) -> DataFrame:
    """Lines of the given orders: one join instead of one query per order."""
    wanted = order_uids.select("order_uid").distinct()
    return lines.join(key_list(wanted, stored), "order_uid", "left_semi")


# The place of a line in an export: the file, the part of it that one task reads, the row there.
FILE_ORDER = ("file_path", "file_part", "file_row")


def read_order_lines(
    spark: SparkSession, path: str, platform_order_id: str, multi_line: bool = False
) -> DataFrame:
    """Order lines of CSV exports as text, with the columns of :data:`FILE_ORDER`.

    ``platform_order_id`` is the heading of the new platform's order id. Headings that an
    export lacks are NULL, and so are cells with nothing in them; ``""`` is an empty text.
    Within a file the rows are in file order whatever the number of tasks.
    """
    # A mark that no cell holds: with Spark's own, the empty text, empty texts are NULL as well.
    options = {"header": True, "escape": '"', "multiLine": multi_line, "nullValue": "\0"}
    names = spark.read.options(**options).csv(path).columns
    raw = spark.read.options(**options).schema(text_schema(names)).csv(path)
    wanted = fixed.ORDER_LINE_COLUMNS | {platform_order_id: "platform_order_id"}
    return raw.select(
        *[
            (F.col(f"`{old}`") if old in names else F.lit(None).cast("string")).alias(new)
            for old, new in wanted.items()
        ],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_part"),
        F.monotonically_increasing_id().alias("file_row"),
    )


# The columns of a reject that tell where it stands; ``record`` is the text of a row with too few or too many cells.
REJECT_PLACE = (*FILE_ORDER, "record")


def read_products_csv(
    spark: SparkSession, path: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Products and rejects of a product file.

    Stock and price must be whole numbers; any other text there, also none, is a reject, and so is a row with too
    few or too many cells. Rejects have a reason and the columns of :data:`REJECT_PLACE`. ``multi_line`` allows
    line breaks inside quotes, but then a file is read by one task.
    """
    headings = {
        (fixed.PRODUCT_CSV_STOCK_HEADING if new == "stock" else old): new
        for old, new in fixed.PRODUCT_COLUMNS.items()
    }
    options = {"header": True, "escape": '"', "multiLine": multi_line, "columnNameOfCorruptRecord": "_record"}
    names = spark.read.options(**options).csv(path).columns
    raw = spark.read.options(**options).schema(text_schema([*names, "_record"])).csv(path)
    rows = raw.select(
        *[F.col(f"`{old}`").alias(new) for old, new in headings.items()],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_part"),
        F.monotonically_increasing_id().alias("file_row"),
        F.col("_record").alias("record"),
    )
    numbers = {c: F.col(c).try_cast("int") for c in ("stock", "price")}
    broken = F.col("record").isNotNull()
    bad = numbers["stock"].isNull() | numbers["price"].isNull()
    reason = F.when(broken, "malformed_row").when(bad, "not_a_whole_number")
    rejects = rows.where(broken | bad).withColumn("reason", reason)
    return rows.where(~broken & ~bad).drop(*REJECT_PLACE).withColumns(numbers), rejects


def first_products(products: DataFrame, page: int = 1, per_page: int = 5) -> DataFrame:
    """A page of the platform's products from a snapshot table."""
    return products.orderBy("product_id").offset((page - 1) * per_page).limit(per_page)


def customers_above(customers: DataFrame, after_id) -> DataFrame:
    """Customers with a larger id, in order."""
    return customers.where(F.col("customer_id") > F.lit(after_id)).orderBy("customer_id")

