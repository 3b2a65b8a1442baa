"""Writing staging tables, ledgers and upload files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators.grouping import sample_bounds, slice_number
from cartshift.operators.paging import slice_of, with_headings, with_pages
from cartshift.sources.readers import BOUNDS, SLICE, known_phase


def append_phase(table: DataFrame, path: str, phase: str, sort_by: str | None = None) -> None:
    """Add a batch to a table partitioned by phase.

    ``sort_by`` orders rows inside the files so that row-group statistics can prune
    an id range.
    """
    marked = table.withColumn("phase", F.lit(known_phase(phase)))
    if sort_by is not None:
        marked = marked.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    marked.write.mode("append").partitionBy("phase").parquet(path)


def load_phase(table: DataFrame, path: str, phase: str, sort_by: str | None = None) -> None:
    """Store a batch in a table partitioned by phase, in place of what that phase held; other phases stay.

    A load that is run again, or after one that failed, leaves the phase once.
    """
    marked = table.withColumn("phase", F.lit(known_phase(phase)))
    if sort_by is not None:
        marked = marked.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("phase").parquet(path)


def write_collated(rows: DataFrame, path: str, key: str, collation: str, slices: int) -> None:
    """Store rows in slices of the order that ``collation`` gives their ``key``, for ``readers.read_collated_range``.

    The bounds come from a bounded sample; rows of one slice lie together, one slice or a few to a file. Rows
    without a key are in the first slice.
    """
    bounds = [b[0] for b in sample_bounds(rows.where(F.col(key).isNotNull()), [key], slices, collation)]
    spark = rows.sparkSession
    kept = spark.createDataFrame([(key, collation, bounds)], "key string, collation string, bounds array<string>")
    kept.coalesce(1).write.parquet(f"{path}/{BOUNDS}")
    marked = rows.withColumn(SLICE, slice_number(rows, key, bounds, collation))
    marked.repartitionByRange(SLICE).sortWithinPartitions(SLICE).write.parquet(f"{path}/rows")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# A lookup names the entity and the field, so it reads one folder of the ledger.
LEDGER_FOLDERS = ("entity", "field")


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy(*LEDGER_FOLDERS).parquet(path)


def first_rows(
    customers: DataFrame, rows: int = fixed.CSV_EXPORT_ROWS, collation: str | None = None
) -> DataFrame:
    """The first rows by e-mail under the upload headings."""
    order_by = ["email_address", *customers.columns]
    return with_headings(slice_of(customers, order_by, rows, collation=collation))


def write_first_rows_csv(
    customers: DataFrame,
    path: str,
    rows: int = fixed.CSV_EXPORT_ROWS,
    collation: str | None = None,
) -> None:
    """One CSV file with the upload headings: the first rows by e-mail."""
    first_rows(customers, rows, collation).coalesce(1).write.mode("overwrite").options(
        header=True, escape='"'
    ).csv(path)


def page_rows(
    customers: DataFrame,
    order_by: list[str] | None = None,
    rows_per_page: int = fixed.ROWS_PER_PAGE,
    collation: str | None = None,
) -> DataFrame:
    """All rows under the upload headings with their ``page``; each page is in upload order."""
    paged = with_pages(customers, order_by or ["email_address"], rows_per_page, collation)
    return (
        paged.repartition("page")
        .sortWithinPartitions("page", "row_index")
        .transform(with_headings, fixed.UPLOAD_HEADINGS | {"page": "page"})
    )


def write_pages_csv(
    customers: DataFrame,
    path: str,
    order_by: list[str] | None = None,
    rows_per_page: int = fixed.ROWS_PER_PAGE,
    collation: str | None = None,
) -> None:
    """One CSV file per page under ``page=<n>``, rows in upload order."""
    (
        page_rows(customers, order_by, rows_per_page, collation)
        .write.mode("overwrite")
        .partitionBy("page")
        .options(header=True, escape='"')
        .csv(path)
    )
