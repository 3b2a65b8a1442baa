"""Upload order, pages and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators.grouping import collated, with_global_index


def id_range(
    rows: DataFrame,
    key: str,
    start: str | None = None,
    end: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Rows with ``start <= key < end`` as text; a bound left out is open.

    The order is binary unless a collation is named.
    """
    text = F.col(key) if collation is None else F.collate(F.col(key), collation)
    if start is not None:
        rows = rows.where(text >= F.lit(start))
    if end is not None:
        rows = rows.where(text < F.lit(end))
    return rows


def with_headings(rows: DataFrame, headings: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed to the upload headings, in their order; others are left out."""
    headings = fixed.UPLOAD_HEADINGS if headings is None else headings
    return rows.select(*[F.col(name).alias(heading) for name, heading in headings.items()])


def slice_of(
    rows: DataFrame, order_by: list[str], size: int, skip: int = 0, collation: str | None = None
) -> DataFrame:
    """``size`` rows in order after the first ``skip``; for small reports."""
    place = [*collated(rows, order_by, collation), *order_by]
    return rows.orderBy(*place).offset(skip).limit(size)


def with_pages(
    rows: DataFrame,
    order_by: list[str],
    rows_per_page: int = fixed.ROWS_PER_PAGE,
    collation: str | None = None,
) -> DataFrame:
    """``page`` 1..n of every row, all pages from one sort."""
    page = F.floor(F.col("row_index") / F.lit(rows_per_page)).cast("bigint") + 1
    return with_global_index(rows, order_by, collation=collation).withColumn("page", page)
