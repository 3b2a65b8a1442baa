"""Explicit schemas. Legacy exports are text: inference would eat leading zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cartshift import fixed_values as fixed


def text_schema(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def ddl_schema(columns, types: dict[str, str]) -> str:
    return ", ".join(f"{c} {types.get(c, 'string')}" for c in columns)


# Order lines keep their amounts and dates as text; ``line_seq`` is given at ingest.
ORDER_LINES = text_schema([*fixed.ORDER_LINE_COLUMNS.values(), "platform_order_id"]).add(
    "line_seq", "long"
)
ORDER_UIDS = "order_uid string, phase string"
LEGACY_CUSTOMERS = ddl_schema(
    fixed.CUSTOMER_COLUMNS.values(), {"points": "int", "credits": "int"}
)
LEGACY_PRODUCTS = ddl_schema(fixed.PRODUCT_COLUMNS.values(), {"stock": "int", "price": "int"})
TARGET_CUSTOMERS = ddl_schema(
    [*fixed.UPLOAD_HEADINGS, fixed.ORIGINAL_ADDRESS], fixed.TARGET_CUSTOMER_TYPES
)
TARGET_PRODUCTS = ddl_schema(fixed.TARGET_PRODUCT_COLUMNS, fixed.TARGET_PRODUCT_TYPES)
PLATFORM_CUSTOMERS = "customer_id string, email string, credits int, points int"
POINTS_RECON = "customer_id string, full_name string, email string, platform_credits int, " \
    "platform_points int, legacy_credits int, legacy_points int"
TAG_RECON = "customer_id string, full_name string, email string, tier string"
BALANCE_SNAPSHOT = "customer_id string, balance int, fetched_at timestamp"
SEARCH_SNAPSHOT = "query string, platform_order_id string"
RESPONSES = "request_id string, entity string, entity_id string, http_status int, " \
    "answer string, answered_at timestamp"


def from_legacy(df: DataFrame, names: dict[str, str], **more: str) -> DataFrame:
    """Rename legacy columns; ``more`` maps a name used here to the table's own.

    ``from_legacy(t, fixed.ORDER_LINE_COLUMNS, platform_order_id="...")``
    """
    wanted = names | {theirs: ours for ours, theirs in more.items()}
    present = {old: new for old, new in wanted.items() if old in df.columns}
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in present.items()])
