"""Outcomes by key: append, read the latest, resume from what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import has_text
from cartshift.operators.grouping import attach, join_side

LEDGER_SCHEMA = "entity string, entity_id string, field string, value string, ts timestamp"


def entries(
    rows: DataFrame, entity: str, entity_id: str, field: str, value: Column, ts: Column
) -> DataFrame:
    """Ledger rows to append; a missing or empty value is not an outcome."""
    built = rows.select(
        F.lit(entity).alias("entity"),
        F.col(entity_id).cast("string").alias("entity_id"),
        F.lit(field).alias("field"),
        value.cast("string").alias("value"),
        ts.alias("ts"),
    )
    return built.where(has_text(F.col("value")))


def latest(ledger: DataFrame) -> DataFrame:
    """The newest value per (entity, id, field); equal times fall to the larger value."""
    return (
        ledger.groupBy("entity", "entity_id", "field")
        .agg(F.max(F.struct("ts", "value")).alias("newest"))
        .select("entity", "entity_id", "field", "newest.value", "newest.ts")
    )


def values_of(ledger: DataFrame, entity: str, field: str, key: str) -> DataFrame:
    """Latest values of one field as ``(key, field)`` rows."""
    wanted = ledger.where((F.col("entity") == entity) & (F.col("field") == field))
    return latest(wanted).select(F.col("entity_id").alias(key), F.col("value").alias(field))


def pending(
    rows: DataFrame, ledger: DataFrame, entity: str, field: str, key: str, state: str | None = None
) -> DataFrame:
    """Rows without an outcome, neither in their own ``state`` column nor in the ledger."""
    open_rows = rows if state is None else rows.where(F.col(state).isNull())
    done = ledger.where((F.col("entity") == entity) & (F.col("field") == field))
    done = done.select(F.col("entity_id").alias(key)).distinct()
    return open_rows.join(join_side(done), key, "left_anti")


def write_back(rows: DataFrame, ledger: DataFrame, entity: str, field: str, key: str) -> DataFrame:
    """Set ``field`` to the ledger's latest value, on every row of the key that has one."""
    newest = values_of(ledger, entity, field, key).withColumnRenamed(field, "newest")
    if field not in rows.columns:
        rows = rows.withColumn(field, F.lit(None).cast("string"))
    merged = F.coalesce(F.col("newest"), F.col(field))
    return attach(rows, newest, key).withColumn(field, merged).select(*rows.columns)


def not_created(orders: DataFrame) -> DataFrame:
    """Orders without a platform id, missing or empty."""
    return orders.where(~has_text(F.col("platform_order_id")))


def unrecorded_orders(
    lines: DataFrame, platform: str = fixed.RECOVERY_PLATFORM
) -> DataFrame:
    """Distinct order ids of one platform whose platform id is missing (not just empty)."""
    missing = F.col("platform_order_id").isNull() & (F.col("platform") == platform)
    return lines.where(missing).select("order_uid").distinct()
