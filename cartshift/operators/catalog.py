"""Products: which codes have variants, and the upload layout that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.operators.cleaning import fill_target
from cartshift.operators.grouping import flag_repeated


def flag_variants(products: DataFrame, *code: str) -> DataFrame:
    """``has_variant`` is true where a product code occurs on several rows."""
    return flag_repeated(products, *(code or ("code",)), name="has_variant")


def variant_columns(products: DataFrame) -> DataFrame:
    """Price and stock go to the product, or to the variation if there are variants."""
    variant = F.col("has_variant")
    return products.withColumns(
        {
            "plain_price": F.when(variant, None).otherwise(F.col("price")),
            "plain_quantity": F.when(variant, None).otherwise(F.col("stock")),
            "specification": F.when(variant, fixed.VARIANT_SPECIFICATION),
            "variation_name": F.when(variant, F.col("size")),
            "variation_price": F.when(variant, F.col("price")),
            "variation_quantity": F.when(variant, F.col("stock")),
        }
    )


def project_products(products: DataFrame, image_url: str) -> DataFrame:
    """Flagged legacy products in the target layout."""
    filled = variant_columns(products).select(
        F.col("code").alias("product_handle"),
        F.col("name").alias("product_name_chinese"),
        F.col("style").alias("product_description_chinese"),
        F.col("size").alias("product_summary_chinese"),
        F.lit(True).alias("online_store_status"),
        F.lit(image_url).alias("images"),
        F.col("code").alias("sku"),
        F.col("plain_price").alias("price"),
        F.col("plain_quantity").alias("quantity"),
        F.col("specification").alias("specification_name_a_chinese"),
        F.col("variation_name").alias("variation_name_a_chinese"),
        "variation_price",
        "variation_quantity",
    )
    return fill_target(filled, fixed.TARGET_PRODUCT_COLUMNS, fixed.TARGET_PRODUCT_TYPES)
