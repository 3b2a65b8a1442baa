from decimal import Decimal

import pytest

from cartshift import fixed_values as fixed
from cartshift.plans import flows


@pytest.fixture
def products(rows):
    return rows(
        "code string, name string, style string, size string, stock int, price int",
        ("A", "cake", "s", "M", 1, 10),
        ("B", "tea", "s", "M", 2, 20),
        ("B", "tea", "s", "L", 3, 30),
        (None, "x", "s", "M", 4, 40),
        (None, "x", "s", "L", 5, 50),
    )


def test_products_with_and_without_variants(products, collect):
    prepared = flows.prepare_products(products, "logo.png")
    assert prepared.columns == list(fixed.TARGET_PRODUCT_COLUMNS)
    columns = (
        "product_handle", "sku", "price", "quantity", "specification_name_a_chinese",
        "variation_name_a_chinese", "variation_price", "variation_quantity",
    )
    assert collect(prepared, *columns) == [
        ("A", "A", Decimal(10), 1, None, None, None, None),
        ("B", "B", None, None, "規格", "L", Decimal(30), 3),
        ("B", "B", None, None, "規格", "M", Decimal(20), 2),
        # a missing code is no code: no variants
        (None, None, Decimal(40), 4, None, None, None, None),
        (None, None, Decimal(50), 5, None, None, None, None),
    ]
    assert {r[0] for r in prepared.select("images").collect()} == {"logo.png"}
    assert {r[0] for r in prepared.select("online_store_status").collect()} == {True}
    assert collect(prepared.select("product_summary_chinese").distinct()) == [("L",), ("M",)]
