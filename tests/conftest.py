import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartshift.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("cartshift-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows("a int, b string", (1, "x"), ...)`` as a DataFrame."""

    def build(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return build


@pytest.fixture
def order_lines(spark):
    """Legacy order lines from dicts; columns not given are NULL."""
    from cartshift.fixed_values import ORDER_LINE_COLUMNS

    columns = [*ORDER_LINE_COLUMNS.values(), "platform_order_id"]
    schema = "line_seq long, " + ", ".join(f"{c} string" for c in columns)
    usual = {
        "item_code": "A1",
        "item_name": "cake",
        "unit_price": "10",
        "quantity": "1",
        "items_subtotal": "10",
        "order_total": "10",
        "discount_total": "0",
        "shipping_fee": "0",
        "created_at": "2022/03/17 21:26:29",
        "order_status": "新訂單",
    }

    def build(*dicts):
        seen = {}
        values = []
        for d in dicts:
            d = usual | d
            seq = d.get("line_seq", seen.get(d["order_uid"], 0) + 1)
            seen[d["order_uid"]] = seq
            values.append((seq, *[d.get(c) for c in columns]))
        return spark.createDataFrame(values, schema)

    return build


def collect(df, *columns):
    """Rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    found = [tuple(r) for r in chosen.collect()]
    return sorted(found, key=lambda t: [(x is None, str(x)) for x in t])


@pytest.fixture(name="collect")
def collect_fixture():
    return collect
