"""A third of the rows under one key, half of them exact copies of one row."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import compare  # noqa: E402
from cartshift.operators import grouping, ledger, orders, reconcile  # noqa: E402
from cartshift.sources import readers  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")

HOT_KEYS = {
    "lineitem": {"l_orderkey": 1},
    "events": {"user_id": 7},
    "orders": {"o_custkey": 3},
    "part": {"p_name": "red ring", "p_brand": "Brand#1", "p_type": "SMALL", "p_size": 5},
}

QUERIES = """
order_items_long order_items_long_line_total order_balance_unit create_order_json line_numbers
lines_deduped_window lines_deduped_by_list fraction_amount_first orders_purged dup_key_keep_min variant_flag
variant_projection recon_full points_plan search_resolution rows_per_customer ledger_latest
pending_after_ledger platform_ids_written_back
""".split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    if not FOLDER.exists():
        pytest.skip("test tables are not here")
    folder = tmp_path_factory.mktemp("skewed")
    random = np.random.default_rng(1)
    for name in compare.TABLES:
        table = pq.read_table(FOLDER / f"{name}.parquet")
        hot = random.random(table.num_rows) < 1 / 3
        for column, value in HOT_KEYS.get(name, {}).items():
            at = table.schema.get_field_index(column)
            field = table.schema.field(column)
            values = [value if h else v for h, v in zip(hot, table[column].to_pylist())]
            table = table.set_column(at, field, pa.array(values, type=field.type))
        if name == "lineitem":
            rows = np.arange(table.num_rows)
            copies = rows[hot]
            rows[copies[: len(copies) // 2]] = copies[-1]
            table = table.take(pa.array(rows))
        pq.write_table(table, folder / f"{name}.parquet", row_group_size=500)
    return folder


@pytest.fixture(scope="module")
def database(skewed):
    connection = duckdb.connect()
    for name in compare.TABLES:
        path = skewed / f"{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, database, skewed, monkeypatch, name):
    monkeypatch.setitem(grouping.number_within.__kwdefaults__, "hot_rows", 500)
    assert compare.compare(spark, database, str(skewed), name) is None


@pytest.fixture
def large_scale(spark, monkeypatch):
    """Treat small tables as large ones: no broadcasts, skew starts at a few rows."""
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_rows(spark, n=40_000):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string"))
    return spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("v"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def splits(df):
    """Joins whose hot key was cut into several tasks."""
    return final_plan(df).count("skew=true")


def test_the_join_that_brings_facts_back_splits_the_hot_key(large_scale):
    assert splits(grouping.keep_on_smallest(hot_rows(large_scale), "k", "v")) == 1
    assert splits(grouping.flag_repeated(hot_rows(large_scale), "k", name="twice")) == 1


def test_every_part_of_the_full_join_splits_the_hot_key(large_scale):
    left = hot_rows(large_scale)
    right = large_scale.range(500).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("w"),
    )
    joined = reconcile.full_join(left, right, "k")
    assert splits(joined) == 2 and "FullOuter" not in final_plan(joined)
    swapped = reconcile.full_join(right, left, "k")
    assert splits(swapped) == 2


def test_null_keys_stay_in_the_full_join_and_are_split(large_scale):
    key = F.when(F.col("id") % 3 != 0, (F.col("id") % 1000).cast("string"))
    left = large_scale.range(0, 40_000, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
    right = large_scale.range(300).select(
        F.when(F.col("id") > 9, F.col("id").cast("string")).alias("k"), F.col("id").alias("w")
    )
    joined = reconcile.full_join(left, right, "k")
    assert splits(joined) >= 1
    assert joined.count() == left.join(right, "k", "full").count()
    assert joined.where("k is null and v is not null").count() == 13334


def test_ledger_and_line_lookups_split_the_hot_key(large_scale):
    lines = hot_rows(large_scale).select(F.col("k").alias("order_uid"), "v")
    book = large_scale.range(900).select(
        F.lit("order").alias("entity"),
        F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("entity_id"),
        F.lit("platform_order_id").alias("field"),
        F.col("id").cast("string").alias("value"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
    )
    key = ("order", "platform_order_id", "order_uid")
    assert splits(ledger.pending(lines, book, *key)) == 1
    assert splits(ledger.write_back(lines, book, *key)) == 1
    wanted = book.select(F.col("entity_id").alias("order_uid"))
    assert splits(readers.lines_of_orders(lines, wanted)) == 1


def test_a_short_key_list_leaves_the_lines_where_they_are(large_scale, monkeypatch):
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 1000)
    lines = hot_rows(large_scale).select(F.col("k").alias("order_uid"), "v")
    wanted = large_scale.range(5).select(F.col("id").cast("string").alias("order_uid"))
    plan = final_plan(readers.lines_of_orders(lines, wanted))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeated_lines_of_one_order_with_and_without_a_broadcast(large_scale, monkeypatch):
    lines = large_scale.range(0, 3000, 1, 6).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("order_uid"),
        F.when(F.col("id") < 1000, F.col("id") + 1).otherwise(1).alias("line_seq"),
        (F.col("id") % 10).cast("string").alias("line_order_no"),
        F.lit("2023/02/01 00:00:00").alias("created_at"),
    )
    for most in (0, 10_000):
        monkeypatch.setattr(grouping, "BROADCAST_ROWS", most)
        left = orders.drop_repeated_lines(lines)
        assert left.where("order_uid = 'hot'").agg(F.max("line_seq")).first()[0] == 10
        assert left.count() == 2010


def test_lines_marked_at_ingest_lose_the_same_lines(spark, rows, collect):
    lines = rows(
        "order_uid string, at int, line_order_no string, created_at string",
        *[(u, i, None if i % 4 == 0 else str(i % 3), f"2023/{m}/01 00:00:00") for u, m in (("a", "02"), ("b", "09"), ("c", "02")) for i in range(30)],
    )
    for hot in (1_000_000, 10):
        marked = grouping.number_within(lines, "order_uid", order_by=["at"], name="line_seq", hot_rows=hot, again="line_order_no")
        plain = marked.drop("again")
        want = collect(orders.drop_repeated_lines(plain), "order_uid", "line_seq", "line_order_no")
        assert collect(orders.drop_repeated_lines(marked).drop("again"), "order_uid", "line_seq", "line_order_no") == want
        assert len(want) == 30 + 2 * 4


def test_marking_takes_no_further_shuffle(spark, rows):
    lines = rows("order_uid string, at int, line_order_no string", ("a", 1, "x"), ("a", 2, "x"))
    marked = grouping.number_within(lines, "order_uid", order_by=["at"], name="line_seq", again="line_order_no")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") >= 2


def test_a_list_of_repeated_lines_moves_no_numbered_line(spark, rows, monkeypatch, collect):
    """The list comes to the lines by their order alone, unless an order has very many repeated numbers."""
    lines = rows("order_uid string, at int, line_order_no string", *[(f"U{i}", n, None if n == 3 else str(n % 2)) for i in range(4) for n in range(8)])
    numbered = grouping.number_within(lines, "order_uid", order_by=["at"], name="line_seq")
    affected = rows("order_uid string", ("U1",), ("U2",))
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 0)
    by_order = orders.drop_repeated_lines(numbered, affected)
    monkeypatch.setattr(orders, "NUMBERS_PER_ORDER", 0)
    by_number = orders.drop_repeated_lines(numbered, affected)
    assert collect(by_order) == collect(by_number) and by_order.count() == 16 + 2 * 3
    joined = by_order._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (order_uid#" in joined and "coalesce(line_order_no#" not in joined.split("Join LeftOuter")[1].splitlines()[0]
