import random
from collections import Counter, defaultdict

import pytest

from cartshift.operators import grouping, paging


def test_duplicate_report_counts_nulls_as_one_group(rows, collect):
    df = rows("k string", ("a",), ("a",), ("b",), (None,), (None,))
    assert collect(grouping.duplicate_report(df, "k")) == [("a", 2), (None, 2)]


def test_null_keys_are_never_repeated(rows, collect):
    df = rows("k string, v int", ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5))
    flagged = grouping.flag_repeated(df, "k", name="twice")
    assert collect(flagged, "v", "twice") == [
        (1, True), (2, True), (3, False), (4, False), (5, False)
    ]


def test_key_stays_on_the_smallest_and_on_ties_and_nulls(rows, collect):
    df = rows(
        "phone string, email string, n int",
        ("p", "b", 1), ("p", "a", 2), ("p", "a", 3), ("p", None, 4), ("q", "z", 5),
        (None, "c", 6), (None, "d", 7), ("r", "B", 8), ("r", "a", 9),
    )
    kept = grouping.keep_on_smallest(df, "phone", "email")
    assert kept.columns == df.columns
    assert collect(kept, "n", "phone") == [
        (1, None), (2, "p"), (3, "p"), (4, "p"), (5, "q"), (6, None), (7, None),
        (8, "r"), (9, None),  # binary order: capitals first
    ]


def test_first_per_key_is_a_whole_row(rows, collect):
    df = rows("k int, o int, v string", (1, 2, "a"), (1, 1, "c"), (1, 1, "b"), (2, 9, "z"))
    first = grouping.first_per_key(df, "k", order_by=["o"])
    assert collect(first) == [(1, 1, "b"), (2, 9, "z")]


@pytest.fixture
def skewed(rows):
    """A third of all rows under one key, half of them exact copies."""
    random.seed(7)
    hot = [("hot", random.randrange(50), "x") for _ in range(100)] + [("hot", 7, "y")] * 100
    cold = [(f"k{random.randrange(40)}", random.randrange(9), "z") for _ in range(400)]
    values = hot + cold + [(None, 1, "n"), (None, 0, "n")]
    random.shuffle(values)
    return values, rows("k string, o int, v string", *values)


def test_global_index_is_the_sorted_position(skewed):
    values, df = skewed
    indexed = grouping.with_global_index(df, ["k", "o", "v"], slices=5).collect()
    assert sorted(r.row_index for r in indexed) == list(range(len(values)))
    ordered = sorted(values, key=lambda t: (t[0] is not None, t[0] or "", t[1], t[2]))
    got = [tuple(r)[:3] for r in sorted(indexed, key=lambda r: r.row_index)]
    assert got == ordered


def test_copies_that_fill_a_slice_are_counted_out_and_not_sorted(rows):
    df = rows("k int, v string", *[(1, "x")] * 400, (0, "a"), (1, "w"), (1, "y"), (2, "x"), (None, "n")).repartition(4)
    indexed = grouping.with_global_index(df, ["k"], slices=4)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "Union" in plan
    got = sorted((r.row_index, r.k, r.v) for r in indexed.collect())
    want = [(None, "n"), (0, "a"), (1, "w"), *[(1, "x")] * 400, (1, "y"), (2, "x")]
    assert got == [(i, *row) for i, row in enumerate(want)]


def test_a_key_that_fills_slices_is_cut_by_the_other_columns(rows):
    df = rows("k int, v int", *[(1, i) for i in range(300)], *[(i, 0) for i in range(2, 40)]).repartition(4)
    indexed = grouping.with_global_index(df, ["k"], slices=6)
    got = [(r.k, r.v) for r in sorted(indexed.collect(), key=lambda r: r.row_index)]
    assert got == [(1, i) for i in range(300)] + [(i, 0) for i in range(2, 40)]
    runs = grouping._sampled(df, cut := grouping._Cut(df, ["k"], None, ["v"]), 1.0)
    cut.choose(runs, 50, whole=True)
    sizes = [r["count"] for r in df.groupBy(cut.slice().alias("s")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 50 and not cut.copies


def test_positions_store_nothing_and_read_only_the_order_for_the_bounds(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(grouping, "checkpointed", None)
    spark.range(2000).selectExpr("id % 700 as k", "id as v", "repeat('x', 50) as wide").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    seen = []
    counted = type(df).count
    monkeypatch.setattr(type(df), "count", lambda d: seen.append(d.columns) or counted(d))
    sampled = grouping._sampled
    monkeypatch.setattr(grouping, "_sampled", lambda d, cut, share: seen.append(cut.names) or sampled(d, cut, share))
    indexed = grouping.with_global_index(df, ["k"], slices=5)
    assert seen == [["k"], ["k"]]
    assert sorted(r.row_index for r in indexed.collect()) == list(range(2000))


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(9,2)", "double", "binary", "timestamp_ntz", "boolean"])
def test_bounds_of_any_plain_type(spark, kind):
    values = {
        "timestamp": "timestamp_seconds(id * 7 % 50)", "date": "date_from_unix_date(int(id % 40))",
        "decimal(9,2)": "cast(id % 30 / 7 as decimal(9,2))", "double": "id % 30 / 7", "binary": "cast(cast(id % 30 as string) as binary)",
        "timestamp_ntz": "cast(timestamp_seconds(id * 7 % 50) as timestamp_ntz)", "boolean": "id % 2 = 0",
    }
    df = spark.range(300).selectExpr(f"if(id % 11 = 0, null, {values[kind]}) as k", "id as v", "array(id) as more")
    got = sorted((r.row_index, r.v) for r in grouping.with_global_index(df, ["k"], slices=5).collect())
    want = [r.v for r in df.coalesce(1).sortWithinPartitions("k", "v").collect()]
    assert got == list(enumerate(want))


def test_empty_table_has_no_positions(rows):
    assert grouping.with_global_index(rows("k int"), ["k"]).collect() == []


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_numbers_within_hot_and_cold_groups(skewed, hot_rows):
    values, df = skewed
    numbered = grouping.number_within(df, "k", order_by=["o", "v"], name="n", hot_rows=hot_rows)
    groups = defaultdict(list)
    for r in numbered.collect():
        groups[r.k].append((r.n, r.o, r.v))
    assert Counter(t[0] for t in values) == Counter({k: len(g) for k, g in groups.items()})
    for group in groups.values():
        group.sort()
        assert [n for n, _, _ in group] == list(range(1, len(group) + 1))
        assert [(o, v) for _, o, v in group] == sorted((o, v) for _, o, v in group)


def test_attached_facts_keep_every_row(rows, collect):
    df = rows("k string, v int", ("a", 1), ("b", 2), (None, 3))
    facts = rows("k string, f int", ("a", 10))
    assert collect(grouping.attach(df, facts, "k"), "v", "f") == [(1, 10), (2, None), (3, None)]


def test_no_window_over_all_rows(skewed):
    _, df = skewed
    plan = grouping.with_global_index(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("hashpartitioning(_slice") >= 1


def test_tied_rows_are_numbered_alike_at_every_group_size(rows, collect):
    tied = rows("k string, at int, v int", *[("a", 1, v) for v in (3, 1, 5, 2, 4)])
    small, large = (
        collect(grouping.number_within(tied, "k", order_by=["at"], name="n", hot_rows=h), "v", "n")
        for h in (1_000_000, 2)
    )
    assert small == large == [(v, v) for v in range(1, 6)]


def test_a_collation_decides_which_text_is_smallest(rows, collect):
    df = rows("k string, o string", ("p", "a"), ("p", "B"), ("q", "a"), ("q", "A"))
    binary = grouping.keep_on_smallest(df, "k", "o")
    assert collect(binary) == [("p", "B"), ("q", "A"), (None, "a"), (None, "a")]
    folded = grouping.keep_on_smallest(df, "k", "o", "UNICODE_CI")
    assert collect(folded) == [("p", "a"), ("q", "A"), ("q", "a"), (None, "B")]


def test_a_collation_orders_positions(rows):
    df = rows("o string, v int", ("b", 1), ("A", 2), ("B", 3), ("a", 4))

    def order(collation):
        indexed = grouping.with_global_index(df, ["o"], slices=3, collation=collation)
        return [r.o for r in sorted(indexed.collect(), key=lambda r: r.row_index)]

    assert order(None) == ["A", "B", "a", "b"]
    assert order("UNICODE_CI") == ["A", "a", "B", "b"]
    first = paging.slice_of(df, ["o"], 3, collation="UNICODE_CI").collect()
    assert [r.o for r in first] == ["A", "a", "B"]


def test_a_key_list_is_computed_once(rows, monkeypatch):
    stored = []
    monkeypatch.setattr(grouping, "checkpointed", lambda d: stored.append(d) or d)
    df = rows("k int", (1,), (2,))
    grouping.key_list(df)
    grouping.key_list(df, stored=True)
    assert stored == [df]


def test_hot_keys_are_counted_once(skewed):
    _, df = skewed
    numbered = grouping.number_within(df, "k", order_by=["o", "v"], name="n", hot_rows=50)
    assert "count(1)" not in numbered._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("literals", [100, 0])
def test_rows_that_lie_together_are_numbered_where_they_lie(spark, rows, collect, tmp_path, monkeypatch, literals):
    """Keys that stand under several places, missing and hot ones are numbered by their key."""
    monkeypatch.setattr(grouping, "LITERAL_KEYS", literals)
    keys = [("a", "p1"), ("b", "p1"), ("c", "p2"), ("c", "p3"), (None, "p4"), (None, "p5"), ("h", "p6")]
    values = [(k, p, o % 5, str(o % 3), o) for k, p in keys for o in range(30 if k == "h" else 7)]
    df = rows("k string, place string, o int, no string, v int", *values).repartition(4, "place")
    df.write.bucketBy(4, "place").option("path", str(tmp_path / "laid")).format("parquet").saveAsTable(f"laid_{literals}")
    table = spark.table(f"laid_{literals}")
    of = {"order_by": ["o"], "name": "seq", "again": "no", "hot_rows": 20}
    plain = grouping.number_within(table, "k", **of)
    laid = grouping.number_within(table, "k", laid_by=("place",), **of)
    assert collect(laid, *sorted(laid.columns)) == collect(plain, *sorted(laid.columns))
    assert sorted(r.seq for r in laid.where("k = 'c'").collect()) == list(range(1, 15))
    single = grouping.number_within(table.where("k in ('a', 'b')"), "k", laid_by=("place",), **of)
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 2 and "Exchange" not in plan
