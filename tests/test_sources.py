import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift import session
from cartshift.operators import paging
from cartshift.operators.cleaning import fill_target
from cartshift.sources import readers, schemas, writers


@pytest.fixture
def customers(spark):
    def build(n):
        some = spark.range(n).select(
            F.concat(F.lit("user"), F.lpad((F.col("id") % 3500).cast("string"), 5, "0")).alias(
                "email_address"
            ),
            F.concat(F.lit('say "hi", '), F.col("id").cast("string")).alias("note"),
        )
        layout = [*fixed.UPLOAD_HEADINGS, fixed.ORIGINAL_ADDRESS]
        return fill_target(some, layout, fixed.TARGET_CUSTOMER_TYPES)

    return build


def test_products_from_csv_with_rejects(spark, tmp_path, collect):
    heading = ["商品編號", "extra", "商品名稱", "樣式", "尺寸", "實際庫存(可用庫存+配貨)", "售價"]
    lines = [
        ["007", "", 'a "b", c', "s", "M", "5", "100"],
        ["008", "", "d", "s", "L", "5.5", "100"],
        ["009", "", "e", "s", "L", "5", ""],
        ["010", "", "f", "s", "L", " 6 ", "7"],
    ]
    path = tmp_path / "products.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([heading, *lines])
    products, rejects = readers.read_products_csv(spark, str(path))
    assert collect(products) == [
        ("007", 'a "b", c', "s", "M", 5, 100), ("010", "f", "s", "L", 6, 7)
    ]
    assert collect(rejects, "code", "reason") == [
        ("008", "not_a_whole_number"), ("009", "not_a_whole_number")
    ]


def test_legacy_names(rows):
    native = rows("`交易平台` string, `交易序號` string, `new_id` string, x int", ("U", "1", "P", 1))
    named = schemas.from_legacy(native, fixed.ORDER_LINE_COLUMNS, platform_order_id="new_id")
    assert named.columns == ["platform", "transaction_no", "platform_order_id"]


def test_phases(spark, rows, tmp_path, collect):
    first, second = rows("order_uid string", ("a",)), rows("order_uid string", ("b",))
    both = readers.union_phases({"first": first, "second": second})
    assert collect(both) == [("a", "first"), ("b", "second")]
    for phase in ("sixth", "1", None):
        with pytest.raises(ValueError):
            readers.of_phase(both, phase)
    path = str(tmp_path / "orders")
    writers.append_phase(first, path, "first")
    writers.append_phase(second, path, "second", sort_by="order_uid")
    writers.append_phase(first, path, "second")
    stored = readers.read_table(spark, path)
    chosen = readers.of_phase(stored, "second")
    assert collect(chosen, "order_uid") == [("a",), ("b",)]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(phase" in plan


def test_lines_of_orders_and_purge_order(rows, collect):
    lines = rows("order_uid string, n int", ("a", 1), ("a", 2), ("b", 3))
    ids = rows("order_uid string", ("a",), ("a",), ("z",))
    assert collect(readers.lines_of_orders(lines, ids)) == [("a", 1), ("a", 2)]
    customers = rows("customer_id string", ("c",), ("a",), ("b",))
    assert [r[0] for r in readers.customers_above(customers, "a").collect()] == ["b", "c"]
    products = rows("product_id int", *[(i,) for i in range(12, 0, -1)])
    assert [r[0] for r in readers.first_products(products).collect()] == [1, 2, 3, 4, 5]
    assert [r[0] for r in readers.first_products(products, page=3).collect()] == [11, 12]


def test_id_range_is_half_open_and_binary_unless_asked(rows, collect):
    uids = rows("uid string", ("F1",), ("F2",), ("f1",), ("自訂交易1",), ("自訂交易2",), (None,))
    assert collect(paging.id_range(uids, "uid", "F1", "F2")) == [("F1",)]
    assert collect(paging.id_range(uids, "uid", "自訂交易1", "自訂交易2")) == [("自訂交易1",)]
    letters = rows("uid string", ("a",), ("B",), ("c",))
    assert collect(paging.id_range(letters, "uid", "a", "c")) == [("a",)]
    assert collect(paging.id_range(letters, "uid", "a", "c", "UNICODE")) == [("B",), ("a",)]


def test_first_rows_csv(customers, tmp_path):
    path = tmp_path / "first"
    writers.write_first_rows_csv(customers(300), str(path))
    (part,) = path.glob("*.csv")
    with part.open(newline="") as f:
        heading, *lines = csv.reader(f)
    assert heading == list(fixed.UPLOAD_HEADINGS.values())
    emails = [line[1] for line in lines]
    assert len(lines) == 100 and emails == sorted(emails) and emails[0] == "user00000"
    assert lines[0][10] == 'say "hi", 0'


@pytest.mark.parametrize("n, pages", [(0, 0), (1, 1), (3000, 1), (3001, 2), (7000, 3)])
def test_one_file_per_page(customers, tmp_path, n, pages):
    path = tmp_path / "pages"
    writers.write_pages_csv(customers(n), str(path))
    folders = sorted(Path(path).glob("page=*"))
    assert [f.name for f in folders] == [f"page={i}" for i in range(1, pages + 1)]
    emails = []
    for i, folder in enumerate(folders, start=1):
        (part,) = folder.glob("*.csv")
        with part.open(newline="") as f:
            heading, *lines = csv.reader(f)
        assert heading == list(fixed.UPLOAD_HEADINGS.values())
        assert len(lines) == (3000 if i < pages else n - 3000 * (pages - 1))
        emails += [line[1] for line in lines]
    assert emails == sorted(emails) and len(emails) == n


def test_slice_skips_then_takes(rows):
    df = rows("k int", *[(i,) for i in range(20)])
    assert [r.k for r in paging.slice_of(df, ["k"], 3, 5).collect()] == [5, 6, 7]


def test_target_layouts():
    assert len(fixed.UPLOAD_HEADINGS) == 33
    assert len(fixed.TARGET_PRODUCT_COLUMNS) == 58 == len(set(fixed.TARGET_PRODUCT_COLUMNS))
    assert set(fixed.TARGET_PRODUCT_TYPES) <= set(fixed.TARGET_PRODUCT_COLUMNS)


def test_jdbc_reads_in_ranges(spark, monkeypatch):
    asked = {}

    class Reader:
        def jdbc(self, url, table, **options):
            asked.update(options, url=url, table=table)

    class Session:
        read = Reader()

    readers.read_jdbc(Session(), "jdbc:x", "t", "id", 1, 100, 8)
    assert asked["numPartitions"] == 8 and asked["column"] == "id" and asked["url"] == "jdbc:x"


def test_checkpoint_folder_is_never_invented_on_a_cluster():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Frame:
        class sparkSession:
            sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.checkpointed(Frame())


def test_checkpoint_folder_of_the_session_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    session.checkpointed(spark.range(3))
    assert folder in spark.sparkContext.getCheckpointDir()


def met(df, predicates):
    """How many of the conditions each row meets."""
    hits = [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates]
    return [r[0] for r in df.select(sum(hits, F.lit(0))).collect()]


@pytest.mark.parametrize("collation", [None, "UTF8_LCASE", "UNICODE_CI"])
def test_every_row_meets_one_text_range(rows, collation):
    keys = ["", None, "A", "a", "é", "Z", "it's", "ünder", "0", "～", *[f"k{i:03}" for i in range(200)], *["K100"] * 30]
    df = rows("id string", *[(k,) for k in keys])
    for slices in (1, 2, 7, 40):
        bounds = readers.text_bounds(df.where("id like 'k%' or id = 'it''s'"), "id", slices, collation)
        assert len(bounds) == slices - 1
        assert met(df, readers.text_predicates("id", bounds, collation)) == [1] * len(keys)
    assert readers.text_bounds(df.limit(0), "id", 5) == [] and readers.text_predicates("id", []) == ["1 = 1"]


def test_text_ranges_share_the_rows_out(rows):
    df = rows("id string", *[(f"{i:05}",) for i in range(3000)])
    predicates = readers.text_predicates("id", readers.text_bounds(df, "id", 6))
    sizes = [df.where(p).count() for p in predicates]
    assert sum(sizes) == 3000 and max(sizes) < 750


def test_bounds_are_quoted_and_never_hold_a_backslash(rows):
    df = rows("id string", *[(k,) for k in ("a\\", "b'b", "c\\'", "d") * 5])
    bounds = readers.text_bounds(df, "id", 4)
    assert bounds and all("\\" not in b for b in bounds)
    assert met(df, readers.text_predicates("id", bounds)) == [1] * 20


def test_jdbc_reads_text_ranges(monkeypatch):
    asked = {}

    class Session:
        class read:
            jdbc = staticmethod(lambda url, table, **options: asked.update(options, url=url, table=table))

    readers.read_jdbc_by_text(Session(), "jdbc:x", "t", "id", ["b", "m'"], '"C"')
    assert asked["predicates"] == [
        "id COLLATE \"C\" < 'b' OR id IS NULL",
        "id COLLATE \"C\" >= 'b' AND id COLLATE \"C\" < 'm'''",
        "id COLLATE \"C\" >= 'm'''",
    ]


def test_a_phase_that_is_loaded_again_replaces_itself_only(spark, rows, tmp_path, collect):
    path = str(tmp_path / "orders")
    writers.load_phase(rows("k int", (1,), (2,)), path, "first", sort_by="k")
    writers.load_phase(rows("k int", (7,)), path, "second")
    for _ in range(2):
        writers.load_phase(rows("k int", (3,), (4,), (5,)), path, "first", sort_by="k")
    table = readers.read_table(spark, path)
    assert collect(table, "k", "phase") == [(3, "first"), (4, "first"), (5, "first"), (7, "second")]
    plan = readers.of_phase(table, "first")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(phase" in plan and "PushedFilters: []" in plan


def test_rejects_of_a_product_file_tell_where_they_stand(spark, tmp_path, collect):
    headings = ["商品編號", "商品名稱", "樣式", "尺寸", fixed.PRODUCT_CSV_STOCK_HEADING, "售價"]
    lines = [",".join(headings), "A,cake,s,M,1,10", "B,tea,s,M", "C,tea,s,M,x,5", 'D,"a ""b"",\nc",s,M,3,7', "E,pie,s,M,1,2,3,4"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    products, rejects = readers.read_products_csv(spark, str(tmp_path / "p.csv"), multi_line=True)
    assert collect(products, "code", "name", "stock") == [("A", "cake", 1), ("D", 'a "b",\nc', 3)]
    found = {r["code"]: r for r in rejects.collect()}
    assert {c: r["reason"] for c, r in found.items()} == {"B": "malformed_row", "C": "not_a_whole_number", "E": "malformed_row"}
    assert found["B"]["record"].strip() == "B,tea,s,M" and found["C"]["record"] is None
    assert all(r["file_path"].endswith("p.csv") for r in found.values())
    assert found["B"]["file_row"] < found["C"]["file_row"] < found["E"]["file_row"]


@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI", "UNICODE"])
def test_a_collated_range_reads_its_slices_only(spark, rows, tmp_path, collation):
    keys = [f"{a}{i:03}" for i in range(200) for a in ("k" if i % 2 else "K", "É" if i % 3 else "é")] + ["k050", "K050", "", "z", None]
    df = rows("uid string, v int", *[(k, i) for i, k in enumerate(keys)])
    path = str(tmp_path / "t")
    writers.write_collated(df, path, "uid", collation, 8)
    for start, end in ((None, None), ("K050", "k100"), ("k050", None), (None, "é"), ("zz", None), ("x", "y")):
        got = readers.read_collated_range(spark, path, start, end)
        want = paging.id_range(df, "uid", start, end, collation)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = readers.read_collated_range(spark, path, "K050", "k100")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key_slice" in plan and "LessThanOrEqual(key_slice" in plan
