"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in compare.TABLES:
        path = FOLDER / f"{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_agrees_with_sql(spark, database, name):
    assert compare.compare(spark, database, str(FOLDER), name) is None


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


# One row or one small page of output; every other query must have no one-task step.
REPORTS = {
    "export_first_rows",
    "lines_without_recipient_count",
    "page_slice",
    "products_first_page",
}


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_plan_has_no_cross_join_no_python_and_no_one_task_step(spark, name):
    df = entry.queries()[name](spark, str(FOLDER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert bad not in plan
    assert ("SinglePartition" in plan) <= (name in REPORTS)


# How often a plan may read a table file, and how often the line items.
SCANS = {
    "recon_full": (6, 0),
    "recon_full_null_rejecting": (4, 0),
    "customers_cleaned": (2, 0),
    "flow_create_orders": (3, 1),
    "flow_create_rejects": (0, 0),
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_tables_are_not_read_more_often_than_needed(spark, name):
    df = entry.queries()[name](spark, str(FOLDER))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= SCANS[name][0]
    assert plan.count("lineitem.parquet") <= SCANS[name][1]


# Jobs while a plan is built: reading a table's schema is one each, and nothing else runs here.
JOBS = {"customers_cleaned": 1, "points_plan": 3, "recon_full": 2, "platform_ids_written_back": 2}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_building_a_plan_runs_no_job_on_the_data(spark, name):
    group = f"plan of {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        entry.queries()[name](spark, str(FOLDER))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) <= JOBS[name]


REASONS = {
    "flow_create_rejects": ("reason", {"no_lines", "bad_amount"}),
    "flow_sync_rejects": ("reason", {"no_lines", "no_platform_id", "unknown_status"}),
}


@pytest.mark.parametrize("name", sorted(REASONS))
def test_every_reason_occurs(spark, name):
    column, expected = REASONS[name]
    found = entry.queries()[name](spark, str(FOLDER)).select(column).distinct().collect()
    assert {r[0] for r in found} == expected
