"""Every query of the catalogue: the same rows as its check, and a plan that scales."""

import glob
import os
import re

import check
import pytest

import __spark_entry__ as entry
from revsync.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))
NAMES = sorted(catalog.queries())
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


def test_every_query_has_a_check():
    assert set(catalog.checks()) == set(NAMES)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_the_check(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name) is None


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket_start", "bucket_end", "currency", "amount_minor", "payment_count"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    if name.startswith("stream_") or name in ("incremental_load", "fallback_full", *LANDS):
        pytest.skip("runs jobs of its own")
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in plan, f"{bad} in\n{plan}"
    # Only report limits and global aggregates end in one task, with partial results from others.
    for line in plan.splitlines():
        if "SinglePartition" in line:
            assert name in ONE_ROW, plan


@needs_data
@pytest.mark.parametrize("name", ["sync_status", "consecutive_failures", "list_sync_status", "revenue_report_nested"])
def test_reports_read_their_table_once(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1, plan
    assert "Join" not in plan or name == "revenue_report_nested"


RANGED = sorted(n for n in NAMES if n.startswith(("revenue_", "unknown_status")) or n == "range_filter")


@needs_data
@pytest.mark.parametrize("name", RANGED)
def test_a_range_reaches_the_scan(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    column = "l_shipdate" if name.endswith("_years") else "ts"
    pushed = plan.split("PushedFilters: [")[1]
    assert f"GreaterThanOrEqual({column}," in pushed and f"LessThan({column}," in pushed, plan


LANDS = ("watermark_filter", "incremental_order", "last_row_watermark")
ONE_ROW = {"max_watermark"}


def sources():
    """The library's own, without optional parts."""
    found = glob.glob(f"{ROOT}/revsync/**/*.py", recursive=True)
    return [p for p in found if "/llm/" not in p]


def code(path):
    with open(path) as f:
        text = f.read()
    return re.sub(r'"""[\s\S]*?"""', "", text)


def test_only_revenue_knows_what_counts():
    """One definition of collected revenue, and one place that adds up amounts by status."""
    users = [p for p in sources() if "REVENUE_COLLECTED_STATUSES" in code(p)]
    assert [os.path.relpath(p, ROOT) for p in users] == ["revsync/operators/revenue.py"]


def test_operators_run_no_jobs_and_force_no_broadcast():
    for path in sources():
        text = code(path)
        assert "broadcast(" not in text, path
        assert "localCheckpoint" not in text and ".cache()" not in text, path
        assert "crossJoin" not in text and "toPandas" not in text, path
        if "/operators/" in path or "/functions/" in path:
            assert not re.search(r"\.(collect|count|first|take|toLocalIterator)\(\)", text), path
