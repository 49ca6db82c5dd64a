"""What the physical plans may and may not contain."""

from __future__ import annotations

import os
import re

import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from ripecast.plans import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")

# Others run jobs and Python while they are built.
LAZY = sorted(set(oracle.statements()) - {
    "csv_roundtrip", "label_encode", "feature_matrix", "trend_save_load", "linear_certificate", "save_load_certificate",
    "forest_trees", "forecast_rf", "eval_rf", "forest_save_load", "forecast_linear", "eval_linear", "snapshot_roundtrip", "rejected_rows", "stored_reorder_plan"})


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_and_no_forced_broadcast(spark, no_broadcast, name):
    plan = plan_of(contract.queries()[name](spark, TESTDATA))
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "BroadcastHashJoin", "Python", "Arrow", "Pandas"):
        assert unwanted not in plan


def test_reorder_plan_shuffles_each_table_by_product_once(spark, no_broadcast):
    plan = plan_of(contract.queries()["reorder_plan"](spark, TESTDATA))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    columns = sorted(re.sub(r"#\d+L?|, \d+$", "", e) for e in exchanges)
    # Sales by (product, day); then days, products and stock by product. Window and plan reuse that.
    assert columns == ["product_key", "product_key", "product_key", "product_key, date"]


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(contract.queries()["kpi_avg_daily_sales"](spark, TESTDATA))
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>", plan)


def test_filters_reach_the_scan(spark):
    dated = plan_of(contract.queries()["filter_date_range"](spark, TESTDATA))
    assert "GreaterThanOrEqual(l_shipdate" in dated and "LessThan(l_shipdate" in dated
    one = plan_of(contract.queries()["filter_product_id"](spark, TESTDATA))
    assert "EqualTo(l_partkey,42)" in one
    named = plan_of(contract.queries()["filter_product_name"](spark, TESTDATA))
    assert "EqualTo(p_name,red widget)" in named


@pytest.mark.parametrize("name", ["stock_latest", "product_first_attrs", "category_metrics", "reorder_plan"])
def test_row_level_aggregates_hash(spark, name):
    """No sort of the input rows: any sort aggregate sits above the first shuffle."""
    plan = plan_of(contract.queries()[name](spark, TESTDATA))
    below_scan_exchange = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "SortAggregate" not in below_scan_exchange


def test_calendar_has_no_row_per_product_and_day(spark, no_broadcast):
    plan = plan_of(contract.queries()["calendar_spine"](spark, TESTDATA))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # Sales by (product, month), and the spine's months to them.
    assert len(exchanges) == 2 and all("date" not in e for e in exchanges)
    assert "interval 1 day" not in plan.lower()


def test_months_count_the_days_of_the_calendar(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from ripecast.operators import products
    one = spark.sql("SELECT 'A' AS product_id")
    for start, end in (((2023, 1, 31), (2024, 3, 1)), ((1969, 11, 15), (1970, 1, 5)), ((2024, 2, 29), (2024, 2, 29))):
        start, end = dt.date(*start), dt.date(*end)
        want = products.calendar_spine(one, start, end).groupBy(F.trunc("date", "month").alias("month"), "season").agg(
            F.count("*").alias("n_days"), F.sum("is_weekend").alias("n_weekend_days"))
        columns = ["month", "season", "n_days", "n_weekend_days"]
        got = products.calendar_months(one, start, end)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
