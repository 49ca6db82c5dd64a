"""The stored forecast: updates equal a full build, and the four reports read it instead of fitting."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows

from ripecast.operators import forecast, products, replenish
from ripecast.plans.forecast_store import ForecastStore
from ripecast.sources import snapshots


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(3)
    data = [(f"P{p}", dt.date(2024, 1, 1) + dt.timedelta(i), rng.randint(0, 40) + p) for p in range(8) for i in range(60) if rng.random() < 0.5]
    return spark.createDataFrame(data, "product_id string, date date, quantity_sold bigint").cache()


@pytest.fixture(scope="module")
def profile(spark):
    return spark.range(8).selectExpr("concat('P', id) AS product_id", "concat('n', id) AS product_name",
                                     "CAST(3 + id AS INT) AS shelf_life_days", "CAST(10 + id AS DOUBLE) AS base_price")


def everything(store, stock=None):
    return [sorted(map(str, rows(df))) for df in (
        store.forecast(), store.stock_projection(stock), store.reorder_plan(stock), store.prices())]


def test_updates_equal_a_full_build(spark, days, profile, tmp_path):
    stock = spark.createDataFrame([("P1", 500), ("P2", 60)], "product_id string, current_stock bigint")
    full, grown = (ForecastStore(spark, str(tmp_path / n)) for n in ("full", "grown"))
    full.build(days, profile)
    cut = "DATE'2024-02-10'"
    grown.build(days.filter(f"date < {cut} AND product_id <> 'P7'"), profile)
    some = days.filter(f"date >= {cut} AND product_id IN ('P0', 'P1', 'P7') OR product_id = 'P7'").dropDuplicates()
    grown.update(some, profile)
    assert everything(grown) != everything(full)
    grown.update(days.filter(f"date >= {cut} AND product_id NOT IN ('P0', 'P1', 'P7')"), profile)
    assert everything(grown, stock) == everything(full, stock)
    assert snapshots.versions(spark, grown.root) == [1, 2, 3]
    direct = forecast.trend_days(days, profile)
    assert sorted(map(str, rows(forecast.contract(direct)))) == everything(full)[0]
    assert sorted(map(str, rows(replenish.reorder_plan(products.with_stock(direct, stock))))) == everything(full, stock)[2]


def test_late_sales_are_summed_again(spark, days, profile, tmp_path):
    late = days.filter("product_id = 'P3'").limit(1)
    day = late.first().date
    before = days.filter(f"NOT (product_id = 'P3' AND date = DATE'{day}')")
    store, full = (ForecastStore(spark, str(tmp_path / n)) for n in ("late", "full"))
    store.build(before, profile)
    with pytest.raises(ValueError, match="already summed"):
        store.update(late, profile)
    assert snapshots.versions(spark, store.root) == [1]
    store.update(late, profile, days)
    full.build(days, profile)
    assert everything(store) == everything(full)


def test_reports_read_one_stored_forecast(spark, days, profile, tmp_path):
    store = ForecastStore(spark, str(tmp_path / "store"))
    store.build(days, profile)
    for report in (store.forecast(), store.stock_projection(), store.reorder_plan(), store.prices()):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert "/forecast" in str(report.inputFiles()) and "quantity_sold" not in plan
    with pytest.raises(ValueError, match="30 days are stored"):
        store.prices(31)


def test_nothing_new_and_nothing_at_all(spark, days, profile, tmp_path):
    store = ForecastStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no finished version"):
        store.forecast()
    store.build(days.limit(0), profile)
    assert everything(store) == [[], [], [], []]
    store.update(days, profile)
    want = everything(store)
    store.update(days.limit(0), profile)
    assert everything(store) == want


def test_many_stored_days_are_dealt_by_their_number(spark, days, profile, tmp_path, monkeypatch):
    """Few bytes may hold many days: a task's share follows the rows, and reports stay the same."""
    from ripecast.plans import forecast_store

    stock = spark.createDataFrame([("P1", 500), ("P2", 60)], "product_id string, current_stock bigint")
    store = ForecastStore(spark, str(tmp_path / "dealt"))
    store.build(days, profile)
    want = everything(store, stock)
    assert snapshots.n_rows(spark, store.root, "forecast") == len(want[0]) == 240
    monkeypatch.setattr(forecast_store, "TASK_ROWS", 30)
    assert everything(store, stock) == want and everything(store, None)[0] == want[0]
    plan = store.reorder_plan(stock)
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString() and plan.rdd.getNumPartitions() >= 8
