"""Distinct counts from sketches: merged days against the whole, errors, odd rows."""

from __future__ import annotations

import pytest
from conftest import by, sale
from pyspark.sql import functions as F

from ripecast.operators import kpis, sketches


@pytest.fixture(scope="module")
def many(spark):
    """60,000 products over 20 days and two categories; a third of all rows sells one product."""
    return spark.range(180_000).selectExpr(
        "date_add(DATE'2024-01-01', CAST(id % 20 AS INT)) AS date", "if(id % 3 = 0, 'P0', concat('P', id % 60000)) AS product_id",
        "if(id % 7 < 3, 'Fruits', 'Légumes') AS category")


def estimate(df, *keys):
    return {tuple(r[k] for k in keys): r["approx_distinct"] for r in sketches.estimated(df).collect()}


@pytest.mark.parametrize("lg_k", [8, 12, 16])
def test_errors_are_bounded(many, lg_k):
    got = estimate(sketches.merged(sketches.by_day(many, lg_k=lg_k), "category"), "category")
    want = {(r.category,): r.n for r in many.groupBy("category").agg(F.countDistinct("product_id").alias("n")).collect()}
    assert set(got) == set(want)
    for k, n in want.items():
        assert abs(got[k] - n) <= sketches.bound(lg_k) * n


def test_merged_days_equal_the_whole(many):
    """However days are grouped on the way, and within both bounds of the sketch of all rows at once."""
    days = sketches.by_day(many).withColumn("all", F.lit(True)).cache()
    at_once = estimate(sketches.merged(days, "all"), "all")
    for first in ("category", "date"):
        assert estimate(sketches.merged(sketches.merged(days, first, "all"), "all"), "all") == at_once
    whole = many.withColumn("date", F.lit("2024-01-01").cast("date")).withColumn("category", F.lit("x"))
    direct = estimate(sketches.by_day(whole), "category")
    assert direct[("x",)] == pytest.approx(at_once[(True,)], rel=2 * sketches.bound())


def test_small_groups_are_exact_and_odd_rows_left_out(make_sales):
    rows = [sale("2024-01-01", "A"), sale("2024-01-02", "A"), sale("2024-01-02", "B"), sale("2024-01-02", "C", category=None)]
    sales = make_sales(rows)
    got = by(sketches.estimated(sketches.merged(sketches.by_day(sales), "category")), "category")
    assert {k: r["approx_distinct"] for k, r in got.items()} == {"Fruits": 2}
    assert sketches.by_day(make_sales([])).count() == 0
    everything = sketches.estimated(sketches.merged(sketches.by_day(sales, by=()), "date"))
    assert {str(r["date"]): r["approx_distinct"] for r in everything.collect()} == {"2024-01-01": 1, "2024-01-02": 3}
    with pytest.raises(ValueError):
        sketches.by_day(sales, lg_k=3)


def test_overview_may_estimate(many, make_sales):
    sales = make_sales([sale("2024-01-01", p) for p in "ABCA"])
    assert kpis.overview(sales, approximate=True).first()["total_products"] == 3
