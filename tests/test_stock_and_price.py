from __future__ import annotations

import datetime as dt

from conftest import by, day, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ripecast.operators import pricing, replenish

SCHEMA = ("product_id string, product_name string, date date, predicted_quantity bigint, shelf_life_days int, "
          "current_stock bigint, base_price double")


def forecast_days(spark, products):
    """products: {id: (quantities, shelf life, stock, price)}"""
    data = [
        (p, f"n{p}", day("2024-01-01") + dt.timedelta(i), q, shelf, stock, price)
        for p, (quantities, shelf, stock, price) in products.items() for i, q in enumerate(quantities)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_stock_may_go_negative_and_is_marked(spark):
    got = sorted(rows(replenish.stock_projection(forecast_days(spark, {"A": ([20, 0, 60], 7, 50, 1.0)}))),
                 key=lambda r: r["date"])
    assert [(r["projected_inventory"], r["at_reorder_level"], r["out_of_stock"]) for r in got] == [
        (30, 1, 0), (30, 1, 0), (-30, 1, 1)]


def test_reorder_plan_leaves_out_products_that_last(spark):
    days = forecast_days(spark, {"A": ([1] * 5, 7, 300, 1.0), "B": ([5, 5, 5], 6, 55, 1.0), "C": ([5, 5, 5], 11, 41, 1.0)})
    plan = by(replenish.reorder_plan(days), "product_id")
    assert set(plan) == {"B", "C"}
    assert plan["B"] == {"product_id": "B", "product_name": "nB", "suggested_reorder_date": "2024-01-02",
                         "suggested_quantity": 112, "current_stock": 55, "reorder_level": 45.0, "shelf_life_days": 6}
    assert (plan["C"]["suggested_reorder_date"], plan["C"]["suggested_quantity"]) == ("2024-01-03", 60)
    status = by(replenish.reorder_status(days), "product_id")
    assert status["A"]["suggested_reorder_date"] is None and status["A"]["suggested_quantity"] is None
    assert {p: r for p, r in status.items() if p != "A"} == plan


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.integers(0, 40), min_size=1, max_size=12), st.integers(1, 15),
                          st.integers(0, 200)), min_size=1, max_size=6), st.integers(1, 80))
def test_reorder_date_is_the_first_crossing(spark, cases, level):
    products = {f"P{i}": (q, shelf, stock, 1.0) for i, (q, shelf, stock) in enumerate(cases)}
    days = forecast_days(spark, products).repartition(3)
    plan = by(replenish.reorder_plan(days, level), "product_id")
    for p, (quantities, shelf, stock, _) in products.items():
        limit = level if shelf > 10 else level * 1.5
        due = None
        for i, q in enumerate(quantities):
            stock -= q
            if stock <= limit and due is None:
                due = (day("2024-01-01") + dt.timedelta(i)).isoformat()
        assert (plan[p]["suggested_reorder_date"] if p in plan else None) == due
        if due:
            assert plan[p]["suggested_quantity"] == int(limit * (2.5 if shelf < 7 else 2))


def test_price_suggestions(spark):
    days = forecast_days(spark, {
        "A": ([9, 9], 5, 0, 100.0), "B": ([10, 10], 5, 0, 100.0), "C": ([14, 15], 10, 0, 200.0),
        "D": ([26, 25], 11, 0, 50.0), "E": ([25, 25], 11, 0, 50.0), "F": ([1], 3, 0, 0.0),
    })
    got = by(pricing.suggest(days), "product_id")
    assert {p: (r["suggested_price"], r["pricing_strategy"]) for p, r in got.items()} == {
        "A": (80.0, "Discount"), "B": (100.0, "Standard"), "C": (180.0, "Discount"),
        "D": (50.0 * 1.1, "Premium"), "E": (50.0, "Standard"), "F": (0.0, "Standard"),
    }
    changes = by(pricing.change(pricing.suggest(days)), "product_id")
    assert changes["A"]["price_diff"] == -20.0 and changes["A"]["price_change_pct"] == -20.0
    assert changes["F"]["price_change_pct"] is None
    text = by(pricing.change_labels(pricing.change(pricing.suggest(days))), "product_id")
    assert text["A"] == {"product_id": "A", "current_price": "XOF100.00", "suggested_price": "XOF80.00",
                         "price_diff": "XOF-20.00", "price_change_pct": "-20.0%"}
    assert text["D"]["price_diff"] == "+XOF5.00" and text["B"]["price_change_pct"] == "+0.0%"
    long = rows(pricing.comparison(pricing.suggest(days)))
    assert len(long) == 12 and {r["metric"] for r in long} == {"Prix Actuel", "Prix Suggéré"}
