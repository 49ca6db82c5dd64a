from __future__ import annotations

import datetime as dt

import pytest
from conftest import day
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripecast.functions import calendar, labels, numeric, policy


def evaluate(spark, values, schema, **columns):
    df = spark.createDataFrame(values, schema)
    return [r.asDict() for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_half_even_and_truncate(spark):
    got = evaluate(spark, [(0.5,), (1.5,), (2.5,), (-0.5,), (112.5,), (2.9,)], "x double",
                   even=numeric.half_even(F.col("x")), cut=numeric.truncate(F.col("x")))
    assert [g["even"] for g in got] == [round(x) for x in (0.5, 1.5, 2.5, -0.5, 112.5, 2.9)]
    assert [g["cut"] for g in got] == [0, 1, 2, 0, 112, 2]


def test_ratio_of_zero_is_null(spark):
    got = evaluate(spark, [(1, 0), (0, 0), (1, 4)], "a int, b int", r=numeric.ratio(F.col("a"), F.col("b")))
    assert [g["r"] for g in got] == [None, None, 0.25]


def test_row_order_sorts_by_day_then_tie(spark):
    got = evaluate(
        spark, [(day("1969-12-31"), 5), (day("1970-01-01"), 0), (day("2024-02-29"), 2**46 - 1), (day("2024-03-01"), 0)],
        "d date, t bigint", o=numeric.row_order(F.col("d"), F.col("t")),
    )
    orders = [g["o"] for g in got]
    assert orders == sorted(orders) and len(set(orders)) == 4


def test_calendar_over_two_years(spark):
    days = [(dt.date(2023, 1, 1) + dt.timedelta(i),) for i in range(731)]
    d = F.col("d")
    got = evaluate(spark, days, "d date", d=d, iso=calendar.iso(d), weekend=calendar.is_weekend(d),
                   season=calendar.climate_season(d), **calendar.date_parts(d), **calendar.season_flags(d))
    for g in got:
        x = g["d"]
        assert g["iso"] == x.isoformat()
        assert (g["year"], g["month"], g["day"]) == (x.year, x.month, x.day)
        assert g["day_of_week"] == x.weekday() and g["weekend"] == (x.weekday() in (5, 6))
        assert g["day_of_year"] == x.timetuple().tm_yday and g["quarter"] == (x.month + 2) // 3
        assert [g["is_winter"], g["is_spring"], g["is_summer"], g["is_fall"]] == [
            x.month in m for m in ((12, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11))
        ]
        assert g["season"] == ("Saison des Pluies" if x.month in range(5, 11) else "Saison Sèche")


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e9, 1e9).map(lambda x: x + 0.0), min_size=1, max_size=30))
def test_labels_round_like_python(spark, values):
    x = F.col("x")
    got = evaluate(spark, [(v,) for v in [*values, 0.15, 0.25, 0.35, 2.5]], "x double", x=x,
                   one=labels.fixed(x, 1), money=labels.money_grouped(x), sign=labels.signed_money(x))
    for g in got:
        v = g["x"]
        plain = f"{v:.1f}"
        assert g["one"] == plain or float(plain) == 0
        if abs(v) >= 0.005:
            assert g["money"] == f"XOF{v:,.2f}"
            assert g["sign"] == ("+" if v >= 0 else "") + f"XOF{v:.2f}"


@pytest.mark.parametrize("shelf,level,quantity", [(6, 45.0, 112), (7, 45.0, 90), (10, 45.0, 90), (11, 30.0, 60)])
def test_reorder_rules_at_their_boundaries(spark, shelf, level, quantity):
    adjusted = policy.adjusted_reorder_level(F.lit(30), F.col("s"))
    got, = evaluate(spark, [(shelf,)], "s int", level=adjusted, q=policy.order_quantity(adjusted, F.col("s")))
    assert (got["level"], got["q"]) == (level, quantity)


@pytest.mark.parametrize("shelf,demand,factor", [
    (5, 9.99, 0.8), (5, 10.0, 1.0), (5, 30.0, 1.0), (6, 14.99, 0.9), (6, 15.0, 1.0), (10, 14.0, 0.9),
    (10, 30.0, 1.0), (11, 25.0, 1.0), (11, 25.01, 1.1), (11, 1.0, 1.0),
])
def test_price_rules_at_their_boundaries(spark, shelf, demand, factor):
    got, = evaluate(spark, [(shelf, demand)], "s int, d double", f=policy.price_factor(F.col("s"), F.col("d")))
    assert got["f"] == factor


def test_interval_rounds_the_raw_prediction_and_clamps_only_below(spark):
    got = evaluate(spark, [(-10.0, 5), (10.0, 6), (10.0, 7), (2.5, 7), (0.5, 7)], "p double, s int",
                   **policy.interval(F.col("p"), F.col("s")))
    assert [tuple(g.values()) for g in got] == [(0, 0, -13), (10, 7, 13), (10, 8, 12), (2, 2, 3), (0, 0, 1)]
