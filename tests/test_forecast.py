from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import by, day, rows, sale
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripecast.operators import demand, evaluate, features, forecast, linear, products, trend

START = day("2024-01-01")


def daily_frame(spark, series):
    """series: {product: [(offset, quantity)]}"""
    data = [(p, START + dt.timedelta(o), q) for p, points in series.items() for o, q in points]
    return spark.createDataFrame(data, "product_id string, date date, quantity_sold bigint")


def product_frame(spark, ids, shelf=7):
    return spark.createDataFrame(
        [(i, f"n{i}", "c", shelf, 10.0, 10.0) for i in ids],
        "product_id string, product_name string, category string, shelf_life_days int, "
        "base_price double, mean_price double",
    )


def test_daily_adds_rows_of_one_day(make_sales):
    sales = make_sales([sale("2024-01-01", quantity=2, price="10.00", order=i) for i in range(3)]
                       + [sale("2024-01-01", quantity=1, price="30.00", order=9)])
    got, = rows(demand.product_daily(sales))
    assert got["quantity_sold"] == 7 and got["unit_price"] == 15.0


def test_trend_equals_brute_force(spark):
    rng = random.Random(3)
    series = {f"P{i}": [(o, rng.randint(0, 60)) for o in sorted(rng.sample(range(400), rng.randint(2, 40)))]
              for i in range(40)}
    got = by(trend.fit(daily_frame(spark, series)), "product_id")
    for p, points in series.items():
        x0 = points[0][0]
        slope, intercept = np.polyfit([o - x0 for o, _ in points], [q for _, q in points], 1)
        assert math.isclose(got[p]["slope"], slope, rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(got[p]["intercept"], intercept, rel_tol=1e-7, abs_tol=1e-7)
        assert got[p]["last_date"] == START + dt.timedelta(points[-1][0])


def test_trend_is_bitwise_independent_of_partitioning(spark):
    rng = random.Random(5)
    df = daily_frame(spark, {f"P{i}": [(o, rng.randint(0, 10**6)) for o in range(50)] for i in range(10)})
    assert by(trend.fit(df.repartition(13)), "product_id") == by(trend.fit(df.coalesce(1)), "product_id")


def test_trend_of_a_best_seller_does_not_overflow(spark):
    big = 3 * 10**12
    got, = rows(trend.fit(daily_frame(spark, {"A": [(o, big + o) for o in range(3000)]})))
    assert got["slope"] == 1.0 and math.isclose(got["intercept"], big, rel_tol=1e-12)


def test_single_day_and_empty_products(spark):
    df = daily_frame(spark, {"A": [(3, 8)]})
    got, = rows(trend.fit(df))
    assert (got["slope"], got["intercept"], got["n_days"]) == (0.0, 8.0, 1)
    held_out = demand.split(df)
    got, = rows(trend.fit(held_out, train_flag=F.col("is_test") == 0))
    assert (got["slope"], got["intercept"], got["n_days"]) == (0.0, 8.0, 0)
    assert rows(forecast.trend_days(df.filter("false"), product_frame(spark, ["A"]))) == []


def test_falling_trend_clamps_as_specified(spark):
    df = daily_frame(spark, {"A": [(0, 30), (1, 20), (2, 10)]})
    got = rows(forecast.contract(forecast.trend_days(df, product_frame(spark, ["A"], 5), 3)))
    assert [(r["date"], r["predicted_quantity"], r["confidence_interval_lower"], r["confidence_interval_upper"])
            for r in sorted(got, key=lambda r: r["date"])] == [
        ("2024-01-04", 0, 0, 0), ("2024-01-05", 0, 0, -13), ("2024-01-06", 0, 0, -26),
    ]


def test_intervals_bracket_the_forecast(spark):
    df = daily_frame(spark, {f"P{i}": [(0, i), (9, 2 * i)] for i in range(20)})
    for r in rows(forecast.trend_days(df, product_frame(spark, [f"P{i}" for i in range(20)]), 20)):
        assert r["confidence_interval_lower"] <= r["predicted_quantity"] <= r["confidence_interval_upper"]


def test_horizon_and_fit_arguments(spark):
    df, known = daily_frame(spark, {"A": [(0, 1)]}), product_frame(spark, ["A"])
    assert forecast.trend_days(df, known, 90).count() == 90
    with pytest.raises(ValueError, match="days_ahead"):
        forecast.trend_days(df, known, 0)
    with pytest.raises(ValueError, match="fit_on"):
        forecast.trend_days(df, known, fit_on="test")


def test_future_frame_follows_the_last_sale(make_sales):
    sales = make_sales([sale("2024-02-27", price="10.00"), sale("2024-02-28", price="13.00")])
    got = sorted(rows(forecast.future_frame(products.profile(sales), 3)), key=lambda r: r["date"])
    assert [(r["date"], r["unit_price"], r["is_winter"], r["is_spring"], r["is_weekend"]) for r in got] == [
        ("2024-02-29", 11.5, 1, 0, 0), ("2024-03-01", 11.5, 0, 1, 0), ("2024-03-02", 11.5, 0, 1, 1),
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_split_holds_out_a_fifth_of_each_product(spark, sizes):
    df = daily_frame(spark, {f"P{i}": [(o, 1) for o in range(n)] for i, n in enumerate(sizes)})
    got = by(demand.split(df).groupBy("product_id").agg(F.sum("is_test").alias("t")), "product_id")
    assert [got[f"P{i}"]["t"] for i in range(len(sizes))] == [math.ceil(n / 5) for n in sizes]
    again = demand.split(df.repartition(5))
    assert sorted(map(str, demand.split(df).collect())) == sorted(map(str, again.collect()))


def test_season_adjustment(spark):
    df = daily_frame(spark, {"A": [(0, 13), (125, 13), (125 + 1, 13)]})  # Monday dry, Sunday wet, Monday wet
    got = sorted(rows(demand.season_adjusted(df)), key=lambda r: r["date"])
    assert [r["demand_factor"] for r in got] == [1.0, 1.3 * 1.25, 1.3]
    with_factor = df.withColumn("f", F.lit(2.0))
    assert rows(demand.season_adjusted(with_factor, "f").filter("date = '2024-01-01'"))[0]["adjusted_quantity"] == 6.5


def test_label_codes_rank_distinct_values(spark):
    rng = random.Random(1)
    ids = [f"P{rng.randint(0, 10**6)}" for _ in range(700)]
    ids += ["hot"] * 350 + [None, "é", "Z", "a"]
    df = spark.createDataFrame([(i, f"n{k % 30}", "c") for k, i in enumerate(ids)],
                               "product_id string, product_name string, category string").repartition(6)
    got = {(r["column_name"], r["value"]): r["code"] for r in rows(features.label_codes(df))}
    want = sorted({i for i in ids if i is not None}, key=lambda s: s.encode())
    assert [got["product_id", v] for v in want] == list(range(len(want)))
    names = sorted({f"n{k % 30}" for k in range(len(ids))})
    assert [got["product_name", v] for v in names] == list(range(30))
    assert got["category", "c"] == 0 and len(got) == len(want) + 31


def test_unseen_labels_get_a_code_of_their_own(spark):
    schema = "product_id string, product_name string, category string"
    codes = features.label_codes(spark.createDataFrame([("a", "n", "c"), ("b", "n", "c")], schema))
    got = by(features.encode(spark.createDataFrame([("b", "n", "x"), ("z", "n", "c")], schema), codes), "product_id")
    assert got["b"]["product_id_encoded"] == 1.0 and got["z"]["product_id_encoded"] == 2.0
    assert got["b"]["category_encoded"] == 1.0 and got["z"]["category_encoded"] == 0.0


def brute_force_linear(points, price, shelf):
    """Rows of features and target, centred, solved by numpy's minimum-norm least squares."""
    matrix = []
    for o, q in points:
        d = START + dt.timedelta(o)
        m = d.month
        matrix.append([price(o), m, d.day, d.weekday(), (m + 2) // 3, d.timetuple().tm_yday, d.weekday() > 4,
                       m in (6, 7, 8), m in (12, 1, 2), m in (3, 4, 5), m in (9, 10, 11), shelf, q])
    a = np.array(matrix, dtype=float)
    mean = a.mean(axis=0)
    solution = np.linalg.lstsq((a - mean)[:, :-1], (a - mean)[:, -1], rcond=1e-9)[0]
    return solution, mean[-1] - mean[:-1] @ solution


def test_linear_equals_brute_force(spark):
    rng = random.Random(11)
    series, price = {}, {}
    for i in range(30):
        n = rng.choice([1, 2, 3, 8, 60, 300])
        series[f"P{i}"] = [(o, rng.randint(0, 50)) for o in sorted(rng.sample(range(900), n))]
        step = rng.choice([0, 1])
        price[f"P{i}"] = lambda o, s=step: 1234567.89 + s * (o % 7)
    data = [(p, START + dt.timedelta(o), q, float(price[p](o))) for p, pts in series.items() for o, q in pts]
    df = spark.createDataFrame(data, "product_id string, date date, quantity_sold bigint, unit_price double")
    got = by(linear.fit(df.repartition(5), product_frame(spark, list(series))), "product_id")
    for p, points in series.items():
        solution, intercept = brute_force_linear(points, price[p], 7)
        assert np.allclose(got[p]["coefficients"], solution, rtol=1e-5, atol=1e-6)
        assert math.isclose(got[p]["intercept"], intercept, rel_tol=1e-5, abs_tol=1e-2 + 1.3 * abs(solution[0]))


def test_linear_solves_blocks_of_products_as_it_solves_one(spark, monkeypatch):
    """Days that cross Arrow batches and blocks of products: the same answers, to the last bit, and missing prices as before."""
    series = {f"P{i:02d}": [(o, (7 * o + i) % 31) for o in range(i, 200, 3 + i % 5)] for i in range(40)}
    data = [(p, START + dt.timedelta(o), q, None if p == "P07" or o % 11 == 0 else float(10 + o % 4)) for p, pts in series.items() for o, q in pts]
    df = spark.createDataFrame(data, "product_id string, date date, quantity_sold bigint, unit_price double")
    flag = (F.dayofmonth("date") % 3 > 0) & (F.col("product_id") != "P05")
    fitted = lambda: by(linear.fit(df, product_frame(spark, list(series)), train_flag=flag), "product_id")
    want = fitted()
    assert len(want) == 40 and want["P05"]["n_days"] == 0 and want["P07"]["intercept"] is None and want["P06"]["intercept"] is not None
    monkeypatch.setattr(linear, "BLOCK_ROWS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert fitted() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sums = [np.array([[5.0, 6.0]]).T @ np.ones((1, k)) for k in (1, 1, linear.SIZE, linear.SIZE, linear.SIZE * (linear.SIZE + 1) // 2, 1)]
    assert linear.solve(*(x[:, 0] if x.shape[1] == 1 else x for x in sums))[0].shape == (2, linear.SIZE)


def test_metrics_against_brute_force(spark):
    pairs = [(3.0, 2.0), (0.0, 1.0), (5.0, 5.5), (8.0, 7.0)]
    got, = rows(evaluate.metrics(spark.createDataFrame(pairs, "actual double, predicted double")))
    a, p = np.array(pairs).T
    assert got["n"] == 4 and got["n_zero_actual"] == 1
    assert got["mae"] == pytest.approx(np.abs(a - p).mean()) and got["mse"] == pytest.approx(((a - p) ** 2).mean())
    assert got["rmse"] == pytest.approx(math.sqrt(((a - p) ** 2).mean()), abs=1e-6)
    assert got["r2"] == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum(), abs=1e-6)
    kept = a != 0
    assert got["mape"] == pytest.approx(np.abs((a - p)[kept] / a[kept]).mean() * 100, abs=1e-6)


@pytest.mark.parametrize("pairs,r2", [([(2.0, 2.0), (2.0, 2.0)], 1.0), ([(2.0, 1.0), (2.0, 2.0)], 0.0), ([(2.0, 1.0)], None)])
def test_r2_of_constant_actuals(spark, pairs, r2):
    got, = rows(evaluate.metrics(spark.createDataFrame(pairs, "actual double, predicted double")))
    assert got["r2"] == r2


def test_summary_and_series(make_sales, spark):
    df = daily_frame(spark, {"A": [(0, 10), (1, 10)]})
    coming = forecast.contract(forecast.trend_days(df, product_frame(spark, ["A"], 8), 4))
    got, = rows(forecast.summary(coming))
    assert (got["total_predicted"], got["avg_per_day"], got["avg_confidence"]) == (40, 10.0, 2.0)
    assert rows(forecast.summary_labels(forecast.summary(coming)))[0] == {
        "product_id": "A", "total_predicted": "40", "avg_per_day": "10.0", "avg_confidence": "±2.0"}
    both = rows(forecast.history_plus_forecast(make_sales([sale("2024-01-02", quantity=10)]), coming))
    assert len(both) == 5 and {r["series"] for r in both} == {"Ventes Historiques", "Prévision"}
    assert all((r["lower"] is None) == (r["series"] == "Ventes Historiques") for r in both)
