from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from conftest import by, rows, sale
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ripecast.operators import demand, evaluate, pooled, products
from ripecast.plans.model import DemandModel, trained_and_reloaded


@pytest.fixture(scope="module")
def seasonal(make_sales):
    """Two years for four products, each with weekend peaks and its own level."""
    rng = random.Random(2)
    data = []
    for p in range(4):
        for i in range(0, 730, 2):
            d = dt.date(2023, 1, 1) + dt.timedelta(i)
            q = (20 + 10 * p) * (1.6 if d.weekday() >= 5 else 1) * (1.4 if 5 <= d.month <= 10 else 1) + rng.gauss(0, 1)
            data.append(sale(d.isoformat(), f"P{p}", f"n{p}", "c", max(0, int(q)), shelf=4 + 3 * p))
    return make_sales(data).cache()


def mean_error(model_metrics):
    return rows(model_metrics)[0]["mae"]


def test_learned_models_beat_the_product_mean(seasonal, spark):
    daily = demand.split(demand.product_daily(seasonal))
    means = pooled.product_level(daily.filter("is_test = 0"), "product_id")
    pairs = daily.filter("is_test = 1").join(means, "product_id").selectExpr(
        "quantity_sold AS actual", f"{pooled.LEVEL} AS predicted")
    baseline = mean_error(evaluate.metrics(pairs))
    forest = mean_error(DemandModel("random_forest", trees=10).train(seasonal).metrics())
    line = mean_error(DemandModel("linear_regression").train(seasonal).metrics())
    assert forest < 0.5 * baseline and line < 0.8 * baseline


@pytest.mark.parametrize("model_type", ["trend", "linear_regression", "random_forest", "pooled_linear_regression"])
def test_save_and_load_predict_alike(seasonal, spark, tmp_path, model_type):
    model = DemandModel(model_type, trees=3).train(seasonal)
    path = str(tmp_path / "model")
    model.save(path)
    loaded = DemandModel.load(spark, path)
    want = sorted(map(str, model.forecast_demand(seasonal, days_ahead=9).collect()))
    assert len(want) == 36
    assert sorted(map(str, loaded.forecast_demand(seasonal, days_ahead=9).collect())) == want
    assert sorted(map(str, loaded.forecast_demand(days_ahead=9).collect())) == want
    assert rows(loaded.metrics()) == rows(model.metrics())
    assert by(loaded.metrics("product_id"), "product_id") == by(model.metrics("product_id"), "product_id")


def test_partial_and_damaged_models_are_refused(seasonal, spark, tmp_path, monkeypatch):
    model = DemandModel("trend").train(seasonal)
    good, part = tmp_path / "good", tmp_path / "part"
    model.save(str(good))
    with monkeypatch.context() as broken:
        broken.setattr(type(model), "_parts", lambda self: {"per_product": self._per_product, "products": self._profile.selectExpr(
            "*", "raise_error('disk full') AS no_space")})
        with pytest.raises(Exception, match="disk full"):
            model.save(str(part))
    with pytest.raises(ValueError, match="incomplete model"):
        DemandModel.load(spark, str(part))
    with pytest.raises(ValueError, match="incomplete model"):
        DemandModel.load(spark, str(tmp_path / "none"))
    DemandModel.load(spark, str(good))
    spark.read.parquet(f"{good}/held_out").limit(5).write.parquet(f"{good}/held_out", mode="append")
    with pytest.raises(ValueError, match="damaged model: held_out"):
        DemandModel.load(spark, str(good))


def test_one_product_equals_its_part_of_all(seasonal, spark, make_inventory):
    model = trained_and_reloaded(spark, seasonal, "linear_regression")
    stock = make_inventory([("2024-12-30", "P1", 260, 7)])
    one = rows(model.forecast_inventory_replenishment(seasonal, stock, "P1", reorder_level=20))
    everything = by(model.forecast_inventory_replenishment(seasonal, stock, reorder_level=20), "product_id")
    assert one == [everything["P1"]] and one[0]["current_stock"] == 260
    assert everything["P0"]["current_stock"] == 100
    assert len(rows(model.stock_projection(seasonal, stock))) == 120
    entered, = rows(model.forecast_inventory_replenishment(seasonal, stock, "P1", current_stock=150))
    assert entered["current_stock"] == 150
    price, = rows(model.optimize_pricing(seasonal, "P1", base_price=500.0))
    assert price["current_price"] == 500.0
    assert {r["current_price"] for r in rows(model.optimize_pricing(seasonal))} == {10.0}
    assert rows(model.forecast_demand(seasonal, "no such product")) == []


def test_predict_on_given_rows(seasonal):
    model = DemandModel("trend", fit_on="all").train(seasonal)
    asked = seasonal.select("date", "product_id")
    got = model.predict(asked)
    assert got.columns == ["date", "product_id", "prediction"] and got.count() == asked.count()


def test_metrics_by_product(seasonal):
    got = by(DemandModel("trend").train(seasonal).metrics("product_id"), "product_id")
    assert set(got) == {f"P{i}" for i in range(4)} and all(r["n"] == 73 for r in got.values())


def test_a_product_with_one_sale_still_gets_a_forecast(make_sales):
    sales = make_sales([sale("2024-01-01", "A", quantity=5)]
                       + [sale(f"2024-01-{d:02}", "B", quantity=d) for d in range(1, 21)])
    for model_type in ("trend", "linear_regression", "pooled_linear_regression"):
        got = rows(DemandModel(model_type).train(sales).forecast_demand(sales, days_ahead=2))
        assert {r["product_id"] for r in got} == {"A", "B"} and len(got) == 4
        if not model_type.startswith("pooled"):
            assert [r["predicted_quantity"] for r in got if r["product_id"] == "A"] == [5, 5]


def test_wrong_use(seasonal):
    with pytest.raises(ValueError, match="unknown model type 'boosting'"):
        DemandModel("boosting")
    with pytest.raises(ValueError, match="fit_on"):
        DemandModel("trend", fit_on="some")
    for call in ("forecast_demand", "predict", "optimize_pricing", "forecast_inventory_replenishment"):
        with pytest.raises(ValueError, match="untrained model"):
            getattr(DemandModel("trend"), call)(seasonal)
    with pytest.raises(ValueError, match="untrained model"):
        pooled.predict(None, seasonal)


def test_profile_feeds_the_same_forecast_as_the_dimension(seasonal):
    known = by(products.profile(seasonal), "product_id")
    assert {p: r["shelf_life_days"] for p, r in known.items()} == {f"P{p}": 4 + 3 * p for p in range(4)}


MODELS = ("trend", "linear_regression", "random_forest", "pooled_linear_regression")


@pytest.mark.parametrize("model_type", MODELS)
@pytest.mark.parametrize("missing", ["a day", "a product", "all"])
def test_null_prices(make_sales, model_type, missing):
    data = []
    for p in range(3):
        for i in range(40):
            gone = missing == "all" or p == 1 and (missing == "a product" or i == 7)
            row = list(sale((dt.date(2024, 1, 1) + dt.timedelta(i)).isoformat(), f"P{p}", f"n{p}", "c", 5 + p + i % 7))
            if gone:
                row[5] = row[6] = row[7] = None
            data.append(tuple(row))
    sales = make_sales(data)
    model = DemandModel(model_type, trees=2, partitions=4).train(sales)
    got = rows(model.forecast_demand(sales, days_ahead=3))
    assert len(got) == 9 and all(r["predicted_quantity"] is not None for r in got)
    assert rows(model.metrics())[0]["n"] == 24
    unpriced = sales.selectExpr("date", "product_id", "product_name", "category", "CAST(NULL AS DECIMAL(12,2)) AS unit_price", "shelf_life_days")
    assert model.predict(unpriced).filter("prediction IS NULL").count() == 0


@pytest.mark.parametrize("model_type", MODELS)
def test_every_product_of_the_input_is_in_the_forecast(make_sales, make_inventory, model_type):
    known = [sale(f"2024-01-{d:02}", p, quantity=d) for p in "ABC" for d in range(1, 21)]
    more = make_sales(known + [sale("2024-01-05", "D", quantity=4)])
    model = DemandModel(model_type, trees=2, partitions=4).train(make_sales(known))
    got = rows(model.forecast_demand(more, days_ahead=2))
    assert {(r["product_id"], r["predicted_quantity"] is None) for r in got} == {
        ("A", False), ("B", False), ("C", False), ("D", model_type in ("trend", "linear_regression"))}
    stock = rows(model.stock_projection(more, make_inventory([("2024-01-30", "D", 260, 7)])))
    assert {r["product_id"] for r in stock} == {"A", "B", "C", "D"}


@pytest.mark.parametrize("model_type", ["trend", "linear_regression"])
def test_a_product_with_only_a_held_out_day_has_no_score(make_sales, model_type):
    sales = make_sales([sale("2024-01-01", "A", quantity=5)]
                       + [sale(f"2024-01-{d:02}", "B", quantity=d) for d in range(1, 21)])
    got = by(DemandModel(model_type).train(sales).metrics("product_id"), "product_id")
    assert got["A"]["n"] == 0 and got["A"]["mae"] is None and got["A"]["mape"] is None
    assert got["B"]["n"] == 4 and got["B"]["mae"] is not None
    pairs = evaluate.holdout_pairs(demand.product_daily(sales))
    assert by(evaluate.metrics(pairs, "product_id"), "product_id")["A"]["mae"] is None


def test_forest_does_not_depend_on_how_rows_are_spread(seasonal, spark):
    def forecasts(sales):
        model = DemandModel("random_forest", trees=3, partitions=6).train(sales)
        return sorted(map(str, model.forecast_demand(seasonal, days_ahead=5).collect()))

    want = forecasts(seasonal.coalesce(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (2, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert forecasts(seasonal.repartition(parts)) == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ordering_keys_are_checked(spark):
    from pyspark.sql import functions as F

    from ripecast.functions import numeric
    ok = spark.sql("SELECT DATE'2024-01-01' AS d, 5L AS t").select(numeric.row_order(F.col("d"), F.col("t")))
    assert ok.count() == 1 and ok.first()[0] > 0
    for bad in ("-1L", "70368744177664L"):
        df = spark.sql(f"SELECT DATE'2024-01-01' AS d, {bad} AS t").select(numeric.row_order(F.col("d"), F.col("t")))
        with pytest.raises(Exception, match="row order tie"):
            df.collect()


def training_rows(spark, n=3000):
    """Rows with codes in the millions, seasons that add up to one, and a constant column."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (n, len(pooled.POOLED_FEATURES))).astype(float)
    x[:, 0] = rng.integers(0, 7_000_000, n)
    x[:, 1] = x[:, 0] // 1000
    x[:, 10:14] = np.eye(4)[rng.integers(0, 4, n)]
    x[:, 5] = 0.1
    y = np.round(x[:, 0] / 1e6 + 0.5 * x[:, 3] + 3 * x[:, 10] + x[:, -1] + rng.normal(0, 5, n))
    return x, y, spark.createDataFrame(np.c_[x, y].tolist(), ", ".join(f"{c} double" for c in (*pooled.POOLED_FEATURES, pooled.TARGET)))


def test_pooled_line_is_the_least_squares_one_however_rows_are_spread(spark):
    x, y, train = training_rows(spark)
    design = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), np.inf)
    want = y.mean() + design @ np.linalg.lstsq(design, y - y.mean(), rcond=1e-8)[0]
    line = pooled.fit(train, "linear_regression")
    got = {tuple(r[c] for c in pooled.POOLED_FEATURES): r["prediction"] for r in pooled.predict(line, train).collect()}
    assert max(abs(got[tuple(r)] - w) for r, w in zip(x.tolist(), want.tolist(), strict=True)) < 1e-7
    for parts in (1, 7):
        other = pooled.fit(train.repartition(parts), "linear_regression")
        assert (other.coefficients, other.intercept) == (line.coefficients, line.intercept)


def test_pooled_line_refuses_what_it_cannot_use(spark):
    _, _, train = training_rows(spark, 50)
    for broken in ("CAST(NULL AS double)", "double('NaN')", "double('Infinity')"):
        with pytest.raises(Exception, match="unit_price"):
            pooled.fit(train.withColumn("unit_price", F.expr(broken)), "linear_regression")
    with pytest.raises(ValueError, match="no training rows"):
        pooled.fit(train.limit(0), "linear_regression")
    line = pooled.fit(train, "linear_regression")
    with pytest.raises(Exception, match="null or NaN in unit_price"):
        pooled.predict(line, train.withColumn("unit_price", F.expr("CAST(NULL AS double)"))).collect()


def test_a_damaged_line_is_refused_and_an_older_pipeline_still_loads(seasonal, spark, tmp_path):
    model = DemandModel("pooled_linear_regression").train(seasonal)
    model.save(str(tmp_path / "new"))
    spark.read.parquet(f"{tmp_path}/new/coefficients").limit(3).write.parquet(f"{tmp_path}/new/coefficients", mode="append")
    with pytest.raises(ValueError, match="damaged model: coefficients"):
        DemandModel.load(spark, str(tmp_path / "new"))
    _, _, train = training_rows(spark, 200)
    stages = [VectorAssembler(inputCols=list(pooled.POOLED_FEATURES), outputCol="features"), LinearRegression(labelCol=pooled.TARGET)]
    model._pipeline = Pipeline(stages=stages).fit(train)
    model.save(str(tmp_path / "old"))
    want = sorted(map(str, model.forecast_demand(days_ahead=3).collect()))
    assert sorted(map(str, DemandModel.load(spark, str(tmp_path / "old")).forecast_demand(days_ahead=3).collect())) == want
