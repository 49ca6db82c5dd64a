"""Every report by name, each a function of (session, table folder)."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripecast.functions import calendar
from ripecast.operators import (
    demand, evaluate, explore, features, forecast, kpis, pricing, products, replenish, sketches, trend,
)
from ripecast.plans import forecast_store, model
from ripecast.sources import contracts, files, rejects, snapshots
from ripecast.sources.star import StarTables, product_id

Report = Callable[[SparkSession, str], DataFrame]

KEY = "product_key"

# Arguments of the parameterised reports.
RANGE = (dt.date(1996, 1, 1), dt.date(1998, 12, 31))
STORED_UNTIL = dt.date(1998, 1, 1)
SOME_NAME = "red widget"
SOME_ID = "P000000042"

_reports: dict[str, Report] = {}


def report(fn: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    _reports[fn.__name__] = lambda spark, root: fn(StarTables(spark, root))
    return fn


def reports() -> dict[str, Report]:
    return dict(_reports)


# -- sources and sinks ---------------------------------------------------------------------

def _presentable(sales: DataFrame) -> DataFrame:
    """Contract rows with money as DOUBLE and without the ordering column."""
    return sales.withColumns({c: F.col(c).cast("double") for c in ("unit_price", "revenue", "profit")}).drop("row_order")


@report
def scan_sales(t: StarTables) -> DataFrame:
    return _presentable(t.sales())


@report
def scan_inventory(t: StarTables) -> DataFrame:
    return t.inventory().drop("row_order")


@report
def scan_customer(t: StarTables) -> DataFrame:
    return t.customers()


@report
def canonical_sales(t: StarTables) -> DataFrame:
    stock = contracts.canonical_inventory(t.source_language_inventory())
    return _presentable(contracts.canonical_sales(t.source_language_sales(), stock))


@report
def contract_defaults(t: StarTables) -> DataFrame:
    bare = t.priced_facts().select(*contracts.REQUIRED_SALES, "row_order")
    sales = contracts.with_stock_default(contracts.canonical_sales(bare))
    return sales.select("date", "product_id", "season", "is_weekend", "shelf_life_days", "current_stock")


@report
def csv_roundtrip(t: StarTables) -> DataFrame:
    path = files.shared_path(t.spark, "csv-roundtrip")
    files.save_dataset(t.sales(), t.inventory(), path)
    files.require_paths(t.spark, f"{path}/sales", f"{path}/inventory")
    sales = _presentable(files.read_sales(t.spark, f"{path}/sales")).withColumn("table_name", F.lit("sales"))
    stock = files.read_inventory(t.spark, f"{path}/inventory").drop("row_order").withColumn("table_name", F.lit("inventory"))
    return sales.unionByName(stock, allowMissingColumns=True)


@report
def snapshot_roundtrip(t: StarTables) -> DataFrame:
    """Sales and inventory written as one version over an older, smaller one, and read back by the manifest."""
    path = files.shared_path(t.spark, "snapshots")
    pair = {"sales": _presentable(t.sales()), "inventory": t.inventory().drop("row_order")}
    snapshots.write({n: df.limit(0) for n, df in pair.items()}, path)
    snapshots.write(pair, path)
    back = snapshots.read(t.spark, path, verify=True)
    sales, stock = (back[n].withColumn("table_name", F.lit(n)) for n in ("sales", "inventory"))
    return sales.unionByName(stock, allowMissingColumns=True)


def _dirty_export(t: StarTables) -> DataFrame:
    """The sales as a text export in which some values are broken, by rules over their own keys."""
    rows = t.priced_facts().select(
        "date", "product_id", "product_name", "category", "quantity_sold", "unit_price", "revenue", "profit", KEY, "current_stock")
    text = rows.withColumns({c: F.col(c).cast("string") for c in rows.columns if c not in (KEY, "current_stock")})
    return text.withColumns({
        "date": F.when(F.col("current_stock") % 31 == 0, F.lit("n/a")).otherwise(F.col("date")),
        "product_id": F.when(F.col(KEY) % 23 != 0, F.col("product_id")),
        "quantity_sold": F.when(F.col("current_stock") % 29 == 1, F.concat("quantity_sold", F.lit("x")))
        .when(F.col("current_stock") % 29 == 2, F.concat(F.lit("-1"), F.col("quantity_sold"))).otherwise(F.col("quantity_sold")),
        "unit_price": F.when(F.col(KEY) % 19 == 3, F.lit("1e12")).otherwise(F.col("unit_price")),
    }).drop(KEY, "current_stock")


@report
def rejected_rows(t: StarTables) -> DataFrame:
    """Values rejected by column and reason, beside the rows read, accepted and rejected."""
    got = rejects.sort_out(_dirty_export(t))
    reasons = got.rejected.groupBy("column", "reason").agg(F.count("*").alias("n"))
    counts = got.counts().unpivot([], ["n_read", "n_accepted", "n_rejected"], "reason", "n")
    sales = contracts.canonical_sales(got.accepted).agg(F.count("*").alias("n")).withColumn("reason", F.lit("in contract form"))
    rows = F.lit("row").alias("column")
    return reasons.unionByName(counts.select(rows, "reason", "n")).unionByName(sales.select(rows, "reason", "n"))


# -- filters and projections ---------------------------------------------------------------

@report
def filter_date_range(t: StarTables) -> DataFrame:
    start, end = RANGE
    rows = explore.date_range(t.sales(start=start, end=end), start, end)
    return rows.select("date", "product_id", "category", "quantity_sold")


@report
def filter_product_name(t: StarTables) -> DataFrame:
    rows = explore.by_product_name(t.sales(), SOME_NAME)
    return rows.select("date", "product_id", "product_name", "quantity_sold")


@report
def filter_product_id(t: StarTables) -> DataFrame:
    rows = explore.by_product_id(t.sales(only_product=SOME_ID), SOME_ID)
    return rows.select("date", "product_id", "product_name", "quantity_sold")


@report
def project_price_quantity(t: StarTables) -> DataFrame:
    return explore.price_quantity(t.sales())


# -- figures and breakdowns ----------------------------------------------------------------

@report
def kpi_totals(t: StarTables) -> DataFrame:
    return kpis.totals(t.totals(), weight="n_sales")


@report
def kpi_avg_daily_sales(t: StarTables) -> DataFrame:
    return kpis.avg_daily_sales(t.facts())


@report
def kpi_top_category(t: StarTables) -> DataFrame:
    return kpis.top_category(t.totals(), weight="n_sales")


@report
def kpi_avg_margin(t: StarTables) -> DataFrame:
    return kpis.avg_margin(t.sales())


@report
def kpi_peak_season(t: StarTables) -> DataFrame:
    return kpis.peak_season(t.totals("season"))


@report
def kpi_overview(t: StarTables) -> DataFrame:
    return kpis.overview(t.sales(), sold=t.sold_products())


@report
def kpi_labels(t: StarTables) -> DataFrame:
    return kpis.overview_labels(kpi_overview(t))


@report
def daily_revenue(t: StarTables) -> DataFrame:
    return kpis.daily_revenue(t.sales())


@report
def category_revenue_share(t: StarTables) -> DataFrame:
    return kpis.category_revenue_share(t.totals())


@report
def top_products(t: StarTables) -> DataFrame:
    return kpis.top_products(t.totals())


@report
def data_profile(t: StarTables) -> DataFrame:
    return (
        explore.profile(t.sales(), "sales")
        .unionByName(explore.profile(t.inventory(), "inventory"))
        .unionByName(explore.profile(t.customers(), "customer"))
    )


@report
def data_profile_labels(t: StarTables) -> DataFrame:
    return explore.profile_labels(data_profile(t))


@report
def category_metrics(t: StarTables) -> DataFrame:
    return explore.category_metrics(t.totals())


@report
def category_metrics_in_range(t: StarTables) -> DataFrame:
    start, end = RANGE
    return explore.category_metrics(t.totals(start=start, end=end))


@report
def season_metrics(t: StarTables) -> DataFrame:
    return explore.season_metrics(t.totals("season"))


@report
def product_kpis(t: StarTables) -> DataFrame:
    return explore.product_kpis(t.sales())


@report
def product_kpi_labels(t: StarTables) -> DataFrame:
    return explore.product_kpi_labels(explore.product_kpis(t.sales()))


@report
def product_list(t: StarTables) -> DataFrame:
    return explore.product_list(t.sold_products())


@report
def product_lookup(t: StarTables) -> DataFrame:
    return explore.product_lookup(t.sold_products())


@report
def product_first_attrs(t: StarTables) -> DataFrame:
    return products.profile(t.sales()).select(
        "product_id", "product_name", "category", "shelf_life_days", "base_price"
    )


@report
def stock_latest(t: StarTables) -> DataFrame:
    return _stocked(t).select("product_id", "current_stock")


@report
def approx_products(t: StarTables) -> DataFrame:
    """Products sold per category and month, exactly, and whether the estimate from merged daily sketches is within its bound."""
    sold = t.facts().groupBy("date", KEY).agg(F.count("*").alias("n")).join(t.products().select(KEY, "category"), KEY)
    month = F.trunc("date", "month").alias("month")
    daily = sketches.by_day(sold, KEY)
    estimates = sketches.estimated(sketches.merged(daily, "category", month))
    exact = sold.groupBy("category", month).agg(F.countDistinct(KEY).alias("n_products"))
    off = F.abs(F.col("approx_distinct") - F.col("n_products"))
    return exact.join(estimates, ["category", "month"]).select(
        "category", "month", "n_products",
        (off <= F.greatest(F.lit(1.0), F.col("n_products") * sketches.bound())).alias("within_bound"))


# -- calendar and measures -----------------------------------------------------------------

@report
def calendar_spine(t: StarTables) -> DataFrame:
    """Every product on every day from the first sale to the last, summed up by month beside what was sold."""
    facts = t.facts()
    # One row.
    first, last = facts.filter(F.col(KEY).isNotNull()).agg(F.min("date"), F.max("date")).first()
    if first is None:
        first = last = dt.date(1970, 1, 1)
    months = products.calendar_by_month(t.products().select(KEY, "product_id"), facts, first, last, KEY)
    return months.select("product_id", "month", "season", "n_days", "n_weekend_days", "n_sale_days", "quantity_sold")


@report
def climate_season(t: StarTables) -> DataFrame:
    day = F.col("date")
    return t.facts().groupBy("date").agg(
        F.count("*").alias("n_rows"), F.sum("quantity_sold").alias("quantity_sold")
    ).withColumns({"season": calendar.climate_season(day), "is_weekend": calendar.is_weekend(day)})


@report
def sale_measures(t: StarTables) -> DataFrame:
    money = {c: F.col(c).cast("double").alias(c) for c in ("unit_price", "unit_cost", "revenue", "cost", "profit")}
    return t.priced_facts().select("product_id", "date", "quantity_sold", *money.values())


@report
def season_adjusted_demand(t: StarTables) -> DataFrame:
    return demand.season_adjusted(_daily_by_id(t))


# -- model input ---------------------------------------------------------------------------

def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("product_id", product_id(F.col(KEY)))


def _daily(t: StarTables) -> DataFrame:
    return demand.product_daily(t.facts(), KEY)


def _daily_by_id(t: StarTables) -> DataFrame:
    return _with_id(_daily(t)).drop(KEY)


@report
def product_daily(t: StarTables) -> DataFrame:
    return _daily_by_id(t)


@report
def date_features(t: StarTables) -> DataFrame:
    rows = t.sales().withColumn("unit_price", F.col("unit_price").cast("double"))
    return features.with_calendar(rows).select(
        "date", "product_id", "unit_price", "year", *features.PRODUCT_FEATURES[1:], features.TARGET
    )


@report
def label_encode(t: StarTables) -> DataFrame:
    return features.label_codes(t.sold_products())


@report
def feature_matrix(t: StarTables) -> DataFrame:
    coded = features.encode(t.products(), features.label_codes(t.products()))
    rows = features.with_calendar(_daily(t).join(coded, KEY)).withColumn("unit_price", F.col("mean_price"))
    return features.feature_matrix(rows)


@report
def train_test_split(t: StarTables) -> DataFrame:
    return demand.split(_with_id(_daily(t)), KEY, "product_id").drop(KEY)


@report
def future_frame(t: StarTables) -> DataFrame:
    return forecast.future_frame(products.profile(t.sales()))


# -- forecasts -----------------------------------------------------------------------------

def _stocked(t: StarTables) -> DataFrame:
    return products.with_stock(t.products(), products.latest_stock(t.facts(), KEY), KEY)


def _trend(t: StarTables, days_ahead: int = forecast.DEFAULT_HORIZON, fit_on: str = "all") -> DataFrame:
    daily = _with_id(_daily(t)) if fit_on == "train" else _daily(t)
    return forecast.trend_days(daily, t.products(), days_ahead, KEY, fit_on, "product_id")


def _trend_with_stock(t: StarTables) -> DataFrame:
    return forecast.trend_days(_daily(t), _stocked(t), key=KEY)


@report
def forecast_trend(t: StarTables) -> DataFrame:
    return forecast.contract(_trend(t))


@report
def forecast_trend_train_part(t: StarTables) -> DataFrame:
    return forecast.contract(_trend(t, fit_on="train"))


@report
def trend_coefficients(t: StarTables) -> DataFrame:
    return trend.fit(_daily_by_id(t))


@report
def forecast_intervals(t: StarTables) -> DataFrame:
    days = _trend(t, 7).withColumn("raw_prediction", trend.prediction(F.col("date")))
    return forecast.contract(days, "raw_prediction")


@report
def forecast_summary(t: StarTables) -> DataFrame:
    return forecast.summary(_trend(t), KEY)


@report
def forecast_summary_labels(t: StarTables) -> DataFrame:
    return forecast.summary_labels(forecast.summary(_trend(t), KEY))


@report
def history_plus_forecast(t: StarTables) -> DataFrame:
    return forecast.history_plus_forecast(_with_id(t.facts()), forecast.contract(_trend(t)))


@report
def eval_holdout(t: StarTables) -> DataFrame:
    pairs = evaluate.holdout_pairs(_with_id(_daily(t)), KEY, "product_id")
    return _with_id(evaluate.metrics(pairs, KEY)).select("product_id", "n", "mae", "mse", "r2")


@report
def eval_metrics(t: StarTables) -> DataFrame:
    return evaluate.metrics(evaluate.holdout_pairs(_with_id(_daily(t)), KEY, "product_id"))


# -- stock and price -----------------------------------------------------------------------

@report
def stock_projection(t: StarTables) -> DataFrame:
    return replenish.stock_projection(_trend_with_stock(t), key=KEY)


@report
def reorder_status(t: StarTables) -> DataFrame:
    return replenish.reorder_status(_trend_with_stock(t), key=KEY)


@report
def reorder_plan(t: StarTables) -> DataFrame:
    return replenish.reorder_plan(_trend_with_stock(t), key=KEY)


@report
def price_optimization(t: StarTables) -> DataFrame:
    return pricing.suggest(_trend(t, pricing.PAGE_DAYS), KEY)


@report
def price_change(t: StarTables) -> DataFrame:
    return pricing.change(pricing.suggest(_trend(t, pricing.PAGE_DAYS), KEY))


@report
def price_change_labels(t: StarTables) -> DataFrame:
    return pricing.change_labels(pricing.change(pricing.suggest(_trend(t, pricing.PAGE_DAYS), KEY)))


@report
def price_comparison(t: StarTables) -> DataFrame:
    return pricing.comparison(pricing.suggest(_trend(t, pricing.PAGE_DAYS), KEY))


@report
def stored_reorder_plan(t: StarTables) -> DataFrame:
    """The reorder plan from a stored forecast that was built on the days before 1998 and updated with the others."""
    daily = files.materialize(_daily_by_id(t), "daily-demand")
    store = forecast_store.ForecastStore(t.spark, files.shared_path(t.spark, "forecast-store"))
    cut = F.col("date") < F.lit(STORED_UNTIL)
    store.build(daily.filter(cut), t.products())
    store.update(daily.filter(~cut), t.products())
    return store.reorder_plan(_stocked(t).select("product_id", "current_stock"))


# -- learned models ------------------------------------------------------------------------

def _trained(t: StarTables, model_type: str, **options: object) -> model.DemandModel:
    """Facts are summed per product and day before the dimension comes in, and scanned once."""
    daily = files.materialize(_daily_by_id(t), "daily-demand")
    dates = daily.groupBy("product_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    profile = t.products().drop(KEY, "unit_price", "unit_cost").join(dates, "product_id")
    return model.DemandModel(model_type, **options).train_days(daily, profile)


def _reloaded_forecast(t: StarTables, trained: model.DemandModel) -> DataFrame:
    return model.reloaded(trained, t.spark).forecast_demand(profile=trained.products())


@report
def forecast_linear(t: StarTables) -> DataFrame:
    return _trained(t, "linear_regression").forecast_demand()


@report
def forecast_rf(t: StarTables) -> DataFrame:
    return _trained(t, "random_forest").forecast_demand()


@report
def forest_trees(t: StarTables) -> DataFrame:
    """Every node of the fitted forest."""
    return _trained(t, "random_forest").tree_nodes()


@report
def eval_rf(t: StarTables) -> DataFrame:
    return _trained(t, "random_forest").metrics()


@report
def eval_linear(t: StarTables) -> DataFrame:
    return _trained(t, "linear_regression").metrics()


@report
def trend_save_load(t: StarTables) -> DataFrame:
    return _reloaded_forecast(t, _trained(t, "trend", fit_on="all"))


@report
def model_save_load(t: StarTables) -> DataFrame:
    return _reloaded_forecast(t, _trained(t, "pooled_linear_regression"))


@report
def forest_save_load(t: StarTables) -> DataFrame:
    """Forecast and held-out metrics of a forest that was saved and loaded again."""
    loaded = model.reloaded(_trained(t, "random_forest"), t.spark)
    summed = loaded.forecast_demand().agg(F.count("*").alias("n_forecast"), F.sum("predicted_quantity").alias("predicted_quantity"))
    return loaded.metrics().crossJoin(summed)


# Facts about fitted models that SQL can state without fitting one.

@report
def linear_certificate(t: StarTables) -> DataFrame:
    """Per product: forecast days, and whether its fit is the least-squares one: residuals on the fitted days
    orthogonal to every feature and adding up to nothing, relative to the size of both."""
    trained = _trained(t, "linear_regression", fit_on="all")
    used = trained.fitted_days()
    error = F.col("quantity_sold") - F.col("prediction")
    size = F.sqrt(F.sum(F.col("quantity_sold") * F.col("quantity_sold"))) + 1
    columns = [F.col(c).cast("double") for c in features.PRODUCT_FEATURES]
    orthogonal = [F.abs(F.sum(error * c)) <= 1e-6 * size * (F.sqrt(F.sum(c * c)) + 1) for c in columns]
    checks = used.groupBy("product_id").agg(
        F.count("*").alias("n_days"), functools.reduce(lambda a, b: a & b, orthogonal, F.abs(F.sum(error)) <= 1e-6 * size * F.sqrt(F.count("*")))
        .alias("is_least_squares"))
    ahead = trained.forecast_demand().groupBy("product_id").agg(F.count("predicted_quantity").alias("n_forecast_days"))
    return checks.join(ahead, "product_id")


@report
def save_load_certificate(t: StarTables) -> DataFrame:
    """Per product: forecast days of the pooled model that are equal, to the last bit, after saving and loading."""
    trained = _trained(t, "pooled_linear_regression")
    keys = ["product_id", "date"]
    before = trained.forecast_demand().withColumn("h", F.xxhash64(*forecast.FORECAST_COLUMNS)).select(*keys, "h")
    after = _reloaded_forecast(t, trained).withColumn("g", F.xxhash64(*forecast.FORECAST_COLUMNS)).select(*keys, "g")
    return before.join(after, keys, "full").groupBy("product_id").agg(
        F.count("*").alias("n_days"), F.coalesce(F.sum((F.col("h") == F.col("g")).cast("int")), F.lit(0)).alias("n_equal"))
