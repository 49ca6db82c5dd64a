"""Future days, forecasts with intervals, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripecast.functions import calendar, labels, policy
from ripecast.functions.numeric import ratio
from ripecast.operators import demand, trend

# Forecast horizons in days, and names of the two series on one chart.
DEFAULT_HORIZON = 30
HISTORY_SERIES = "Ventes Historiques"
FORECAST_SERIES = "Prévision"

FORECAST_COLUMNS = (
    "date", "product_id", "product_name", "predicted_quantity",
    "confidence_interval_lower", "confidence_interval_upper", "shelf_life_days",
)


def check_horizon(days_ahead: int) -> None:
    if days_ahead < 1:
        raise ValueError("days_ahead must be at least 1")


def future_days(products: DataFrame, days_ahead: int = DEFAULT_HORIZON) -> DataFrame:
    """One row per product and day after its last sale, as DATE. No join, no shuffle."""
    check_horizon(days_ahead)
    ahead = products.withColumn("days_on", F.explode(F.sequence(F.lit(1), F.lit(days_ahead))))
    return ahead.withColumn("date", F.date_add("last_date", F.col("days_on"))).drop("days_on")


def future_frame(products: DataFrame, days_ahead: int = DEFAULT_HORIZON) -> DataFrame:
    """Model input for the coming days, from a product profile."""
    days = future_days(products.withColumn("unit_price", F.col("mean_price")), days_ahead)
    rows = days.withColumns(
        calendar.season_flags(F.col("date")) | {"is_weekend": calendar.is_weekend(F.col("date"))}
    )
    return rows.select(
        calendar.iso(F.col("date")).alias("date"),
        "product_id", "product_name", "category", "unit_price",
        "is_weekend", "is_summer", "is_winter", "is_spring", "is_fall", "shelf_life_days",
    )


def with_intervals(df: DataFrame, prediction: Column) -> DataFrame:
    return df.withColumns(policy.interval(prediction, F.col("shelf_life_days")))


def contract(df: DataFrame, *extra: str) -> DataFrame:
    """Forecast columns with ISO text dates."""
    return df.withColumn("date", calendar.iso(F.col("date"))).select(*FORECAST_COLUMNS, *extra)


def trend_days(
    daily: DataFrame,
    products: DataFrame,
    days_ahead: int = DEFAULT_HORIZON,
    key: str = "product_id",
    fit_on: str = "all",
    id_column: str | None = None,
) -> DataFrame:
    """Trend forecast for all products, with the products' columns kept and `date` as DATE.

    `products` has one row per `key`. It meets the fitted lines, not the sales: the join is at
    one row per product, and its partitioning by product carries over to everything after it.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    flag = None
    if fit_on == "train":
        daily, flag = demand.split(daily, key, id_column or key), F.col("is_test") == 0
    lines = trend.fit(daily, key, flag)
    days = future_days(lines.join(products.drop("first_date", "last_date"), key), days_ahead)
    return with_intervals(days, trend.prediction(F.col("date")))


def summary(forecast: DataFrame, key: str = "product_id") -> DataFrame:
    """Total and mean forecast and mean half-width of the interval, per product."""
    width = F.col("confidence_interval_upper") - F.col("confidence_interval_lower")
    keys = [key] + [c for c in ("product_id",) if c != key]
    sums = forecast.groupBy(*keys).agg(
        F.sum("predicted_quantity").alias("total_predicted"),
        ratio(F.sum("predicted_quantity"), F.count("predicted_quantity")).alias("avg_per_day"),
        (ratio(F.sum(width), F.count("*")) / 2).alias("avg_confidence"),
    )
    return sums.select("product_id", "total_predicted", "avg_per_day", "avg_confidence")


def summary_labels(summaries: DataFrame) -> DataFrame:
    c = F.col
    return summaries.select(
        "product_id",
        labels.grouped(c("total_predicted")).alias("total_predicted"),
        labels.fixed(c("avg_per_day"), 1).alias("avg_per_day"),
        labels.plus_minus(c("avg_confidence")).alias("avg_confidence"),
    )


def history_plus_forecast(sales: DataFrame, forecast: DataFrame) -> DataFrame:
    """Past sales and forecast on one time axis, told apart by `series`."""
    past = sales.select(
        "product_id", calendar.iso(F.col("date")).alias("date"),
        F.lit(HISTORY_SERIES).alias("series"), F.col("quantity_sold").alias("quantity"),
    )
    coming = forecast.select(
        "product_id", "date", F.lit(FORECAST_SERIES).alias("series"),
        F.col("predicted_quantity").alias("quantity"),
        F.col("confidence_interval_lower").alias("lower"),
        F.col("confidence_interval_upper").alias("upper"),
    )
    return past.unionByName(coming, allowMissingColumns=True)
