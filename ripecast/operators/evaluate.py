"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripecast.functions.numeric import ratio
from ripecast.operators import demand, trend
from ripecast.sources.files import materialize


def metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE of `predicted` against `actual`, in all or per group.

    Zero actuals have no percentage error: they stay out of MAPE and are counted. R2 of constant
    actuals is 1 for a perfect prediction and 0 otherwise; of fewer than two rows it is NULL. A group
    whose rows all lack a prediction has n = 0 and NULL metrics.
    """
    p = F.col("predicted").cast("double")
    a = F.when(p.isNotNull(), F.col("actual").cast("double"))
    error = a - p
    sums = pairs.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(a).alias("spread"),
        F.min(a).alias("least"),
        F.max(a).alias("most"),
        F.avg(F.abs(ratio(error, a))).alias("mape"),
        F.count(F.when(a == 0, F.lit(1))).alias("n_zero_actual"),
    )
    constant = F.col("least") == F.col("most")
    r2 = (
        F.when(F.col("n") < 2, F.lit(None))
        .when(constant, F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.try_divide(F.col("mse"), F.col("spread")))
    )
    return sums.select(
        *by, "n",
        F.round("mae", 6).alias("mae"),
        F.round("mse", 6).alias("mse"),
        F.round(F.sqrt("mse"), 6).alias("rmse"),
        F.round(r2, 6).alias("r2"),
        F.round(F.col("mape") * 100, 6).alias("mape"),
        "n_zero_actual",
    )


def holdout_pairs(daily: DataFrame, key: str = "product_id", id_column: str | None = None) -> DataFrame:
    """Actual and trend-predicted quantity on every product's test days, fitted on the others.

    A product without any other day has no prediction: the trend's fallback level would be its own answer.
    Fit and test both read the marked days, so those are stored once.
    """
    marked = materialize(demand.split(daily, key, id_column or key), "marked-days")
    lines = trend.fit(marked, key, F.col("is_test") == 0)
    test = marked.filter(F.col("is_test") == 1)
    return test.join(lines, key).select(
        key, "date",
        F.col("quantity_sold").alias("actual"),
        F.when(F.col("n_days") > 0, trend.prediction(F.col("date"))).alias("predicted"),
    )
