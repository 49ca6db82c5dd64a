"""Stock projection and reorder plan on top of a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.functions import calendar, policy


def running_stock(days: DataFrame, key: str = "product_id") -> DataFrame:
    """Demand added up from the first forecast day, and the stock left after it."""
    so_far = W.partitionBy(key).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.withColumn("cumulative_demand", F.sum("predicted_quantity").over(so_far)).withColumn(
        "projected_inventory", F.col("current_stock") - F.col("cumulative_demand")
    )


def stock_projection(days: DataFrame, reorder_level: int = policy.DEFAULT_REORDER_LEVEL,
                     key: str = "product_id") -> DataFrame:
    """Projected stock of every product and day, marked where it is at the level or gone."""
    stock = F.col("projected_inventory")
    return running_stock(days, key).select(
        calendar.iso(F.col("date")).alias("date"),
        "product_id", "product_name", "predicted_quantity", "cumulative_demand", "projected_inventory",
        (stock <= reorder_level).cast("int").alias("at_reorder_level"),
        (stock <= 0).cast("int").alias("out_of_stock"),
    )


def _due_days(days: DataFrame, reorder_level: int, key: str) -> DataFrame:
    """One row per product with the day its stock is `due`, NULL if it lasts.

    Forecasts are never negative, so stock only falls: the first day at or below the level is
    the earliest such day.
    """
    adjusted = policy.adjusted_reorder_level(F.lit(reorder_level), F.col("shelf_life_days"))
    due = F.min(F.when(F.col("projected_inventory") <= F.col("reorder_level"), F.col("date")))
    return (
        running_stock(days, key)
        .withColumn("reorder_level", adjusted)
        .groupBy(key, *(c for c in ("product_id",) if c != key),
                 "product_name", "current_stock", "reorder_level", "shelf_life_days")
        .agg(due.alias("due"))
    )


def _as_plan(due_days: DataFrame) -> DataFrame:
    quantity = policy.order_quantity(F.col("reorder_level"), F.col("shelf_life_days"))
    return due_days.select(
        "product_id", "product_name",
        calendar.iso(F.col("due")).alias("suggested_reorder_date"),
        F.when(F.col("due").isNotNull(), quantity).alias("suggested_quantity"),
        "current_stock", "reorder_level", "shelf_life_days",
    )


def reorder_status(days: DataFrame, reorder_level: int = policy.DEFAULT_REORDER_LEVEL,
                   key: str = "product_id") -> DataFrame:
    """Reorder date and quantity of every product; both NULL if the stock lasts."""
    return _as_plan(_due_days(days, reorder_level, key))


def reorder_plan(days: DataFrame, reorder_level: int = policy.DEFAULT_REORDER_LEVEL,
                 key: str = "product_id") -> DataFrame:
    """Products whose stock reaches the level within the forecast, with date and quantity to order."""
    return _as_plan(_due_days(days, reorder_level, key).filter(F.col("due").isNotNull()))
