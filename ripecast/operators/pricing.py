"""Price suggestions on top of a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripecast.functions import labels, policy
from ripecast.functions.numeric import ratio

# Forecast days behind a price, by call and on the page; names of the two prices.
DEFAULT_DAYS = 7
PAGE_DAYS = 14
CURRENT_PRICE_NAME = "Prix Actuel"
SUGGESTED_PRICE_NAME = "Prix Suggéré"


def suggest(days: DataFrame, key: str = "product_id") -> DataFrame:
    """Price suggestion per product, from its mean forecast and shelf life.

    `days` is a forecast that still has `base_price`, the price to start from.
    """
    keys = [key] + [c for c in ("product_id",) if c != key]
    demand = days.groupBy(*keys, "product_name", "shelf_life_days", "base_price").agg(
        ratio(F.sum("predicted_quantity"), F.count("predicted_quantity")).alias("demand")
    )
    factor = policy.price_factor(F.col("shelf_life_days"), F.col("demand"))
    priced = demand.withColumn("suggested_price", F.col("base_price") * factor)
    return priced.select(
        "product_id", "product_name",
        F.col("base_price").alias("current_price"),
        "suggested_price",
        policy.pricing_strategy(F.col("base_price"), F.col("suggested_price")).alias("pricing_strategy"),
        F.col("demand").alias("avg_forecasted_demand"),
        "shelf_life_days",
    )


def change(suggestions: DataFrame) -> DataFrame:
    """Difference between suggested and current price, absolute and in percent."""
    diff = F.col("suggested_price") - F.col("current_price")
    return suggestions.withColumn("price_diff", diff).withColumn(
        "price_change_pct", ratio(F.col("price_diff"), F.col("current_price")) * 100
    ).select("product_id", "current_price", "suggested_price", "price_diff", "price_change_pct")


def change_labels(changes: DataFrame) -> DataFrame:
    c = F.col
    return changes.select(
        "product_id",
        labels.money(c("current_price")).alias("current_price"),
        labels.money(c("suggested_price")).alias("suggested_price"),
        labels.signed_money(c("price_diff")).alias("price_diff"),
        labels.signed_percent(c("price_change_pct")).alias("price_change_pct"),
    )


def comparison(suggestions: DataFrame) -> DataFrame:
    """Current and suggested price as two rows per product."""
    named = suggestions.select(
        "product_id",
        F.col("current_price").alias(CURRENT_PRICE_NAME),
        F.col("suggested_price").alias(SUGGESTED_PRICE_NAME),
    )
    return named.unpivot("product_id", [CURRENT_PRICE_NAME, SUGGESTED_PRICE_NAME], "metric", "value")
