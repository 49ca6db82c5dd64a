"""Filters, profiles and breakdowns for looking at the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripecast.functions import calendar, labels
from ripecast.functions.numeric import ratio, sum_or_zero


def date_range(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows between two dates, both included; all rows unless both are given."""
    if start is None or end is None:
        return df
    return df.filter(F.col("date").between(F.lit(start), F.lit(end)))


def by_product_name(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("product_name") == name)


def by_product_id(df: DataFrame, product_id: str) -> DataFrame:
    return df.filter(F.col("product_id") == product_id)


def profile(df: DataFrame, table: str) -> DataFrame:
    """Row count, date range, and distinct products and categories, where the table has them."""
    keys = [c for c in ("product_id", "category") if c in df.columns]
    dated = "date" in df.columns
    # Counting distinct values of two columns multiplies the rows it sees, so shrink them first.
    groups = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *((F.min("date").alias("first"), F.max("date").alias("last")) if dated else ()),
    )

    def distinct(column: str) -> F.Column:
        return F.count_distinct(column) if column in keys else F.lit(None).cast("bigint")

    span = F.concat(
        calendar.iso(F.min("first")), F.lit(f" {labels.RANGE_WORD} "), calendar.iso(F.max("last"))
    ) if dated else F.lit(None).cast("string")
    return groups.agg(
        F.lit(table).alias("table_name"),
        sum_or_zero(F.col("n")).alias("total_records"),
        span.alias("date_range"),
        distinct("product_id").alias("unique_products"),
        distinct("category").alias("unique_categories"),
    )


def profile_labels(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "table_name",
        labels.grouped(F.col("total_records")).alias("total_records"),
        F.coalesce("date_range", F.lit(labels.NOT_AVAILABLE)).alias("date_range"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(labels.NOT_AVAILABLE)).alias(c)
          for c in ("unique_products", "unique_categories")),
    )


def category_metrics(sales: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Units, revenue and profit by category over an optional date range."""
    return (
        date_range(sales, start, end)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            sum_or_zero(F.col("quantity_sold")).alias("quantity_sold"),
            sum_or_zero(F.col("revenue")).cast("double").alias("revenue"),
            sum_or_zero(F.col("profit")).cast("double").alias("profit"),
        )
    )


def season_metrics(sales: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Units and revenue by season over an optional date range."""
    return (
        date_range(sales, start, end)
        .filter(F.col("season").isNotNull())
        .groupBy("season")
        .agg(
            sum_or_zero(F.col("quantity_sold")).alias("quantity_sold"),
            sum_or_zero(F.col("revenue")).cast("double").alias("revenue"),
        )
    )


def price_quantity(sales: DataFrame) -> DataFrame:
    """Points of the price against quantity plot."""
    return sales.select(
        F.col("unit_price").cast("double").alias("unit_price"), "quantity_sold", "category", "product_name"
    )


def product_list(sales: DataFrame) -> DataFrame:
    return sales.select("product_name").distinct()


def product_lookup(sales: DataFrame) -> DataFrame:
    """The id a product name stands for: several ids can share a name, the first one is meant."""
    return sales.groupBy("product_name").agg(F.min("product_id").alias("product_id"))


def product_kpis(sales: DataFrame) -> DataFrame:
    """Mean units, revenue, shelf life and mean price of every product name."""
    by_id = sales.filter(F.col("product_name").isNotNull()).groupBy("product_name", "product_id").agg(
        F.sum("quantity_sold").alias("quantity"),
        F.count("quantity_sold").alias("n_quantity"),
        F.sum("revenue").alias("revenue"),
        F.sum("unit_price").alias("price"),
        F.count("unit_price").alias("n_price"),
        F.min_by("shelf_life_days", "row_order").alias("shelf_life_days"),
    )
    return by_id.groupBy("product_name").agg(
        ratio(F.sum("quantity"), F.sum("n_quantity")).alias("avg_historical_sales"),
        sum_or_zero(F.col("revenue")).cast("double").alias("total_historical_revenue"),
        F.min_by("shelf_life_days", "product_id").alias("shelf_life_days"),
        ratio(F.sum("price"), F.sum("n_price")).alias("avg_price"),
    )


def product_kpi_labels(kpis: DataFrame) -> DataFrame:
    c = F.col
    return kpis.select(
        "product_name",
        labels.fixed(c("avg_historical_sales"), 1).alias("avg_historical_sales"),
        labels.money_grouped(c("total_historical_revenue")).alias("total_historical_revenue"),
        labels.days(c("shelf_life_days")).alias("shelf_life_days"),
        labels.money(c("avg_price")).alias("avg_price"),
    )
