"""One row per product: first-seen attributes, latest stock, and the product calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripecast.functions import calendar
from ripecast.functions.numeric import ratio, sum_or_zero
from ripecast.functions.policy import DEFAULT_STOCK


def profile(sales: DataFrame) -> DataFrame:
    """Attributes of a product as of its first sale, its mean price and its sale dates.

    Grouping by the attributes first keeps that pass a hash aggregate: text cannot be an
    aggregation buffer there. The second pass sees about one row per product.
    """
    variants = sales.filter(F.col("product_id").isNotNull()).groupBy(
        "product_id", "product_name", "category", "shelf_life_days"
    ).agg(
        F.min("row_order").alias("first_row"),
        F.min_by("unit_price", "row_order").alias("price"),
        F.sum("unit_price").alias("price_sum"),
        F.count("unit_price").alias("price_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    first = F.min_by(F.struct("product_name", "category", "shelf_life_days", "price"), "first_row")
    return variants.groupBy("product_id").agg(
        first.alias("first"),
        ratio(F.sum("price_sum"), F.sum("price_count")).alias("mean_price"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    ).select(
        "product_id",
        F.col("first.product_name"),
        F.col("first.category"),
        F.col("first.shelf_life_days"),
        F.col("first.price").cast("double").alias("base_price"),
        "mean_price",
        "first_date",
        "last_date",
    )


def latest_stock(inventory: DataFrame, key: str = "product_id") -> DataFrame:
    """The last recorded stock level of every product."""
    return inventory.groupBy(key).agg(F.max_by("current_stock", "row_order").alias("current_stock"))


def with_stock(products: DataFrame, stock: DataFrame, key: str = "product_id") -> DataFrame:
    """Products with their stock level, the default for those never counted."""
    return products.join(stock, key, "left").withColumn(
        "current_stock", F.coalesce("current_stock", F.lit(DEFAULT_STOCK).cast("bigint"))
    )


def calendar_spine(products: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every product on every day from start to end, both included."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    spine = products.select("product_id", F.explode(days).alias("date"))
    return spine.withColumns({
        "season": calendar.climate_season(F.col("date")),
        "is_weekend": calendar.is_weekend(F.col("date")),
    })


def _weekend_days_until(day: Column) -> Column:
    """Weekend days from a fixed Monday to this day, both included."""
    since = F.unix_date(day) + 3  # 1970-01-01 was a Thursday
    return 2 * F.floor(since / F.lit(7)) + F.greatest(F.lit(0), F.pmod(since, F.lit(7)) - 4)


def calendar_months(products: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every product in every month from start to end, with the days and weekend days of it that lie between them.

    The days of `calendar_spine` counted by arithmetic: a row per product and month, none per day.
    """
    months = F.sequence(F.trunc(F.lit(start), "month"), F.lit(end), F.expr("interval 1 month"))
    first, last = F.greatest("month", F.lit(start)), F.least(F.last_day("month"), F.lit(end))
    return products.withColumn("month", F.explode(months)).withColumns({
        "season": calendar.climate_season(F.col("month")),
        "n_days": (F.datediff(last, first) + 1).cast("bigint"),
        "n_weekend_days": (_weekend_days_until(last) - _weekend_days_until(F.date_sub(first, 1))).cast("bigint"),
    })


def monthly_sales(sales: DataFrame, key: str = "product_id") -> DataFrame:
    """Units and days with a sale per product and month: one shuffle, of a row per product, month and task at most."""
    day_bit = F.expr("shiftleft(1, dayofmonth(date) - 1)")
    return sales.filter(F.col(key).isNotNull() & F.col("date").isNotNull()).groupBy(
        key, F.trunc("date", "month").alias("month")).agg(
            F.bit_count(F.bit_or(day_bit)).cast("bigint").alias("n_sale_days"), sum_or_zero(F.col("quantity_sold")).alias("quantity_sold"))


def calendar_by_month(products: DataFrame, sales: DataFrame, start: dt.date, end: dt.date, key: str = "product_id") -> DataFrame:
    """The calendar's months with what was sold in them, zero where nothing was."""
    spine = calendar_months(products, start, end).join(monthly_sales(sales, key), [key, "month"], "left")
    return spine.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_sale_days", "quantity_sold")})
