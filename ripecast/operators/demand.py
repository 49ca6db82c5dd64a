"""Daily demand per product, and its train / test split.

From here on a product has at most one row per calendar day, whatever its share of the sales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.functions import measures
from ripecast.functions.numeric import ratio, sum_or_zero

TEST_ONE_IN = 5  # fixed value: 20 % of every product's days are held out


def product_daily(sales: DataFrame, key: str = "product_id") -> DataFrame:
    """Units per product and day, and the day's mean price if the table has prices.

    The shuffle is on (product, day) after a map-side sum, so a best-seller spreads over its days.
    """
    price = [ratio(F.sum("unit_price"), F.count("unit_price")).alias("unit_price")]
    return sales.filter(F.col(key).isNotNull() & F.col("date").isNotNull()).groupBy(key, "date").agg(
        sum_or_zero(F.col("quantity_sold")).alias("quantity_sold"),
        *(price if "unit_price" in sales.columns else []),
    )


def split(daily: DataFrame, key: str = "product_id", id_column: str = "product_id") -> DataFrame:
    """Marks ceil(20 %) of every product's days as test, chosen by a hash of product id and date."""
    order = F.md5(F.concat(F.col(id_column), F.lit("|"), F.col("date").cast("string")))
    # A product's window holds its days, at most a calendar's worth. Rank and size share its order, so that it is sorted once.
    days = W.partitionBy(key).orderBy(order)
    rank = F.row_number().over(days)
    size = F.count("*").over(days.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    n_test = F.ceil(F.col("n_days") / TEST_ONE_IN)
    return (
        daily.withColumns({"rank": rank, "n_days": size})
        .withColumn("is_test", (F.col("rank") <= n_test).cast("int"))
        .drop("rank", "n_days")
    )


def season_adjusted(daily: DataFrame, product_factor: str | None = None) -> DataFrame:
    """Demand divided by the uplift expected on that date."""
    factor = measures.demand_factor(F.col("date"), F.col(product_factor) if product_factor else None)
    return daily.withColumn("demand_factor", factor).withColumn(
        "adjusted_quantity", ratio(F.col("quantity_sold"), F.col("demand_factor"))
    )
