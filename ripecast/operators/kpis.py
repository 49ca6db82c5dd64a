"""Headline figures over a sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.functions import labels
from ripecast.functions.numeric import ratio, sum_or_zero
from ripecast.operators import sketches


def _margin() -> F.Column:
    """Margin of one sale in percent; NULL, so skipped by means, where revenue is 0."""
    return ratio(F.col("profit"), F.col("revenue")) * 100


def _guarded_margin(revenue: F.Column, margin: F.Column) -> F.Column:
    return F.when(revenue > 0, F.round(margin, 6)).otherwise(F.lit(0.0))


def totals(sales: DataFrame, weight: str | None = None) -> DataFrame:
    """Total revenue and profit, mean revenue per sale, number of products.

    `weight` names the number of sales a row stands for, if rows are sums already.
    """
    n_sales = F.count("revenue") if weight is None else F.sum(F.when(F.col("revenue").isNotNull(), F.col(weight)))
    return sales.agg(
        sum_or_zero(F.col("revenue")).cast("double").alias("total_revenue"),
        sum_or_zero(F.col("profit")).cast("double").alias("total_profit"),
        ratio(F.sum("revenue"), n_sales).alias("avg_order_value"),
        F.count_distinct("product_id").alias("total_products"),
    )


def avg_daily_sales(sales: DataFrame) -> DataFrame:
    """Mean of the daily unit totals, over days that have sales."""
    daily = sales.filter(F.col("date").isNotNull()).groupBy("date").agg(
        sum_or_zero(F.col("quantity_sold")).alias("quantity")
    )
    return daily.agg(ratio(F.sum("quantity"), F.count("quantity")).alias("avg_daily_sales"))


def top_category(sales: DataFrame, weight: str | None = None) -> DataFrame:
    """The category with most sales; the alphabetically first among equals."""
    n_sales = F.count("*") if weight is None else F.sum(weight)
    counts = sales.filter(F.col("category").isNotNull()).groupBy("category").agg(n_sales.alias("count"))
    best = F.min_by("category", F.struct(-F.col("count"), F.col("category")))
    return counts.agg(F.coalesce(best, F.lit(labels.NOT_AVAILABLE)).alias("top_category"))


def avg_margin(sales: DataFrame) -> DataFrame:
    """Mean over sales of profit / revenue in percent; 0 if there is no revenue at all."""
    return sales.agg(
        _guarded_margin(F.sum("revenue"), F.avg(_margin())).alias("avg_profit_margin")
    )


def peak_season(sales: DataFrame) -> DataFrame:
    """The season with most revenue; N/A for a table without seasons."""
    if "season" not in sales.columns:
        return sales.agg(F.lit(labels.NOT_AVAILABLE).alias("peak_season"))
    by_season = sales.filter(F.col("season").isNotNull()).groupBy("season").agg(
        sum_or_zero(F.col("revenue")).alias("revenue")
    )
    best = F.min_by("season", F.struct(-F.col("revenue"), F.col("season")))
    return by_season.agg(F.coalesce(best, F.lit(labels.NOT_AVAILABLE)).alias("peak_season"))


def daily_revenue(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("date").isNotNull()).groupBy("date").agg(
        sum_or_zero(F.col("revenue")).cast("double").alias("revenue")
    )


def category_revenue_share(sales: DataFrame) -> DataFrame:
    """Revenue by category and its percentage of the total."""
    by_category = sales.filter(F.col("category").isNotNull()).groupBy("category").agg(
        sum_or_zero(F.col("revenue")).alias("revenue")
    )
    # One row per category by now, so the unpartitioned window is a handful of rows.
    share = ratio(F.col("revenue"), F.sum("revenue").over(W.partitionBy())) * 100
    return by_category.select(
        "category", F.col("revenue").cast("double").alias("revenue"), F.round(share, 6).alias("share_pct")
    )


def top_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """The k product names with most revenue; ties by name."""
    return (
        sales.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(sum_or_zero(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("product_name"))
        .limit(k)
        .withColumn("revenue", F.col("revenue").cast("double"))
    )


def overview(sales: DataFrame, sold: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """All eight headline figures in one row, from two passes over the sales.

    The first pass keeps additive measures per day, category and season; everything but the
    product count follows from that small table. `sold` is any table with the ids of the products
    sold, if there is one that is cheaper to count than `sales`. With `approximate` products are counted by a sketch of
    fixed size instead of by gathering every id, within `sketches.bound()`.
    """
    cube = sales.groupBy("date", "category", "season").agg(
        F.count("*").alias("n"),
        F.sum("quantity_sold").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.count("revenue").alias("n_revenue"),
        F.sum("profit").alias("profit"),
        F.sum(_margin()).alias("margin"),
        F.count(_margin()).alias("n_margin"),
    )
    measures = ("n", "quantity", "revenue", "n_revenue", "profit", "margin", "n_margin")
    sliced = cube.groupingSets(
        [[], ["date"], ["category"], ["season"]], "date", "category", "season"
    ).agg(F.grouping_id().alias("slice"), *(F.sum(m).alias(m) for m in measures))

    # grouping_id has a bit for each column that is NOT grouped: date 4, category 2, season 1.
    whole, day, category, season = (F.col("slice") == s for s in (7, 3, 5, 6))
    category = category & F.col("category").isNotNull()
    season = season & F.col("season").isNotNull()
    day = day & F.col("date").isNotNull()

    def total(measure: str) -> F.Column:
        return F.sum(F.when(whole, F.col(measure)))

    figures = sliced.agg(
        F.coalesce(total("revenue"), F.lit(0)).cast("double").alias("total_revenue"),
        F.coalesce(total("profit"), F.lit(0)).cast("double").alias("total_profit"),
        ratio(F.sum(F.when(day, F.col("quantity"))), F.count(F.when(day, F.lit(1)))).alias("avg_daily_sales"),
        F.min_by("category", F.when(category, F.struct(-F.col("n"), F.col("category")))).alias("top_category"),
        ratio(total("revenue"), total("n_revenue")).alias("avg_order_value"),
        _guarded_margin(total("revenue"), ratio(total("margin"), total("n_margin"))).alias("avg_profit_margin"),
        F.min_by(
            "season", F.when(season, F.struct(-F.coalesce(F.col("revenue"), F.lit(0)), F.col("season")))
        ).alias("peak_season"),
    )
    count = F.hll_sketch_estimate(F.hll_sketch_agg("product_id", F.lit(sketches.LG_K))) if approximate else F.count_distinct("product_id")
    products = (sales if sold is None else sold).agg(count.alias("total_products"))
    both = figures.unionByName(products, allowMissingColumns=True)
    merged = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return merged.fillna(labels.NOT_AVAILABLE, ["top_category", "peak_season"])


def overview_labels(figures: DataFrame) -> DataFrame:
    """The row of headline figures as display text, one row per figure."""
    c = F.col
    texts = {
        "total_revenue": labels.money_grouped(c("total_revenue")),
        "total_profit": labels.money_grouped(c("total_profit")),
        "avg_daily_sales": labels.fixed(c("avg_daily_sales"), 1),
        "top_category": c("top_category"),
        "avg_order_value": labels.money(c("avg_order_value")),
        "total_products": c("total_products").cast("string"),
        "avg_profit_margin": labels.percent(c("avg_profit_margin")),
        "peak_season": c("peak_season"),
    }
    wide = figures.select(*(text.alias(name) for name, text in texts.items()))
    return wide.unpivot([], list(texts), "kpi", "label")
