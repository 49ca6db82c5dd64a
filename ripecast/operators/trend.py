"""Straight-line demand trend of every product by least squares.

All sums are exact integers, so coefficients do not depend on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_BITS = 20


SUMMED = ("n", "n_all", "sum_all", "st", "stt", "sy", "sty_high", "sty_low")


def sums(daily: DataFrame, key: str = "product_id", train_flag: Column | None = None) -> DataFrame:
    """All that a line needs, per product, as whole numbers that add up over any split of the days.

    Only rows with `train_flag` enter the fit; first and last date always come from all rows.
    Days are counted from 1970, and shifted to the first sale afterwards: that takes one pass instead of a join with the first date.
    """
    used = F.lit(True) if train_flag is None else train_flag
    t = F.unix_date("date").cast("bigint")
    y = F.col("quantity_sold").cast("bigint")

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(used, x)), F.lit(0))

    return daily.groupBy(key).agg(
        F.count(F.when(used, F.lit(1))).alias("n"),
        F.count(y).alias("n_all"), F.coalesce(F.sum(y), F.lit(0)).alias("sum_all"),
        total(t).alias("st"),
        total(t * t).alias("stt"),
        total(y).alias("sy"),
        # Day x quantity of a best-seller can add up past 2**63, so high and low bits go separately.
        total(t * F.shiftright(y, LOW_BITS)).alias("sty_high"),
        total(t * y.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias("sty_low"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def merged(parts: DataFrame, key: str = "product_id") -> DataFrame:
    """The sums of all days, from the sums of parts of them; a product's day must lie in one part only."""
    return parts.groupBy(key).agg(
        *(F.sum(c).alias(c) for c in SUMMED), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def fit(daily: DataFrame, key: str = "product_id", train_flag: Column | None = None) -> DataFrame:
    """Intercept and slope against days since the product's first sale, over rows with `train_flag`."""
    return lines(sums(daily, key, train_flag), key)


def lines(summed: DataFrame, key: str = "product_id") -> DataFrame:
    """Intercept and slope from a product's sums."""
    known = summed.withColumns({
        "t0": F.unix_date("first_date").cast("bigint"),
        "mean_of_all": F.try_divide(F.col("sum_all").cast("double"), F.col("n_all").cast("double"))})

    # One row per product from here on; decimals keep every product of sums exact.
    n, t0, st, stt, sy, high, low = (
        F.col(c).cast("decimal(19,0)") for c in ("n", "t0", "st", "stt", "sy", "sty_high", "sty_low")
    )
    sx = (st - n * t0).cast("decimal(19,0)")
    sxx = (stt - 2 * t0 * st + n * t0 * t0).cast("decimal(19,0)")
    sxy = (high * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low - t0 * sy).cast("decimal(27,0)")
    shifted = known.withColumns({"sx": sx, "sxx": sxx, "sxy": sxy})
    count = F.col("n").cast("decimal(10,0)")
    above = (count * F.col("sxy") - F.col("sx") * sy).cast("double")
    below = (count * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    slope = F.when(below == 0, F.lit(0.0)).otherwise(F.try_divide(above, below))
    with_slope = shifted.withColumn("slope", slope)
    intercept = F.try_divide(
        F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double"), F.col("n").cast("double")
    )
    # A product whose only day is held out still gets a level.
    intercept = F.coalesce(intercept, F.col("mean_of_all"))
    return with_slope.select(
        key, F.col("n").alias("n_days"), "first_date", "last_date", intercept.alias("intercept"), "slope"
    )


def prediction(day: Column) -> Column:
    """Expected quantity on a date, from the columns `fit` produces."""
    x = F.datediff(day, F.col("first_date")).cast("double")
    return F.col("intercept") + F.col("slope") * x
