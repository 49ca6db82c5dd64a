"""One stored trend forecast that forecast, stock, reorder and price reports share, kept up to date product by product.

A version holds the products' trend sums, which add up over days, and their forecast days. New sales touch only the products that
have them: their sums are merged and their lines fitted anew, all others keep their rows, without reading a sale. A product
with sales on a day that is already summed (late rows) is summed again from all of its days. Versions are `snapshots`: readers see sums
and forecast of one version, and a failed update leaves the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripecast.functions import policy
from ripecast.operators import forecast, pricing, products, replenish, trend
from ripecast.sources import snapshots
from ripecast.sources.files import materialize

# Forecast days that one task of the reports sorts: their bytes don't bound them, since a product's days compress to a few bytes each.
TASK_ROWS = 1 << 20
ATTRIBUTES = ("product_name", "shelf_life_days", "base_price")


class ForecastStore:
    def __init__(self, spark: SparkSession, root: str, days_ahead: int = forecast.DEFAULT_HORIZON):
        forecast.check_horizon(days_ahead)
        self.spark, self.root, self.days_ahead = spark, root, days_ahead

    # -- writing ---------------------------------------------------------------------------

    def _days(self, sums: DataFrame, profile: DataFrame) -> DataFrame:
        """Forecast days of the products of `sums`, with the attributes that the reports need."""
        known = trend.lines(sums).join(profile.select("product_id", *ATTRIBUTES), "product_id")
        ahead = forecast.future_days(known, self.days_ahead)
        return forecast.with_intervals(ahead, trend.prediction(F.col("date"))).select(
            "product_id", "date", *ATTRIBUTES, "last_date", "predicted_quantity", "confidence_interval_lower", "confidence_interval_upper")

    def build(self, daily: DataFrame, profile: DataFrame) -> int:
        """The first version, or a new one from all days; `daily` has one row per product and day."""
        sums = materialize(trend.sums(daily), "trend-sums")
        return snapshots.write({"sums": sums, "forecast": self._days(sums, profile)}, self.root)

    def update(self, new: DataFrame, profile: DataFrame, daily: DataFrame | None = None) -> int:
        """A version with the days of `new` added: one row per product and day.

        `daily` gives all days, the new ones included; it is read only for products of which `new` has a day that the
        stored sums cover, and needed only if there are such.
        """
        stored = snapshots.read(self.spark, self.root)
        old = stored["sums"]
        added = materialize(trend.sums(new), "new-sums")
        covered = old.select("product_id", F.col("last_date").alias("summed_until"))
        late = added.join(covered, "product_id").filter("first_date <= summed_until").select("product_id")
        late = materialize(late, "late-products")
        again = None
        if not late.isEmpty():
            if daily is None:
                raise ValueError("sales on days that are already summed: all days are needed to sum them again")
            again = trend.sums(daily.join(late, "product_id", "left_semi"))
        plain = added.join(late, "product_id", "left_anti")
        touched = trend.merged(plain.unionByName(old.join(plain.select("product_id"), "product_id", "left_semi")))
        touched = materialize(touched if again is None else touched.unionByName(again), "merged-sums")
        ids = touched.select("product_id")
        return snapshots.write({
            "sums": old.join(ids, "product_id", "left_anti").unionByName(touched),
            "forecast": stored["forecast"].join(ids, "product_id", "left_anti").unionByName(self._days(touched, profile)),
        }, self.root)

    # -- reading ---------------------------------------------------------------------------

    def _read(self, version: int | None) -> DataFrame:
        return snapshots.read(self.spark, self.root, version)["forecast"]

    def _dealt(self, version: int | None) -> DataFrame:
        """The forecast days, dealt by product into as many parts as their number asks for."""
        days, n = self._read(version), snapshots.n_rows(self.spark, self.root, "forecast", version)
        if n <= TASK_ROWS * self.spark.sparkContext.defaultParallelism:
            return days
        return days.repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), "product_id")

    def _with_stock(self, stock: DataFrame | None, version: int | None) -> DataFrame:
        days = self._dealt(version)
        if stock is None:
            return days.withColumn("current_stock", F.lit(policy.DEFAULT_STOCK).cast("bigint"))
        return products.with_stock(days, stock)

    def forecast(self, version: int | None = None) -> DataFrame:
        return forecast.contract(self._read(version))

    def stock_projection(self, stock: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """`stock` has one row per product, as `products.latest_stock` gives it."""
        return replenish.stock_projection(self._with_stock(stock, version))

    def reorder_plan(self, stock: DataFrame | None = None, version: int | None = None) -> DataFrame:
        return replenish.reorder_plan(self._with_stock(stock, version))

    def prices(self, days_ahead: int = pricing.PAGE_DAYS, version: int | None = None) -> DataFrame:
        if days_ahead > self.days_ahead:
            raise ValueError(f"{self.days_ahead} days are stored, not {days_ahead}")
        return pricing.suggest(self._read(version).filter(F.datediff("date", "last_date") <= days_ahead))
