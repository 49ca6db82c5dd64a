"""Sales and inventory tables out of an order-line fact and a part dimension.

    sales        one row per order line: date, product, quantity, price, revenue, profit
    inventory    the stock level seen at each order line
    products     one row per part

`product_key` is the part number. Facts carry only that number, so that a forecast can aggregate
first and join the dimension afterwards, at one row per product instead of one per order line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.functions import calendar, numeric
from ripecast.sources import contracts

# Stated, so that opening a table reads no file footers.
SCHEMAS = {
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]),
}


def product_id(key: Column) -> Column:
    text = key.cast("string")
    return F.concat(F.lit("P"), F.lpad(text, F.greatest(F.lit(9), F.length(text)), F.lit("0")))


def product_key(product_id_: str) -> int:
    """The part number inside a product id, so that an id filter can reach the scan."""
    return int(product_id_[1:])


class StarTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.root}/{name}.parquet")

    def _lines(self, start: dt.date | None, end: dt.date | None, only_product: str | None) -> DataFrame:
        lines = self._table("lineitem")
        # On the stored column, not on a cast of it: these reach the Parquet reader.
        if start is not None:
            lines = lines.filter(F.col("l_shipdate") >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        if end is not None:
            after = end + dt.timedelta(days=1)
            lines = lines.filter(F.col("l_shipdate") < F.lit(after.isoformat()).cast("timestamp_ntz"))
        if only_product is not None:
            lines = lines.filter(F.col("l_partkey") == product_key(only_product))
        return lines

    @staticmethod
    def _fact_columns() -> dict[str, Column]:
        day = F.col("l_shipdate").cast("date")
        # With line numbers below 8 the tie orders by (order, line).
        line = F.col("l_orderkey") * 8 + numeric.within(F.col("l_linenumber").cast("bigint"), 8, "line number")
        return {
            "product_key": F.col("l_partkey"),
            "date": day,
            "quantity_sold": F.expr("CAST(l_quantity AS BIGINT) DIV (1 + l_partkey % 4)"),
            "current_stock": 50 + (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 251,
            "row_order": numeric.row_order(day, line),
        }

    def facts(
        self, start: dt.date | None = None, end: dt.date | None = None, only_product: str | None = None
    ) -> DataFrame:
        """Quantities and stock levels by `product_key`, without any join."""
        columns = self._fact_columns()
        return self._lines(start, end, only_product).select(*(c.alias(n) for n, c in columns.items()))

    def products(self) -> DataFrame:
        """The product dimension; attributes do not change over time in this schema."""
        price = F.col("p_retailprice").cast("decimal(12,2)")
        return self._table("part").select(
            F.col("p_partkey").alias("product_key"),
            product_id(F.col("p_partkey")).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            (3 + F.col("p_size") % 13).alias("shelf_life_days"),
            price.alias("unit_price"),
            (price * F.expr("0.50 + 0.05 * (p_partkey % 5)")).cast("decimal(18,4)").alias("unit_cost"),
            price.cast("double").alias("base_price"),
            price.cast("double").alias("mean_price"),
        )

    def sold_products(self) -> DataFrame:
        """Products with at least one order line; keys are made distinct before they meet the dimension."""
        keys = self.facts().select("product_key").distinct()
        return self.products().join(keys, "product_key", "left_semi")

    def priced_facts(self, **bounds: object) -> DataFrame:
        """Facts with the product's attributes, and with revenue, cost and profit."""
        return contracts.with_sale_measures(self.facts(**bounds).join(self.products(), "product_key"))

    def totals(self, *by: str, **bounds: object) -> DataFrame:
        """Sales already summed per product and `by` (date, season, is_weekend).

        For reports that only add up measures. Units are summed before the product dimension and
        its prices come in, so the join and the decimal arithmetic see a row per product, not per
        order line, and a best-seller leaves each map task as one row. `n_sales` counts the lines.
        """
        day = F.col("date")
        facts = self.facts(**bounds).withColumns(
            {"season": calendar.climate_season(day), "is_weekend": calendar.is_weekend(day)}
        )
        summed = facts.groupBy("product_key", *by).agg(
            F.sum("quantity_sold").alias("quantity_sold"), F.count("*").alias("n_sales")
        )
        return contracts.with_sale_measures(summed.join(self.products(), "product_key"), summed=True)

    def sales(self, **bounds: object) -> DataFrame:
        """The sales contract."""
        return contracts.canonical_sales(self.priced_facts(**bounds))

    def inventory(self, **bounds: object) -> DataFrame:
        """The inventory contract."""
        rows = self.facts(**bounds).join(self.products(), "product_key")
        return contracts.canonical_inventory(rows)

    def source_language_sales(self) -> DataFrame:
        """Sales as the upstream export names them; shelf life is only in the stock export."""
        return self.priced_facts().select(
            "date", "product_id", "product_name", "category",
            F.col("quantity_sold").alias("quantite_vendue"),
            F.col("unit_price").alias("prix_unitaire_xof"),
            F.col("revenue").alias("chiffre_affaires_xof"),
            F.col("cost").alias("cout_total_xof"),
            F.col("profit").alias("profit_xof"),
            calendar.climate_season(F.col("date")).alias("saison"),
            calendar.is_weekend(F.col("date")).alias("est_weekend"),
            "row_order",
        )

    def source_language_inventory(self) -> DataFrame:
        return self.facts().join(self.products(), "product_key").select(
            "date", "product_id",
            F.col("current_stock").alias("stock_actuel"),
            F.lit(30).alias("seuil_reapprovisionnement"),
            F.col("shelf_life_days").alias("duree_conservation_jours"),
            "row_order",
        )

    def customers(self) -> DataFrame:
        customers = self._table("customer")
        return contracts.parse_day(customers) if "date" in customers.columns else customers
