"""Table contracts, and the step that brings any source table into them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.functions import calendar, measures, numeric
from ripecast.functions.policy import DEFAULT_REORDER_LEVEL, DEFAULT_SHELF_LIFE, DEFAULT_STOCK

# Source-language column names and the contract names they stand for.
SALES_ALIASES = {
    "quantite_vendue": "quantity_sold",
    "prix_unitaire_xof": "unit_price",
    "chiffre_affaires_xof": "revenue",
    "cout_total_xof": "cost",
    "profit_xof": "profit",
    "saison": "season",
    "est_weekend": "is_weekend",
}
INVENTORY_ALIASES = {
    "stock_actuel": "current_stock",
    "seuil_reapprovisionnement": "reorder_level",
    "duree_conservation_jours": "shelf_life_days",
}

# `row_order` is the position of a row in arrival order, rising with the date: "first" and
# "last" row of a product mean its smallest and largest value.
SALES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity_sold", T.LongType()),
    T.StructField("unit_price", T.DecimalType(12, 2)),
    T.StructField("revenue", T.DecimalType(18, 2)),
    T.StructField("profit", T.DecimalType(18, 4)),
    T.StructField("season", T.StringType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("shelf_life_days", T.IntegerType()),
    T.StructField("row_order", T.LongType()),
])
INVENTORY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("current_stock", T.LongType()),
    T.StructField("reorder_level", T.LongType()),
    T.StructField("shelf_life_days", T.IntegerType()),
    T.StructField("row_order", T.LongType()),
])

REQUIRED_SALES = ("date", "product_id", "product_name", "category", "quantity_sold", "unit_price", "revenue", "profit")
REQUIRED_INVENTORY = ("date", "product_id", "current_stock")


def require_columns(df: DataFrame, columns: Iterable[str], table: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing required column(s) {', '.join(missing)}")


def parse_day(df: DataFrame, column: str = "date", strict: bool = True) -> DataFrame:
    """ISO text or timestamp to DATE. `strict=False` turns unparseable text into NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        parse = F.to_date if strict else F.try_to_date
        return df.withColumn(column, parse(F.col(column), calendar.ISO_DATE))
    return df.withColumn(column, F.col(column).cast("date"))


def _conform(df: DataFrame, schema: T.StructType, tie_column: str | None) -> DataFrame:
    """Contract columns in contract types; `row_order` from the table, the tie column or the contents."""
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in schema if f.name != "row_order"}
    if "row_order" in df.columns:
        order = F.col("row_order").cast("bigint")
    elif tie_column is not None:
        order = numeric.row_order(F.col("date"), F.col(tie_column))
    else:
        # Typed contents, so that the same row orders alike whatever file format it came from.
        order = numeric.row_order(F.col("date"), numeric.content_tie(*typed.values()))
    return df.select(*(c.alias(name) for name, c in typed.items()), order.alias("row_order"))


def _with_default(df: DataFrame, column: str, default: object) -> DataFrame:
    if column not in df.columns:
        return df.withColumn(column, F.lit(default))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def canonical_inventory(df: DataFrame, tie_column: str | None = None, strict_dates: bool = True) -> DataFrame:
    """Any accepted stock table in the contract's names, types and defaults.

    `tie_column` is a non-negative row number below 2**46 that orders rows of one product and day.
    """
    df = df.withColumnsRenamed(INVENTORY_ALIASES)
    require_columns(df, REQUIRED_INVENTORY, "inventory")
    df = parse_day(df, strict=strict_dates)
    df = _with_default(df, "reorder_level", DEFAULT_REORDER_LEVEL)
    df = _with_default(df, "shelf_life_days", DEFAULT_SHELF_LIFE)
    return _conform(df, INVENTORY_SCHEMA, tie_column)


def canonical_sales(
    df: DataFrame,
    inventory: DataFrame | None = None,
    tie_column: str | None = None,
    strict_dates: bool = True,
) -> DataFrame:
    """Any accepted sales table in the contract's names, types and defaults.

    Without a shelf-life column the product's latest `inventory` row (contract form) supplies it.
    """
    df = df.withColumnsRenamed(SALES_ALIASES)
    require_columns(df, REQUIRED_SALES, "sales")
    df = parse_day(df, strict=strict_dates)
    day = F.col("date")
    if "season" not in df.columns:
        df = df.withColumn("season", calendar.climate_season(day))
    if "is_weekend" not in df.columns:
        df = df.withColumn("is_weekend", calendar.is_weekend(day))
    if "shelf_life_days" not in df.columns and inventory is not None:
        shelf = inventory.groupBy("product_id").agg(
            F.max_by("shelf_life_days", "row_order").alias("shelf_life_days")
        )
        df = df.join(shelf, "product_id", "left")
    df = _with_default(df, "shelf_life_days", DEFAULT_SHELF_LIFE)
    return _conform(df, SALES_SCHEMA, tie_column)


def with_stock_default(df: DataFrame) -> DataFrame:
    """`current_stock` where the table has it, the default level otherwise."""
    return _with_default(df, "current_stock", DEFAULT_STOCK).withColumn(
        "current_stock", F.col("current_stock").cast("bigint")
    )


def with_sale_measures(df: DataFrame, summed: bool = False) -> DataFrame:
    """Revenue, cost and profit from quantity, unit price and unit cost.

    `summed` rows stand for many sales each and get wider types.
    """
    require_columns(df, ("quantity_sold", "unit_price", "unit_cost"), "sales")
    money, fine = (measures.TOTAL_MONEY, measures.TOTAL_PROFIT) if summed else (measures.MONEY, measures.PROFIT)
    df = df.withColumns({
        "revenue": measures.revenue(F.col("quantity_sold"), F.col("unit_price"), money),
        "cost": measures.cost(F.col("quantity_sold"), F.col("unit_cost"), fine),
    })
    return df.withColumn("profit", measures.profit(F.col("revenue"), F.col("cost"), fine))
