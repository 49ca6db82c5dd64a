"""Model features: calendar columns and label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.functions import calendar
from ripecast.sources.files import materialize

# The columns that get a label code, and the model's feature list.
ENCODED = ("product_id", "product_name", "category")
FEATURES = (
    "product_id_encoded", "product_name_encoded", "category_encoded",
    "unit_price", "month", "day", "day_of_week", "quarter", "day_of_year",
    "is_weekend", "is_summer", "is_winter", "is_spring", "is_fall",
    "shelf_life_days",
)
TARGET = "quantity_sold"

# Within one product the codes are constant, so a model per product can leave them out.
PRODUCT_FEATURES = FEATURES[len(ENCODED):]


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Date parts, weekend flag and the four season flags."""
    day = F.col(date)
    return df.withColumns(
        calendar.date_parts(day) | calendar.season_flags(day) | {"is_weekend": calendar.is_weekend(day)}
    )


def label_codes(df: DataFrame, columns: tuple[str, ...] = ENCODED) -> DataFrame:
    """Code of every distinct value: its 0-based rank in sorted order, as (column_name, value, code).

    A global rank must not sort all values in one task. The distinct values are range-sorted and
    stored once, which fixes their partitions; a value's rank is then its place in its partition
    plus the sizes of the partitions before it.
    """
    values = (
        df.select(*(F.col(c).cast("string").alias(c) for c in columns))
        .unpivot([], list(columns), "column_name", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    placed = (
        values.repartitionByRange("column_name", "value")
        .sortWithinPartitions("column_name", "value")
        .select(
            "column_name", "value",
            F.spark_partition_id().alias("part"),
            # Low 33 bits: position within the partition.
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    placed = materialize(placed, "label-codes")
    # At most one row per partition and column: a window without partitions is safe.
    sizes = placed.groupBy("column_name", "part").agg(
        F.count("*").alias("n"), F.min("place").alias("first_place")
    )
    before = F.sum("n").over(
        W.partitionBy("column_name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "column_name", "part", (F.coalesce(before, F.lit(0)) - F.col("first_place")).alias("offset")
    )
    coded = placed.join(F.broadcast(offsets), ["column_name", "part"]).select(
        "column_name", "value", (F.col("place") + F.col("offset")).cast("bigint").alias("code")
    )
    # Stored finished: encoding reads it once per column.
    return materialize(coded, "codes")


def encode(df: DataFrame, codes: DataFrame, columns: tuple[str, ...] = ENCODED) -> DataFrame:
    """Adds `<column>_encoded`. Values without a code share one that follows the known ones.

    Best on one row per product, joined to its days afterwards.
    """
    # One row per column.
    sizes = {r["column_name"]: r["n"] for r in codes.groupBy("column_name").agg((F.max("code") + 1).alias("n")).collect()}
    for column in columns:
        known = codes.filter(F.col("column_name") == column)
        table = known.select(F.col("value").alias(column), F.col("code").cast("double").alias(f"{column}_encoded"))
        df = df.join(table, column, "left")
        unseen = F.lit(float(sizes.get(column, 0)))
        df = df.withColumn(f"{column}_encoded", F.coalesce(F.col(f"{column}_encoded"), unseen))
    return df


def feature_matrix(df: DataFrame, with_target: bool = True) -> DataFrame:
    """Only the model's columns, and the target where the table has it."""
    target = [TARGET] if with_target and TARGET in df.columns else []
    return df.select(*FEATURES, *target)
