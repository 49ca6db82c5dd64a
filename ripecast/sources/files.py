"""CSV and Parquet in and out."""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.sources import contracts

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Fail before any work if an input is missing; works for every file system Spark can reach."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(conf).exists(target):
            missing.append(path)
    if missing:
        raise ValueError(f"missing input(s): {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header line, or any columnar format.

    Without a schema CSV columns stay text, named by the header: no type inference pass over the
    data. The contract step casts them.
    """
    if fmt not in ("csv", "parquet", "orc"):
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8")
    return reader.format(fmt).load(path)


def read_sales(
    spark: SparkSession, path: str, fmt: str = "csv", inventory: DataFrame | None = None, **options: object
) -> DataFrame:
    return contracts.canonical_sales(read_table(spark, path, fmt), inventory, **options)


def read_inventory(spark: SparkSession, path: str, fmt: str = "csv", **options: object) -> DataFrame:
    return contracts.canonical_inventory(read_table(spark, path, fmt), **options)


def read_customers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Customer columns pass through; only a `date` column, if there is one, is typed."""
    df = read_table(spark, path, fmt)
    return contracts.parse_day(df) if "date" in df.columns else df


class Dataset(NamedTuple):
    sales: DataFrame
    inventory: DataFrame
    customers: DataFrame


def read_dataset(spark: SparkSession, sales: str, inventory: str, customers: str, fmt: str = "csv") -> Dataset:
    """The three input tables; fails before reading any if one is missing."""
    require_paths(spark, sales, inventory, customers)
    stock = read_inventory(spark, inventory, fmt)
    return Dataset(read_sales(spark, sales, fmt, stock), stock, read_customers(spark, customers, fmt))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, by_month: bool = False) -> None:
    """Parquet, optionally in one folder per sales month.

    The rebalance hint lets AQE cut large months into several files and merge small ones.
    """
    if not by_month:
        df.write.mode("overwrite").parquet(path)
        return
    monthly = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    monthly.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(path)


def save_dataset(sales: DataFrame, inventory: DataFrame, output_dir: str) -> None:
    """Both tables as CSV below one folder."""
    write_csv(sales, f"{output_dir}/sales")
    write_csv(inventory, f"{output_dir}/inventory")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by spark.checkpoint.dir.

    Only a local session may do without that setting: there driver and tasks share one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        import tempfile

        root = tempfile.mkdtemp(prefix="ripecast-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and freezes the rows.

    Nothing reads the shuffles of the write again, so their files go as soon as it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
