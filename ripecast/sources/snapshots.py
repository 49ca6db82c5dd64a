"""Tables that change together: versioned folders and one manifest, written last.

Two overwritten folders may end up as new sales beside old stock when a job fails between them. Here every version's tables go
to a folder of their own, and a small manifest names it once all of them are complete. Readers take the newest finished manifest, so they see
all tables of one version or all of another. Nothing is overwritten: older versions stay readable until they are removed.

A manifest counts once its folder holds the file that Spark's writer leaves last, on any file system that Spark reaches. Of two writers
that reach for the same number one fails, with its tables unread. Rows are counted while they are written, and `verify` counts them again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version bigint, name string, folder string, format string, schema string, rows bigint"
FORMATS = ("parquet", "orc", "csv")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions, oldest first."""
    target, fs = _file_system(spark, f"{root}/manifests")
    if not fs.exists(target):
        return []
    found = []
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name))
    return sorted(found)


def _taken(spark: SparkSession, root: str) -> int:
    """The highest number that any manifest, finished or not, has."""
    target, fs = _file_system(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def write(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> int:
    """Writes all tables as one new version and gives its number; a failure on the way leaves the previous version current."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if not tables:
        raise ValueError("a version needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    folder, lines = f"tables/{uuid.uuid4().hex}", []
    for name, df in tables.items():
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        if fmt == "csv":
            writer = writer.option("header", True).option("encoding", "UTF-8")
        writer.format(fmt).save(f"{root}/{folder}/{name}")
        lines.append((name, f"{folder}/{name}", fmt, df.schema.json(), seen.get["rows"]))
    version = _taken(spark, root) + 1
    manifest = spark.createDataFrame([(version, *line) for line in lines], MANIFEST)
    manifest.coalesce(1).write.json(f"{root}/manifests/{version}")
    return version


def _manifest(spark: SparkSession, root: str, version: int | None) -> list[Row]:
    """One row per table of a version, the newest finished one if none is named."""
    there = versions(spark, root)
    if not there:
        raise ValueError(f"no finished version below {root}")
    if version is None:
        version = there[-1]
    if version not in there:
        raise ValueError(f"no finished version {version} below {root}")
    return spark.read.schema(MANIFEST).json(f"{root}/manifests/{version}").collect()


def n_rows(spark: SparkSession, root: str, name: str, version: int | None = None) -> int:
    """Rows of a version's table as its manifest states them: nothing is counted again."""
    return next(line.rows for line in _manifest(spark, root, version) if line.name == name)


def read(spark: SparkSession, root: str, version: int | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a version, the newest finished one if none is named, by name and with the types they were written with."""
    tables = {}
    for line in _manifest(spark, root, version):
        reader = spark.read.schema(T.StructType.fromJson(json.loads(line.schema)))
        if line.format == "csv":
            reader = reader.option("header", True).option("encoding", "UTF-8")
        tables[line.name] = reader.format(line.format).load(f"{root}/{line.folder}")
        if verify and (rows := tables[line.name].count()) != line.rows:
            raise ValueError(f"{line.name} of version {line.version} has {rows} rows, {line.rows} were written")
    return tables
