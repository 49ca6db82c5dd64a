"""Corpus preparation: rules, near copies, benchmark leaks, source mix, shards.

Every stage takes and, but for the last, gives the columns of `documents`. Its result is written to the shared folder
and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripecast.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from ripecast.llm.queries import SHARDS, table
from ripecast.sources.files import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    A null or empty text has too few words and goes. Every row is judged by its own text: repeated rows and rows with a null id
    stay or go alike. Without labels the base rules decide alone. Of the columns only those of `documents` are read and given.
    """
    judged = quality_rules.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by five-word shingles at 80 % Jaccard share.

    The smallest id stays; a null id is greater than any other. Rows are told apart by a stored number, so of repeated rows, and of
    equal texts without an id, one stays (the lowest number, which is arbitrary). Texts that are null, empty or without words
    are linked with nothing and all stay. Of the columns only those of `documents` are read and given.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = materialize(jaccard_join.join(rows.select(F.col("row").alias("doc_id"), "text")), "near-duplicates")
    linked = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    members = linked.unionAll(linked.select("group").distinct().select(F.col("group").alias("row"), "group"))
    heads = rows.select("row", "doc_id").join(members, "row").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    gone = materialize(members.join(heads.select(F.col("head.row").alias("row")), "row", "left_anti").select("row"), "copies")
    return jaccard_join.of_ids(rows, gone, "row", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, also one with a fifth of its words changed.

    Every row is judged by its own text, so repeated rows and rows with a null id stay or go alike. Null and empty texts stay, as
    all do without items. Of the columns only those of `documents` are read and given.
    """
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson number with their source's target rate, in global random order.

    The number is drawn by id: rows that share one, and rows without, are drawn alike within a source. A null source counts as the
    empty one; a source without a byte of text has rate 0. Of the columns only those of `documents` are read and given.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard; the map is the sharding operator's.

    No row is lost: repeated rows and rows without an id or text are dealt like all others. Of the columns only those of
    `documents` are read.
    """
    return sharding.assign(docs.select(*COLUMNS), SHARDS, with_place=False).select(
        *COLUMNS, "size", "virtual_slot", "shard", "map_version")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", shards),
]

# Learned rules and Poisson inversion over floating point can't be repeated in DuckDB SQL; tests compare the
# kept rows of the second and third stage with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
