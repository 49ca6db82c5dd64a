"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ripecast.sources.files import materialize


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges written to the shared folder, with their number and a checksum taken while writing."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("sum"))
    now = materialize(marked, "edges")
    return now, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones and itself, are hung
    on the smallest node around. Each keeps one row per node and edge at most, so a node with very many
    neighbours is a key with many short rows, summed before the shuffle and joined to one row (AQE splits it).
    Every round is written to the shared folder.
    """
    now, mark = _stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node whose neighbours are all smaller has its edges only in their direction; none is lost.
        large = large.filter("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(
            down.select("a", F.col("m").alias("b")))
        last = mark
        now, mark = _stored(small.distinct())
        if last == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
