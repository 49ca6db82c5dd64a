"""Shards of near equal bytes through fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots, far more than shards. Only bytes and rows per slot are
gathered (one row per slot), and only the map is edited when shards become uneven: a slot keeps its
shard as long as that shard stays below the mean, the others go to the lightest shard. Rows are
hashed, never sorted over all the data, and a row's place in its shard is its place in its slot plus
the rows of the shard's earlier slots.

Defined results: a null text has no bytes; null ids, empty texts and repeated rows are sharded like
any others (rows equal in id and text share a slot); an empty table gives no rows. Further columns of
the input are kept by `assign`, none of them is read; an input column with the name of one of ours is
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.llm import text
from ripecast.sources.files import materialize

SLOTS = 4096
ROW_BYTES = 16  # fixed value: what a record takes besides its text


def virtual_slot(doc_id: str, digest: str, slots: int = SLOTS):
    """Slot of a record; the text's checksum spreads rows that share an id or have none."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(digest)), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds size, text_crc32 and virtual_slot to the documents."""
    text.require(docs, "doc_id", "text")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({
        "size": text.utf8_bytes(F.col("text")) + ROW_BYTES,
        "text_crc32": F.crc32(body.cast("binary")),
    }).withColumn("virtual_slot", virtual_slot("doc_id", "text_crc32", slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per slot in use: at most one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def slot_map(sizes: DataFrame, shards: int, slots: int = SLOTS, previous: DataFrame | None = None) -> DataFrame:
    """The next version of the map: (version, virtual_slot, shard, moved, bytes, n, first_place), a row per slot.

    `previous` is the stored map to edit; without one, version 0 deals slots out in turn. Heavy slots
    are placed first and stay if their shard remains within the mean; what is left over, the light
    slots, fills the lightest shards. The fold runs over an array with one element per slot, which
    is the fixed number `slots` whatever the data.
    """
    if shards < 1 or slots < shards:
        raise ValueError("need 1 <= shards <= slots")
    spark = sizes.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    known = every.join(sizes, "virtual_slot", "left")
    if previous is None:
        known = known.withColumns({"old": F.pmod("virtual_slot", F.lit(shards)).cast("int"), "version": F.lit(0)})
    else:
        was = previous.select("virtual_slot", F.col("shard").alias("old"), "version")
        known = known.join(was, "virtual_slot", "left").withColumns({
            "old": F.when(F.col("old") < shards, F.col("old")), "version": F.max("version").over(W.partitionBy()),
        }).withColumn("old", F.coalesce("old", F.pmod("virtual_slot", F.lit(shards)).cast("int")))
    one = known.agg(
        F.max("version").alias("version"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total"),
        # Sorted by -bytes, then slot.
        F.sort_array(F.collect_list(F.struct(
            (-F.coalesce("bytes", F.lit(0))).cast("bigint").alias("minus"), "virtual_slot", "old",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        ))).alias("todo"),
    ).withColumn("mean", F.ceil(F.col("total") / shards).cast("bigint"))
    start = "CAST(array_repeat(0L, {n}) AS array<bigint>)".format(n=shards)
    kept = one.withColumn("kept", F.expr(f"""
        aggregate(todo, named_struct('loads', {start}, 'placed', CAST(array() AS array<int>)),
          (a, s) -> if(a.loads[s.old] - s.minus <= mean,
            named_struct('loads', transform(a.loads, (v, i) -> if(i = s.old, v - s.minus, v)), 'placed', array_append(a.placed, s.old)),
            named_struct('loads', a.loads, 'placed', array_append(a.placed, -1))))"""))
    dealt = kept.withColumn("dealt", F.expr("""
        aggregate(arrays_zip(todo, kept.placed), named_struct('loads', kept.loads, 'placed', CAST(array() AS array<int>), 'lightest', 0),
          (a, s) -> if(s.placed >= 0,
            named_struct('loads', a.loads, 'placed', array_append(a.placed, s.placed), 'lightest', 0),
            named_struct(
              'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v - s.todo.minus, v)),
              'placed', array_append(a.placed, CAST(array_position(a.loads, array_min(a.loads)) - 1 AS int)), 'lightest', 0)),
          a -> a.placed)"""))
    rows = dealt.select("version", F.explode(F.arrays_zip("todo", "dealt")).alias("s")).select(
        (F.col("version") + 1).alias("version"), F.col("s.todo.virtual_slot").alias("virtual_slot"),
        F.col("s.dealt").alias("shard"), (F.col("s.dealt") != F.col("s.todo.old")).alias("moved"),
        (-F.col("s.todo.minus")).alias("bytes"), F.col("s.todo.n").alias("n"),
    )
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("first_place", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


def stored_map(spark: SparkSession, rows: DataFrame, shards: int, slots: int = SLOTS,
               previous: DataFrame | None = None) -> DataFrame:
    """The map of measured rows, written to the shared folder, so that every reader sees one version."""
    return materialize(slot_map(slot_sizes(rows), shards, slots, previous), "slot-map")


def assign(docs: DataFrame, shards: int, slots: int = SLOTS, previous: DataFrame | None = None,
           with_place: bool = True) -> DataFrame:
    """Documents with shard, size, text_crc32, virtual_slot, map_version and `slot`, the place in the shard from 0.

    Without `with_place` no row is moved at all: the map is joined to the rows where they are. It has
    one row per virtual slot, a fixed number, and is therefore safe to broadcast.
    """
    rows = measured(docs, slots)
    current = stored_map(docs.sparkSession, rows, shards, slots, previous)
    known = F.broadcast(current.select("virtual_slot", "shard", "first_place", F.col("version").alias("map_version")))
    placed = rows.drop("shard", "slot", "first_place", "map_version").join(known, "virtual_slot")
    if not with_place:
        return placed.drop("first_place")
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn(
        "slot", (F.row_number().over(order) - 1 + F.col("first_place")).cast("bigint")
    ).drop("first_place")
