"""Exact duplicates by two-pass Bloom filtering.

Every row gets the sha256 of its normalised text. The first pass counts how often each of two filter
positions per digest is asked for, one short row per position after the map-side sum, and keeps the
positions asked for twice or more as a Bloom filter, in segments of 4 KB. The second pass probes it: a digest with a
position that no other row asked for can't occur twice, and its row passes straight through, unshuffled. The
other rows, those that are repeated and a few that only share both positions with others, are numbered,
written once to the shared folder and settled by their full digests.

A group of copies is summed map-side to one row per digest and task, and its rows meet the sum in an
equi-join whose hot partition Spark splits: no group is gathered in a task.

The filter has `BITS_PER_ROW` bits a row, at most `BROADCAST_BYTES` of them broadcast: that size is known before
anything is counted. Beyond it the rows' digests travel to the filter's segments by an equi-join instead,
for the same result.

Defined results: a null text counts as empty and equals one; every white-space run becomes one space, at the ends too, so " a"
is not "a". Equal texts are those with equal sha256 (no byte comparison follows). Of rows equal in
text and id one stays, the others go; a null id ranks after every number, so keep_id is null only if all ids of the group are.
An empty table gives no rows. Further columns are kept, those with the names of ours replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripecast.llm import text
from ripecast.sources.files import materialize

BITS_PER_ROW = 16
SEGMENT_BITS = 32_768  # fixed value: bits of a bitmap that Spark's bitmap aggregate builds
LEAST_SEGMENTS = 32
BROADCAST_BYTES = 64 << 20

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def digest(body: Column) -> Column:
    """sha256 of the text with every white-space run as one space."""
    whole = F.coalesce(body.cast("string"), F.lit(""))
    return F.sha2(F.regexp_replace(whole, text.SPACE, " ").cast("binary"), 256)


def with_digest(docs: DataFrame) -> DataFrame:
    text.require(docs, "doc_id", "text")
    return docs.drop(*RESULTS).withColumn("text_sha256", digest(F.col("text")))


def segments_for(n_rows: int) -> int:
    """Segments of a filter with BITS_PER_ROW bits a row, a power of two."""
    need = max(LEAST_SEGMENTS, -(-n_rows * BITS_PER_ROW // SEGMENT_BITS))
    return 1 << (need - 1).bit_length()


def _places(digests: DataFrame, segments: int) -> DataFrame:
    """Adds the digest's segment and its two bits there, never the same bit twice."""
    h = F.xxhash64("text_sha256")
    first = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SEGMENT_BITS - 1))
    step = F.pmod(F.shiftrightunsigned(h, 47), F.lit(SEGMENT_BITS - 1)) + 1
    return digests.withColumns({
        "__segment": F.pmod(h, F.lit(segments)).cast("int"), "__bit1": first.cast("int"),
        "__bit2": F.pmod(first + step, F.lit(SEGMENT_BITS)).cast("int"),
    })


def repeated_filter(digests: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the positions that two or more rows ask for; segments without any are left out."""
    asked = _places(digests.select("text_sha256"), segments).select(
        F.col("__segment").alias("segment"), F.explode(F.array("__bit1", "__bit2")).alias("bit"))
    often = asked.groupBy("segment", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return often.groupBy("segment").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))


def _is_set(bits: str, bit: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.expr("1").bitwiseAND(F.call_function("shiftright", byte, F.col(bit).bitwiseAND(F.lit(7)))) == 1


def probe(digests: DataFrame, found: DataFrame, segments: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds __maybe: whether both positions of the row's digest are set in the filter."""
    fits = segments * SEGMENT_BITS // 8 <= broadcast_bytes
    side = found.select(F.col("segment").alias("__segment"), F.col("bits").alias("__bits"))
    rows = _places(digests, segments).join(F.broadcast(side) if fits else side.hint("merge"), "__segment", "left")
    maybe = F.col("__bits").isNotNull() & _is_set("__bits", "__bit1") & _is_set("__bits", "__bit2")
    return rows.withColumn("__maybe", F.coalesce(maybe, F.lit(False))).drop("__segment", "__bit1", "__bit2", "__bits")


def _settled(rows: DataFrame) -> DataFrame:
    """RESULTS of rows whose digest may be repeated, by their full digests; the rows are stored and numbered first."""
    stored = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "repeated-digests")
    # One row per digest and id after the map-side sum, then one per digest: only numbers are carried.
    by_id = stored.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("row"))
    groups = by_id.groupBy(F.col("text_sha256").alias("__digest")).agg(
        F.sum("n").alias("group_size"), F.min("doc_id").alias("keep_id"),
        F.expr("coalesce(min_by(row, doc_id) FILTER (WHERE doc_id IS NOT NULL), min(row))").alias("__keep"))
    # Stored, so that the join's sides are plain exchanges, of which Spark splits a hot digest's.
    met = stored.join(materialize(groups, "digest-groups"), F.col("text_sha256") == F.col("__digest"))
    return met.withColumn("kept", F.col("__row") == F.col("__keep")).drop("__row", "__keep", "__digest")


def judge(digests: DataFrame, n_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `with_digest` with keep_id, group_size and kept.

    `n_rows` sizes the filter (counted if not given); another number changes how many rows pass straight
    through, never the result. The rows are read three times: store them first if that costs more than writing them.
    """
    segments = segments_for(digests.count() if n_rows is None else n_rows)
    found = materialize(repeated_filter(digests, segments), "repeated-filter")
    probed = probe(digests, found, segments, broadcast_bytes)
    alone = probed.filter("NOT __maybe").withColumns({
        "keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    columns = [*(c for c in digests.columns if c not in RESULTS), *RESULTS]
    return alone.select(columns).unionByName(_settled(probed.filter("__maybe").drop("__maybe")).select(columns))


def classes(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One narrow row per document: doc_id and RESULTS. The texts are read once."""
    stored = materialize(with_digest(docs).select("doc_id", "text_sha256"), "digests")
    return judge(stored, broadcast_bytes=broadcast_bytes)


def dedup(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; of the texts only possibly repeated ones are moved."""
    return judge(with_digest(docs), broadcast_bytes=broadcast_bytes).filter("kept").drop(*RESULTS)
