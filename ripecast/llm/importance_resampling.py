"""Resampling towards a target distribution by importance weights over hashed word runs.

A feature is a word or, with `longest=2`, also a pair of neighbouring words; its bucket is the crc32 of its bytes
modulo `buckets`. What the corpus and the target hold per bucket gives each bucket a gain, a document's
weight is the sum of its features' gains, and the largest weights, with Gumbel noise hashed from seed and id, are drawn.

The vocabulary is split. Words that make up a `head`-th part of some block of text are its candidates, so that no word with
such a share of the corpus is missed; the `head` most frequent of them are broadcast with the checksum
state after the word, and pairs of them, chosen alike, with their finished bucket. All other words and
pairs, the tail, get their crc32 directly, a pair from its first word's state where that is known. Both ways
give the same numbers, so the head only saves time, and totals per bucket are exact over all texts.

Bounds: the head is at most `head` words of up to HEAD_BYTES bytes and as many pairs (some 4 MB, whatever the corpus); totals and gains have a row per
bucket; texts are handled in blocks of BLOCK_BYTES, a longer document is one block. Ranks come from range-sorted files, never from one sorted task.

Defined results: a null text has no words; a document without features weighs 0; a null id hashes like an empty one and loses
ties; rows equal in id are told apart by their place in the stored scores, arbitrarily; an empty table gives no rows, an empty
target makes rare buckets gain. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import text
from ripecast.llm.exchange import release
from ripecast.sources.files import materialize

BUCKETS = 10_000
HEAD = 20_000
HEAD_BYTES = 64
BLOCK_BYTES = 3 << 20
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
QUANTILE_ACCURACY = 10_000

# ASCII letters in lower case, digits and every byte of a longer character stay; all else separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = T.StructType([
    T.StructField("feature", T.BinaryType()), T.StructField("pair", T.BooleanType()), T.StructField("n", T.LongType())])
TOTALS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
WEIGHED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])


def words_in(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the words by code (binary), and each text's offsets into the codes."""
    body = pc.fill_null(texts.cast(pa.large_string()), "")
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    offsets = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8)
    raw = body.buffers()[2]
    # One byte for one byte, so the offsets stay right.
    plain = (raw.to_pybytes() if raw is not None else b"").translate(_WORD_BYTES)
    same = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(body), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(plain)])
    codes, words, places = text.coded_words(same.view(pa.large_string()), lower=False)
    return codes.astype(np.int64), words.cast(pa.large_binary()), places


def pairs_of(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word of every pair of neighbours within a text, and each text's offsets into the pairs."""
    first = np.ones(len(codes), bool)
    ends = places[1:][np.diff(places) > 0] - 1
    first[ends] = False
    return np.flatnonzero(first), np.concatenate([[0], np.cumsum(first)])[places]


class Head:
    """Frequent words with their checksum states, frequent pairs with their buckets."""

    def __init__(self, words: dict[bytes, int], pairs: dict[bytes, int], buckets: int):
        self.words, self.pairs, self.buckets = words, pairs, buckets

    def states(self, words: list[bytes]) -> np.ndarray:
        """crc32 of each word: from the head, or directly."""
        known, crc = self.words.get, zlib.crc32
        return np.fromiter((crc(w) if (s := known(w)) is None else s for w in words), np.int64, len(words))

    def pair_buckets(self, firsts: list[bytes], states: list[int], seconds: list[bytes]) -> np.ndarray:
        known, crc, n = self.pairs.get, zlib.crc32, self.buckets
        return np.fromiter(
            (crc(b" " + b, s) % n if (k := known(a + b" " + b)) is None else k for a, s, b in zip(firsts, states, seconds, strict=True)),
            np.int64, len(firsts))


def features(table: pa.Table, head: Head, longest: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, features per text, and for words and pairs: all buckets in order, offsets by text."""
    codes, words, places = words_in(table.column("text"))
    listed = words.to_pylist()
    states = head.states(listed)
    kinds = [((states % head.buckets)[codes], places)]
    if longest == 2:
        at, pair_places = pairs_of(codes, places)
        both, back = np.unique(codes[at] * len(listed) + codes[at + 1] if len(at) else at, return_inverse=True)
        a, b = both // max(len(listed), 1), both % max(len(listed), 1)
        own = head.pair_buckets([listed[i] for i in a], states[a].tolist(), [listed[i] for i in b])
        kinds.append((own[back], pair_places))
    n_words = np.diff(places)
    return n_words, sum(np.diff(p) for _, p in kinds), kinds


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for block in text.merged(batches, BLOCK_BYTES):
        yield block
        release()


def choose_head(texts: DataFrame, head: int = HEAD, longest: int = 1, buckets: int = BUCKETS) -> Head:
    """The `head` most frequent words and pairs among those with a `head`-th part of a block."""
    def candidates(batches):
        for block in _blocks(batches):
            codes, words, places = words_in(block.column("text"))
            counts = np.bincount(codes, minlength=len(words))
            fit = np.flatnonzero((counts * head >= len(codes)) & (pc.binary_length(words).to_numpy(zero_copy_only=False) <= HEAD_BYTES))
            if len(fit):
                yield text.batch(COUNTED, feature=words.take(pa.array(fit)).cast(pa.binary()), pair=np.zeros(len(fit), bool), n=counts[fit])
            if longest == 2 and len(fit):
                at, _ = pairs_of(codes, places)
                both, n = np.unique(codes[at] * len(words) + codes[at + 1], return_counts=True)
                own = np.zeros(len(words), bool)
                own[fit] = True
                often = (n * head >= len(at)) & own[both // len(words)] & own[both % len(words)]
                listed = words.to_pylist()
                names = [listed[i // len(listed)] + b" " + listed[i % len(listed)] for i in both[often].tolist()]
                yield text.batch(COUNTED, feature=pa.array(names, pa.binary()), pair=np.ones(len(names), bool), n=n[often])

    counted = texts.select("text").mapInArrow(candidates, COUNTED).groupBy("feature", "pair").agg(F.sum("n").alias("n"))
    got: list[list[bytes]] = []
    for pair in (False, True)[:longest]:
        # At most `head` strings of bounded length.
        most = counted.filter(F.col("pair") == pair).orderBy(F.desc("n"), "feature").limit(head)
        got.append([bytes(r.feature) for r in most.select("feature").collect()])
    return Head({w: zlib.crc32(w) for w in got[0]}, {p: zlib.crc32(p) % buckets for p in got[-1]} if longest == 2 else {}, buckets)


def bucket_totals(texts: DataFrame, head: Head, longest: int = 1) -> DataFrame:
    """(bucket, n) over all features of all texts; each task sends a row per bucket at most."""
    def count(batches):
        total = np.zeros(head.buckets, np.int64)
        for block in _blocks(batches):
            for own, _ in features(block, head, longest)[2]:
                total += np.bincount(own, minlength=head.buckets)
        used = np.flatnonzero(total)
        yield text.batch(TOTALS, bucket=used.astype(np.int32), n=total[used])

    return texts.select("text").mapInArrow(count, TOTALS).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the floor of a thousand times the smoothed log ratio."""
    all_corpus, all_target = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(
        (target.get(b, 0) + 1) * float(all_corpus + buckets) / ((corpus.get(b, 0) + 1) * float(all_target + buckets))))
        for b in range(buckets)], np.int64)


def weights(docs: DataFrame, head: Head, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    def weigh(batches):
        for block in _blocks(batches):
            n_words, n_features, kinds = features(block, head, longest)
            weight = np.zeros(block.num_rows, np.int64)
            for own, places in kinds:
                weight += np.diff(np.concatenate([[0], np.cumsum(gain[own])])[places])
            yield text.batch(WEIGHED, doc_id=block.column("doc_id").combine_chunks(), n_words=n_words, n_features=n_features, weight=weight)

    return text.only(docs, "doc_id", "text").mapInArrow(weigh, WEIGHED)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and id."""
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(ident.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with score and rank; of N with enough words the floor(percent * N / 100) best get a rank.

    An approximate quantile, with its error on the safe side, leaves out most rows that can't be drawn; the others are sorted by
    ranges, and a rank is the place in a range plus the sizes of those before it.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    share = max(0.0, 1 - percent / 100 - 4 / QUANTILE_ACCURACY)
    n, least = able.agg(F.count("*"), F.percentile_approx("score", share, QUANTILE_ACCURACY)).first()
    wanted = n * percent // 100
    near = able if least is None else able.filter(F.col("score") >= least)
    if near.count() < wanted:  # the quantile's bound forbids it
        near = able
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = near.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "row", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    placed = materialize(placed, "ranges")
    # One row per range: a window without partitions is safe, and so is the broadcast.
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", (before - F.col("least")).alias("offset"))
    ranked = placed.join(F.broadcast(offsets), "part").select("row", (F.col("place") + F.col("offset") + 1).cast("bigint").alias("rank"))
    return scored.join(ranked.filter(F.col("rank") <= wanted), "row", "left").drop("row")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, head: int = HEAD,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every document."""
    if longest not in (1, 2):
        raise ValueError("longest must be 1 or 2")
    for df in (docs, target):
        text.require(df, "text")
    docs, target = text.only(docs, "doc_id", "text"), text.only(target, "text")
    top = choose_head(docs, head, longest, buckets)
    # One row per bucket at most.
    corpus, wanted = ({r.bucket: r.n for r in bucket_totals(df, top, longest).collect()} for df in (docs, target))
    return draw(weights(docs, top, gains(corpus, wanted, buckets), longest), percent, least_words, seed)
