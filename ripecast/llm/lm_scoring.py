"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs, from the training documents, are quantised to a logarithmic scale: count c gets
level 1 + floor(log_BASE c), and the filter holds the n-gram once per level up to its own. A count is read
back by probing level after level until a probe fails, so an n-gram is never underestimated and overestimated only by a false
positive. Probabilities are smoothed from such probes alone:

    P(w)     = (c(w) + ALPHA) / (N + ALPHA * (V + 1))
    P(w | v) = (c(v w) + MU * P(w)) / (max(c(v), c(v w)) + MU)

with c the middle of the quantised level, N and V the exact totals. A document starts after an end token and ends with one.

The filter is cut into segments by the n-gram's hash; all probes of an n-gram fall into one segment, whose size
follows the n-grams in it (BITS_PER_ENTRY per entry, whatever the corpus' size). Segments are built where
the counts are summed. If all of them together have at most `broadcast_bytes`, they are broadcast and scoring moves no
text. Beyond that, a packed exchange carries each block's distinct n-grams to the segments and the levels back: the
same probes, the same scores, without a broadcast.

The base score needs exact counts of every word of every document, which the exchange gives per block.

Defined results: a null text is empty and has the end token alone; documents with a null id are held out; repeated
rows are each scored (and each learned from); empty tables give no rows; with no training document every count is 0. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import exchange as ex
from ripecast.llm import text
from ripecast.llm.jaccard_join import bucket_of
from ripecast.sources.files import materialize

MODULUS, HELD_OUT = 10, 0        # fixed values: crc32 of the id, this remainder is held out
ALPHA = 0.1
MU = 8.0
BASE = math.sqrt(2)
BITS_PER_ENTRY = 10
PROBES = 5
MAX_LEVEL = 120                  # sqrt(2) ** 120 is more than any count
BROADCAST_BYTES = 256 << 20
END = np.uint64(0x5851F42D4C957F2D)  # hash of the end token: no word of the text

BLOCK_BYTES = 3 << 20

PARTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("log_sum", T.DoubleType()),
    T.StructField("score", T.DoubleType()), T.StructField("new_words", T.LongType()),
])


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), held_out."""
    rows = text.only(docs, "doc_id", "text")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(
        text.bucket_of_id(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(True)).alias("held_out"))


# -- the filter ----------------------------------------------------------------------------------

def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, and one more for every factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def middles() -> np.ndarray:
    """Expected count by level; 0 for level 0."""
    edge = BASE ** np.arange(MAX_LEVEL + 2)
    out = np.zeros(MAX_LEVEL + 1)
    for k in range(1, MAX_LEVEL + 1):
        low, high = math.ceil(edge[k - 1] - 1e-9), math.ceil(edge[k] - 1e-9) - 1
        out[k] = (low + max(high, low)) / 2
    return out


_LOW = np.uint64(0xFFFFFFFF)


def seeds_of(keys: np.ndarray, level: int) -> np.ndarray:
    return text.mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15 >> 8))


def place_of(seeds: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Place of an entry's bit number `probe` in a segment of `size` bits."""
    turn = ((seeds >> np.uint64(32)) + np.uint64(probe) * ((seeds & _LOW) | np.uint64(1))) & _LOW
    return ((turn * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of a segment, packed, for distinct n-grams and their counts."""
    top = levels(counts)
    size = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        seeds = seeds_of(keys[top >= level], level)
        for probe in range(PROBES):
            bits[place_of(seeds, probe, size)] = True
    return np.packbits(bits)


def read_levels(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Level of every n-gram by probing its segment until a probe fails."""
    found = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    size = len(packed) * 8
    for level in range(1, MAX_LEVEL + 1):
        seeds = seeds_of(keys[going], level)
        for probe in range(PROBES):
            place = place_of(seeds, probe, size)
            hit = (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
            going, seeds = going[hit], seeds[hit]
        if not len(going):
            break
        found[going] = level
    return found


class Filter:
    """Segments one after the other; segment b has the n-grams with bucket b."""

    def __init__(self, segments: dict[int, np.ndarray], buckets: int):
        self.buckets = buckets
        sizes = np.array([len(segments[b]) if b in segments else 8 for b in range(buckets)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.zeros(self.starts[-1], np.uint8)
        for b, s in segments.items():
            self.bytes[self.starts[b]:self.starts[b] + len(s)] = s

    def read(self, keys: np.ndarray) -> np.ndarray:
        own = bucket_of(keys, self.buckets)
        order, edges = ex.by_bucket(own, self.buckets)
        found = np.empty(len(keys), np.int64)
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b]:edges[b + 1]]
            found[at] = read_levels(short_key(keys[at]), self.bytes[self.starts[b]:self.starts[b + 1]])
        return found


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return text.mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + second * np.uint64(0x165667B19E3779F9))


def grams_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every text with its end, their hashes and pairs: (words, pairs, document of each, documents' token counts)."""
    codes, names, offsets = text.coded_words(texts)
    hashes = text.hash_strings(names)[codes]
    n = len(texts)
    lengths = np.diff(offsets) + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.full(len(codes) + n, END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = hashes
    before = np.empty_like(tokens)
    if len(tokens):
        before[0] = END
        before[1:] = tokens[:-1]
    return tokens, pair_keys(before, tokens), np.repeat(np.arange(n), lengths), lengths


def filter_segments(docs: DataFrame) -> DataFrame:
    """(bucket, payload, tokens, words): a segment of the filter with its share of all tokens and distinct words: the filter of the training documents' words and pairs, summed per block before the shuffle."""
    buckets = ex.bucket_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[ex.Row]:
            for t in text.merged(batches, BLOCK_BYTES):
                tokens, pairs, _, _ = grams_of(t["text"])
                packed: list[list[np.ndarray]] = [[] for _ in range(buckets)]
                for grams in (tokens, pairs):
                    keys, n = np.unique(grams, return_counts=True)
                    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                    for b in range(buckets):
                        k, c = keys[edges[b]:edges[b + 1]], n[edges[b]:edges[b + 1]]
                        once = c == 1
                        # Six bytes identify an n-gram within its bucket, whose number stands for the first bits.
                        packed[b] += [shorten(k[once]), shorten(k[~once]), c[~once].astype(np.uint32)]
                for b in range(buckets):
                    yield 0, b, ex.pack(*packed[b])
                ex.release()
        return ex.rows_out(rows())

    def build(t: pa.Table) -> pa.Table:
        sums = []
        parts = [ex.unpack(p) for p in t["payload"].to_pylist()]
        for at in (0, 3):
            keys, counts = [], []
            for p in parts:
                one, more, n = p[at:at + 3]
                keys += [lengthen(one), lengthen(more)]
                counts += [np.ones(len(one) // 6, np.int64), n.astype(np.int64)]
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums.append((found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)))
        bits = segment(*(np.concatenate([x[k] for x in sums]) for k in (0, 1)))
        ex.release()
        return pa.table({"bucket": t["bucket"].slice(0, 1), "payload": pa.array([bits.tobytes()], pa.binary()),
                         "tokens": pa.array([int(sums[0][1].sum())], pa.int64()), "words": pa.array([len(sums[0][0])], pa.int64())})

    return docs.filter("NOT held_out").select("text").mapInArrow(count, ex.ROW).groupBy("bucket").applyInArrow(
        build, "bucket long, payload binary, tokens long, words long")


def shorten(keys: np.ndarray) -> np.ndarray:
    """The low six bytes of every key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def lengthen(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def short_key(keys: np.ndarray) -> np.ndarray:
    """What the filter knows of a key: its low six bytes."""
    return keys & np.uint64(0xFFFFFFFFFFFF)


def log_probabilities(word_levels: np.ndarray, before_levels: np.ndarray, pair_levels: np.ndarray, total: int, distinct: int) -> np.ndarray:
    middle = middles()
    word, before, pair = middle[word_levels], middle[before_levels], middle[pair_levels]
    single = (word + ALPHA) / (total + ALPHA * (distinct + 1))
    return np.log10((pair + MU * single) / (np.maximum(before, pair) + MU))


# -- scores ----------------------------------------------------------------------------------------

def parts(docs: DataFrame, segments: DataFrame, total: int, distinct: int, broadcast: bool) -> DataFrame:
    """PARTS of every prepared document: exact counts through the exchange, model score by probes of the filter.

    With `broadcast` a block is scored where it is read. Otherwise its distinct n-grams travel with
    the words that it asks about and are probed at their segments.
    """
    buckets = ex.bucket_count(docs)
    shared = None
    if broadcast:
        held = {r.bucket: np.frombuffer(r.payload, np.uint8) for r in segments.select("bucket", "payload").toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(Filter(held, buckets))
        del held

    def grams(t: pa.Table):
        tokens, pairs, doc, lengths = grams_of(t["text"])
        keys, place = np.unique(np.concatenate([tokens, pairs]), return_inverse=True)
        return keys, place[:len(tokens)], place[len(tokens):], doc, lengths

    def summed(found: np.ndarray, word: np.ndarray, pair: np.ndarray, before_end: int, doc: np.ndarray, n: int) -> np.ndarray:
        """Score of every document from the levels of the block's n-grams."""
        word_level = found[word]
        before = np.empty_like(word_level)
        if len(before):
            before[0], before[1:] = before_end, word_level[:-1]
        return np.bincount(doc, log_probabilities(word_level, before, found[pair], total, distinct), minlength=n)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        codes, names, offsets = text.coded_words(t["text"])
        hashes = text.hash_strings(names)
        order, edges = ex.by_bucket(bucket_of(hashes, buckets), buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        train = ~t["held_out"].to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        learned = np.bincount(codes[np.repeat(train, lengths)], minlength=len(names))[order].astype(np.uint32)
        # Distinct words of every document, with how often; words by their place in the order of the buckets.
        doc, width = np.repeat(np.arange(t.num_rows), lengths), max(len(names), 1)
        seen, n = np.unique(doc * width + rank[codes], return_counts=True)
        word = (seen % width).astype(np.uint32)
        notes = [ids_out(t["doc_id"]), train.astype(np.uint8), np.bincount(seen // width, minlength=t.num_rows).astype(np.uint32),
                 # Bytes of equal weight together: the high ones compress well.
                 *((word >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)), n.astype(np.uint32)]
        keys, first, second, owner, _ = grams(t)
        if shared is not None:
            found = shared.value.read(keys)
            end = int(shared.value.read(np.array([END]))[0])
            notes.append(summed(found, first, second, end, owner, t.num_rows))
            cuts = None
        else:
            # One more key, the end token, for the word before the block's first.
            keys = np.append(keys, END)
            gram_order, cuts = ex.by_bucket(bucket_of(keys, buckets), buckets)
            back = np.empty(len(keys), np.int64)
            back[gram_order] = np.arange(len(keys))
            notes += [back[first].astype(np.uint32), back[second].astype(np.uint32), owner.astype(np.uint32), back[-1:].astype(np.uint32)]
            keys = short_key(keys[gram_order])
        yield ex.OWN, ex.pack(*notes)
        named = names.take(pa.array(order))
        for b in range(buckets):
            low, high = edges[b], edges[b + 1]
            own = keys[cuts[b]:cuts[b + 1]] if cuts is not None else keys[:0]
            if high > low or len(own):
                yield b, ex.pack(ex.pack_strings(named.slice(low, high - low)), learned[low:high], own)

    def answer(payloads: list[bytes], bits: bytes | None = None) -> Iterator[bytes]:
        asked = [ex.unpack(p) for p in payloads]
        words = [ex.unpack_strings(a[0]) for a in asked]
        coded = pa.concat_arrays(words).dictionary_encode()
        place = coded.indices.to_numpy()
        count = np.bincount(place, np.concatenate([a[1] for a in asked]), len(coded.dictionary)).astype(np.int64)
        fresh = np.array([int((count > 0).sum())])
        packed = np.frombuffer(bits, np.uint8) if bits is not None else np.zeros(8, np.uint8)
        at = 0
        for w, a in zip(words, asked, strict=True):
            # The bucket's number of distinct training words goes to one block, so that each word is counted once.
            yield ex.pack(count[place[at:at + len(w)]], fresh if at == 0 and a is asked[0] else fresh[:0], read_levels(a[2], packed).astype(np.uint8))
            at += len(w)

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, train, per, b0, b1, b2, b3, n, *rest = ex.unpack(notes)
        word = b0.astype(np.int64) | b1.astype(np.int64) << 8 | b2.astype(np.int64) << 16 | b3.astype(np.int64) << 24
        given = [ex.unpack(answers[b]) for b in sorted(answers)]
        count = np.concatenate([g[0] for g in given]) if given else np.empty(0, np.int64)
        docs_here = len(train)
        doc = np.repeat(np.arange(docs_here), per)
        if len(rest) == 1:
            score = rest[0]
        else:
            first, second, owner, end = rest
            found = np.concatenate([g[2] for g in given]).astype(np.int64)
            score = summed(found, first, second, int(found[end[0]]), owner, docs_here)
        fresh = np.zeros(docs_here, np.int64)
        fresh[0] = sum(int(g[1].sum()) for g in given)
        yield text.batch(
            PARTS, doc_id=ids_in(ids, docs_here), held_out=train == 0,
            n_tokens=np.bincount(doc, n, minlength=docs_here).astype(np.int64),
            n_known=np.bincount(doc, n * (count[word] > 0), minlength=docs_here).astype(np.int64),
            log_sum=np.bincount(doc, n * np.log10(count + ALPHA)[word], minlength=docs_here), score=score, new_words=fresh)

    beside = None if broadcast else segments.select("bucket", "payload")
    return ex.exchange(docs, ask, answer, settle, PARTS, BLOCK_BYTES, beside)


def ids_out(ids: pa.ChunkedArray) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("v", pa.int64())])) as w:
        w.write_batch(pa.record_batch([ids.combine_chunks().cast(pa.int64())], ["v"]))
    return out.getvalue().to_pybytes()


def ids_in(raw: bytes, n: int) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all()["v"].combine_chunks()


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = prepared(docs)
    segments = materialize(filter_segments(rows), "filter-segments")
    size, total, distinct = segments.agg(
        F.coalesce(F.sum(F.length("payload")), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    found = materialize(parts(rows, segments, total, distinct, size <= broadcast_bytes), "score-parts")
    # Exact totals, one row: every training document has one end token; without any, nothing is known.
    totals = found.agg(
        F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens") + 1)), F.lit(0)).alias("all_tokens"),
        F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)).alias("ends"),
        F.coalesce(F.sum("new_words"), F.lit(0)).alias("words"),
    ).withColumn("norm", F.log10(F.col("all_tokens") + ALPHA * (F.col("words") + (F.col("ends") > 0).cast("long") + 1)))
    return found.join(F.broadcast(totals)).select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + (F.col("ends") > 0).cast("long")).alias("n_known"), F.col("all_tokens").alias("train_tokens"),
        (F.col("log_sum") + F.log10(F.col("ends") + ALPHA) - (F.col("n_tokens") + 1) * F.col("norm")).alias("base_score"), "score")
