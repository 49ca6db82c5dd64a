"""Language by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams (one to three letters, words padded with a blank) in order of frequency, counted
over every training document. A document's own profile is compared with each language's by the out-of-place
distance: the sum over the document's n-grams of the difference of the ranks, or the largest
difference for an n-gram that the language's profile lacks. The nearest language wins, ties go to the
smaller name; the score is 1 - distance / largest possible distance.

Profiles are broadcast in blocks of BLOCK_LANGUAGES, in order of the names; each block is compared with what the blocks before it found
best, so that any number of languages can be told apart. A long text is read in pieces of PIECE characters that overlap by two, so that memory is bounded and every n-gram counts once.

Defined results: null, empty and letterless texts are `und` with score 0; documents whose lang is null teach
nothing; without any training document every text is `und`; rows that share an id are judged each by
its own text; a row with a null id is judged like any other and teaches like a held-out one, that is, not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import text

PROFILE = 400
BLOCK_LANGUAGES = 500
PIECE = 1 << 20
UNKNOWN = "und"
MODULUS, HELD_OUT = 4, 2  # fixed values: crc32 of the id, this remainder is held out

_BITS = np.uint64(21)


def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


_LETTERS: np.ndarray | None = None


def _piece_grams(raw: str, before: str, last: bool) -> np.ndarray:
    """Packed n-grams that end in this piece; `before` is the two characters before it."""
    points = np.frombuffer((before + raw + (" " if last else "")).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(_letters()[points], points, np.uint32(32)).astype(np.uint64)
    own = len(before)
    word = chars != 32
    one = chars[own:][word[own:]]
    second = np.arange(max(own, 1), len(chars))
    two = second[word[second] | word[second - 1]]
    pairs = (chars[two - 1] << _BITS) | chars[two] | np.uint64(1 << 62)
    third = np.arange(max(own, 2), len(chars))
    three = third[word[third - 1] & (word[third] | word[third - 2])]
    triples = (chars[three - 2] << np.uint64(42)) | (chars[three - 1] << _BITS) | chars[three] | np.uint64(1 << 63)
    return np.concatenate([one, pairs, triples])


def grams(raw: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts: single letters, pairs and triples, with blanks at word edges."""
    lower = raw.lower()
    keys, counts = [], []
    for at in range(0, max(len(lower), 1), PIECE):
        piece = lower[at:at + PIECE]
        k, c = np.unique(_piece_grams(piece, lower[at - 2:at] if at else " ", at + PIECE >= len(lower)), return_counts=True)
        keys.append(k)
        counts.append(c)
    if len(keys) == 1:
        return keys[0], counts[0]
    all_keys = np.concatenate(keys)
    found, place = np.unique(all_keys, return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts in order of the packed n-gram."""
    if len(keys) > 4 * size:
        # Everything that may be among the first `size`; ties at the edge stay in.
        edge = np.partition(counts, len(counts) - size)[len(counts) - size]
        few = counts >= edge
        keys, counts = keys[few], counts[few]
    return keys[np.lexsort((keys, -counts))[:size]]


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) learned from all training documents; n-grams are summed per task before the shuffle."""
    known = text.only(docs, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(
        text.bucket_of_id(F.col("doc_id"), MODULUS) != HELD_OUT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}

        def rows():
            for lang, parts in sums.items():
                keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)
                sums[lang] = [(keys, n)]

        for b in batches:
            for lang, raw in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                sums.setdefault(lang, []).append(grams(raw))
                if len(sums[lang]) >= 512:
                    rows()
        rows()
        for lang, ((keys, n),) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                                             ["lang", "gram", "n"])

    counted = known.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # Ranks within a language: its distinct n-grams, not its documents, meet here. Order as in `ranked`, unsigned.
    unsigned = F.when(F.col("gram") < 0, F.lit(1)).otherwise(F.lit(0))
    order = W.partitionBy("lang").orderBy(F.desc("n"), unsigned, "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def language_blocks(learned: DataFrame, limit: int) -> Iterator[list]:
    """Profiles in order of the languages' names, at most `limit` languages at a time."""
    held, names = [], 0
    for r in learned.orderBy("lang", "rank").toLocalIterator():
        if not held or held[-1].lang != r.lang:
            if names == limit:
                yield held
                held, names = [], 0
            names += 1
        held.append(r)
    if held:
        yield held


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE, limit: int = BLOCK_LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    asked = text.only(docs, "doc_id", "text").withColumn(
        "held_out", F.coalesce(text.bucket_of_id(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(True)))
    judged = asked.select("doc_id", "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                          F.lit(None).cast("long").alias("off"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("text", T.StringType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("off", T.LongType())])
    for rows in language_blocks(learned, limit):
        names = sorted({r.lang for r in rows})
        number = {n: k for k, n in enumerate(names)}
        keys = np.array([r.gram for r in rows], np.int64).view(np.uint64)
        every = np.unique(keys)
        ranks = np.full((len(names), len(every) + 1), -1, np.int64)
        ranks[[number[r.lang] for r in rows], np.searchsorted(every, keys)] = [r.rank for r in rows]

        def predict(batches: Iterator[pa.RecordBatch], names=names, every=every, ranks=ranks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found, scores, offs = (b[c].to_pylist() for c in ("lang_pred", "score", "off"))
                for x, raw in enumerate(b["text"].to_pylist()):
                    if raw:
                        k, c = grams(raw)
                        own = ranked(k, c, size)
                        if len(own):
                            at = np.searchsorted(every, own)
                            at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != own)] = len(every)
                            place = ranks[:, at]
                            off = np.where(place < 0, size, np.abs(place - np.arange(len(own)))).sum(axis=1)
                            best = int(np.argmin(off))
                            if offs[x] is None or off[best] < offs[x]:
                                found[x], offs[x] = names[best], int(off[best])
                                scores[x] = 1.0 - float(off[best]) / (size * len(own))
                yield text.batch(schema, doc_id=b["doc_id"], held_out=b["held_out"], text=b["text"], lang_pred=found, score=scores, off=offs)

        judged = judged.mapInArrow(predict, schema)
    return judged.select("doc_id", "held_out", "lang_pred", "score")
