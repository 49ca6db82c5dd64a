"""Paragraphs and passages that repeat, exactly or nearly, within and across documents.

A paragraph is a line of MIN_WORDS words or more; its set are its word shingles. MinHash signatures are cut into
bands, whose number and height are tuned so that a pair at the threshold collides with probability RECALL or more.
A packed exchange tells which paragraphs collide with any other; only those are read again. Equal sets are one
class; classes that share a band are joined, their Jaccard share is counted exactly, and connected components give
the groups. Of each group the first paragraph (smallest document, then place) stays.

Bands hit by very many classes are handled as in `jaccard_join`: signature trees over tiles of classes find the links, so no
group is listed pair by pair or held by one task.

What stands inside longer lines, or over several short ones, is found in a second pass over the words that the first
leaves, all but the removed lines. Every pair of words whose hash is the smallest within REACH words is a cut, so equal passages are cut
alike wherever they stand. A piece goes from a cut to the first one MIN_WORDS words or more after it, so pieces overlap; they
are compared like paragraphs. Overlapping pieces of one group in one text are one passage; passages that run on beside
each other in both texts are joined. A repeated passage is found if a piece lies inside it, at least REACH words from its edges:
nearly always from 50 words on, by chance below that, and with changed words where enough unchanged words are left between them.

Defined results: null and empty texts have no paragraphs; rows that share an id are told apart by a row number in the
groups, and reported with the same id; rows with a null id are left out; an empty table gives no rows. Text without
a smallest hash, one word over and over, is not cut. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import exchange as ex
from ripecast.llm import text
from ripecast.llm.components import components
from ripecast.llm.jaccard_join import bucket_of, group_links, of_ids
from ripecast.sources.files import materialize

SIZE, SHARE = 5, 80
MIN_WORDS = 20
REACH = 4
RECALL = 0.99
BLOCK_BYTES = 2 << 20
MOST_HASHES = 64
SLICE = 8192                 # units hashed at once

FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("par", T.IntegerType())])
ROWS = "doc_id long, doc_row long, par int, n_words int, digest binary, tokens binary, bands array<long>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Of a table's units: row in the table, number in the text, words; the shingles of all, which need not be sorted or distinct; and each unit's first
#: and end among them.
Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tune(share: int, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows per band): the highest bands within `most` hashes that reach the recall for pairs at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p, bands = (share / 100) ** rows, most // rows
        fits = [b for b in range(1, bands + 1) if 1 - (1 - p) ** b >= recall]
        if fits:
            best = (fits[0], rows)
    return best


def lines_of(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines of all texts, and of each its row in the table and its number."""
    lists = pc.split_pattern(pc.fill_null(t["text"].combine_chunks().cast(pa.large_string()), ""), "\n")
    cuts = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.values.slice(cuts[0], cuts[-1] - cuts[0])
    per = np.diff(cuts)
    owner = np.repeat(np.arange(t.num_rows), per)
    return lines, owner, np.arange(len(lines)) - np.repeat(cuts[:-1] - cuts[0], per)


def paragraphs(t: pa.Table, size: int, min_words: int) -> Units:
    """Of every paragraph: row in the table, line number, words, and shingles."""
    lines, owner, number = lines_of(t)
    codes, names, offsets = text.coded_words(lines)
    n = np.diff(offsets)
    hashes = text.hash_strings(names)[codes]
    runs = text.shingle_hashes(hashes, size)
    keep = np.flatnonzero(n >= max(min_words, size))
    return owner[keep], number[keep], n[keep], runs, offsets[keep], offsets[keep + 1] - size + 1


def cuts_of(words: np.ndarray, part: np.ndarray, reach: int) -> np.ndarray:
    """Places at which pieces start or end: the first words of the parts, and those of pairs with the smallest hash within reach."""
    value = np.full(len(words), np.iinfo(np.uint64).max)
    if len(words) > 1:
        inside = part[1:] == part[:-1]
        value[:-1][inside] = text.shingle_hashes(words, 2)[inside]
    least = np.ones(len(words), bool)
    for k in range(1, min(reach, len(words) - 1) + 1):
        apart = part[k:] != part[:-k]
        least[k:] &= apart | (value[k:] < value[:-k])
        least[:-k] &= apart | (value[:-k] <= value[k:])
    least &= value < np.iinfo(np.uint64).max
    least[:1] = True
    least[1:] |= part[1:] != part[:-1]
    return np.flatnonzero(least)


def pieces(t: pa.Table, size: int, min_words: int, reach: int = REACH) -> Units:
    """Of every piece: row in the table, number of its first word, words, and shingles. The lines listed in `gone` are left out."""
    lines, owner, number = lines_of(t)
    codes, names, offsets = text.coded_words(lines)
    n = np.diff(offsets)
    left = np.ones(len(lines), bool)
    for k, gone in enumerate(t["gone"].to_pylist()):
        if gone:
            left[np.searchsorted(owner, k) + np.array(gone)] = False
    # A part: neighbouring lines of one text that are left.
    new = np.ones(len(lines), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (left[1:] != left[:-1])
    line = np.repeat(np.arange(len(lines)), n)
    there = np.flatnonzero(left[line])
    part = np.cumsum(new)[line[there]]
    words = text.hash_strings(names)[codes[there]]
    starts = cuts_of(words, part, reach)
    stops = np.append(starts, len(words))
    at = np.searchsorted(stops, starts + max(min_words, size))
    # Of pieces with the same end the shortest.
    fits = (at < len(stops)) & np.append(at[1:] != at[:-1], True)
    starts, ends = starts[fits], stops[at[fits]]
    fits = part[starts] == part[ends - 1]
    starts, ends = starts[fits], ends[fits]
    runs = text.shingle_hashes(words, size)
    rows = owner[line[there[starts]]]
    first = there[starts] - offsets[np.searchsorted(owner, rows)]
    return rows, first, ends - starts, runs, starts, ends - size + 1


def band_keys(tokens: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of every set tokens[first:end]; what overlapping sets share is hashed once."""
    if not len(first):
        return np.empty((0, bands), np.uint64)
    if len(first) > SLICE:
        return np.concatenate([band_keys(tokens, first[at:at + SLICE], end[at:at + SLICE], bands, rows) for at in range(0, len(first), SLICE)])
    low = first.min()
    # One more, since every edge must be a place in the array.
    tokens = np.append(tokens[low:end.max()], np.uint64(0))
    edges = np.stack([first - low, end - low], axis=1).ravel()
    rolls, weights = text.odd(31, bands * rows), text.odd(37, rows)
    keys, rolled = np.empty((len(first), bands), np.uint64), np.empty_like(tokens)
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64) * text.odd(41, 1)
        for r in range(rows):
            key += np.minimum.reduceat(np.multiply(tokens, rolls[b * rows + r], out=rolled), edges)[::2] * weights[r]
        keys[:, b] = text.mix(key)
    return keys


def next_ones(owner: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of every unit in order, how many behind it start inside it. Units are stretches [number, number + n) of their owner's words."""
    at = (owner - owner[:1].sum()).astype(np.int64) << 32
    return np.searchsorted(at + number, at + number + n) - np.arange(len(owner)) - 1


def colliding(docs: DataFrame, units: Callable[[pa.Table], Units], bands: int, rows: int, overlap: bool = False) -> DataFrame:
    """(doc_id, par) of units that share a band with another; rarely, by chance, of one that does not.

    With `overlap`, units can overlap; then a key that overlapping units have in common is asked for once, and if it is found
    elsewhere, all units are given that start inside the first of them.
    """
    buckets = ex.bucket_count(docs)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        owner, number, n, *sets = units(t)
        keys = band_keys(*sets, bands, rows)
        behind = next_ones(owner, number, n) if overlap else np.zeros(len(owner), np.int64)
        asked = np.ones(keys.shape, bool)
        for k in range(1, int(behind.max(initial=0)) + 1):
            asked[k:] &= (keys[k:] != keys[:-k]) | (behind[:-k] < k)[:, None]
        unit = np.repeat(np.arange(len(owner)), asked.sum(axis=1))
        keys = keys[asked]
        own = bucket_of(keys, buckets)
        order, edges = ex.by_bucket(own, buckets)
        prints = keys[order].astype(np.uint32)
        # Unit of every key in the order of the buckets, as steps from the one before.
        steps = np.diff(unit[order], prepend=0).astype(np.int32)
        yield ex.OWN, ex.pack(t["doc_id"].to_numpy().astype(np.int64)[owner], number.astype(np.int32), steps, behind.astype(np.int32))
        for b in range(buckets):
            if edges[b + 1] > edges[b]:
                yield b, ex.pack(prints[edges[b]:edges[b + 1]])

    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        parts = [ex.unpack(p)[0] for p in payloads]
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = n[place] > 1
        at = 0
        for p in parts:
            yield ex.pack(np.packbits(often[at:at + len(p)]), np.array([len(p)]))
            at += len(p)

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, number, steps, behind = ex.unpack(notes)
        given = [ex.unpack(answers[b]) for b in sorted(answers)]
        flags = np.concatenate([np.unpackbits(f)[:n[0]] for f, n in given]) if given else np.empty(0, np.uint8)
        hit = np.unique(np.cumsum(steps, dtype=np.int64)[flags > 0])
        hit = np.unique(np.concatenate([hit, *(hit[behind[hit] >= k] + k for k in range(1, int(behind.max(initial=0)) + 1))]))
        yield text.batch(FOUND, doc_id=ids[hit], par=number[hit])

    return ex.exchange(docs, ask, answer, settle, FOUND, BLOCK_BYTES)


def described(docs: DataFrame, units: Callable[[pa.Table], Units], bands: int, rows: int) -> DataFrame:
    """ROWS of the units listed in `wanted`, an array column of their numbers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = TaskContext.get().partitionId() << 33
        for t in text.merged(batches, BLOCK_BYTES):
            owner, number, n, runs, first, end = units(t)
            wanted = [set(w) for w in t["wanted"].to_pylist()]
            keep = [k for k in range(len(owner)) if int(number[k]) in wanted[owner[k]]]
            sets = [np.unique(runs[first[k]:end[k]]) for k in keep]
            raw = [s.tobytes() for s in sets]
            cuts = np.cumsum([0, *map(len, sets)])
            keys = band_keys(np.concatenate([np.empty(0, np.uint64), *sets]), cuts[:-1], cuts[1:], bands, rows)
            yield pa.RecordBatch.from_arrays([
                t["doc_id"].combine_chunks().take(pa.array(owner[keep], pa.int64())), pa.array(owner[keep] + before, pa.int64()),
                pa.array(number[keep], pa.int32()), pa.array(n[keep], pa.int32()),
                pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()),
                pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
            ], ["doc_id", "doc_row", "par", "n_words", "digest", "tokens", "bands"])
            before += t.num_rows
            ex.release()

    return docs.mapInArrow(make, ROWS)


def grouped(source: DataFrame, units: Callable[[pa.Table], Units], share: int, recall: float, name: str, overlap: bool = False) -> DataFrame:
    """(doc_id, doc_row, par, n_words, row, grp) of units that collide with another; linked ones have the same grp."""
    bands, rows = tune(share, recall)
    hits = materialize(colliding(source, units, bands, rows, overlap), f"colliding-{name}")
    # The numbers of one document: no more than it has lines or words.
    wanted = hits.groupBy("doc_id").agg(F.collect_set("par").alias("wanted"))
    again = of_ids(source, wanted.select("doc_id")).join(wanted, "doc_id")
    found = materialize(described(again, units, bands, rows).withColumn("row", F.monotonically_increasing_id()), name)
    firsts = materialize(found.groupBy("digest").agg(F.min(F.struct("doc_id", "par", "row")).alias("f"), F.count("*").alias("n")).select(
        "digest", F.col("f.row").alias("node"), "n"), f"{name}-classes")
    # Read four times below.
    classes = materialize(of_ids(found.select(F.col("row").alias("node"), "tokens", "bands"), firsts.select("node"), "node"), "classes")
    meet = materialize(classes.select(F.explode("bands").alias("token"), "node"), "band-members")
    known, links = group_links(meet, classes.select("node", "tokens"), share)
    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links))
    groups = firsts.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("grp"), "n")
    return found.select("doc_id", "doc_row", "par", "n_words", "row", "digest").join(groups.drop("n"), "digest")


def texts_of(docs: DataFrame) -> DataFrame:
    return text.only(docs, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")


def line_repeats(docs: DataFrame, size: int = SIZE, share: int = SHARE, min_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, paragraph, n_words, first_doc_id, first_paragraph, removed): every paragraph of every group of two or more."""
    source = texts_of(docs)
    rowed = grouped(source, lambda t: paragraphs(t, size, min_words), share, recall, "paragraphs")
    heads = rowed.groupBy("grp").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "par", "row")).alias("head")).filter("size > 1")
    return rowed.join(heads, "grp").select(
        "doc_id", F.col("par").alias("paragraph"), "n_words", F.col("head.doc_id").alias("first_doc_id"),
        F.col("head.par").alias("first_paragraph"), (F.col("row") != F.col("head.row")).alias("removed"))


def islands(rows: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """Rows with the number of their island: stretches [par, stop) of the same keys that overlap, or only touch, are one."""
    order = Window.partitionBy(*keys).orderBy("par", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("par") > before if touching else F.col("par") >= before
    return rows.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("island", F.sum("new").over(order)).drop("new")


def passage_repeats(source: DataFrame, lines: DataFrame, size: int, share: int, min_words: int, recall: float) -> DataFrame:
    """(doc_id, word, n_words, first_doc_id, first_word, removed) of repeated passages in what removed lines leave."""
    lost = lines.groupBy("doc_id", "paragraph").agg(F.min("removed").alias("all")).filter("all")
    gone = materialize(lost.groupBy("doc_id").agg(F.collect_set("paragraph").alias("gone")), "removed-lines")
    # Only texts that lose lines are dealt anew.
    rest = of_ids(source, gone.select("doc_id"), how="left_anti").withColumn("gone", F.lit(None).cast("array<int>")).unionAll(
        of_ids(source, gone.select("doc_id")).join(gone, "doc_id"))
    rowed = grouped(rest, lambda t: pieces(t, size, min_words), share, recall, "pieces", overlap=True).withColumn("stop", F.col("par") + F.col("n_words"))
    # Overlapping pieces of a group in one text are no copies of each other.
    found = islands(rowed, ["grp", "doc_row"], touching=False).groupBy("grp", "doc_row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("par").alias("par"), F.max("stop").alias("stop"))
    heads = found.groupBy("grp").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "par", "doc_row")).alias("head")).filter("size > 1")
    placed = found.join(heads, "grp").select(
        "doc_id", "doc_row", "par", "stop", F.col("head.doc_id").alias("first_doc_id"), F.col("head.par").alias("first_word"),
        F.col("head.doc_row").alias("first_row"), (F.col("par") - F.col("head.par")).alias("shift"),
        ((F.col("doc_row") != F.col("head.doc_row")) | (F.col("par") != F.col("head.par"))).alias("removed"))
    keys = ["doc_row", "first_row", "shift", "removed"]
    return islands(placed, keys, touching=True).groupBy(*keys, "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("par").alias("word"), (F.max("stop") - F.min("par")).alias("n_words"),
        F.first("first_doc_id").alias("first_doc_id"), F.min("first_word").alias("first_word")).select(
        "doc_id", "word", "n_words", "first_doc_id", "first_word", "removed")


def repeats(docs: DataFrame, size: int = SIZE, share: int = SHARE, min_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, paragraph, n_words, first_doc_id, first_paragraph, removed, word, first_word): every paragraph of every group of
    two or more, by line numbers, and every repeated passage, by the numbers of its first words; the other two are null."""
    source = texts_of(docs)
    lines = materialize(line_repeats(docs, size, share, min_words, recall), "repeated-lines")
    spans = passage_repeats(source, lines, size, share, min_words, recall)
    none = F.lit(None).cast("int")
    return lines.withColumns({"word": none, "first_word": none}).unionByName(spans.withColumns({"paragraph": none, "first_paragraph": none}))


def cut_text(raw: str, gone: list[int], spans: list[tuple[int, int]]) -> str:
    """The text without those lines and stretches of words [first, stop); a word goes with the white space behind it."""
    lines, at, out = raw.split("\n"), 0, []
    gone_lines, spans = set(gone), sorted(spans)
    for k, line in enumerate(lines):
        words = list(WORD.finditer(line))
        lost = np.zeros(len(words), bool)
        for a, z in spans:
            lost[max(a - at, 0):max(z - at, 0)] = True
        at += len(words)
        if k in gone_lines or len(words) and lost.all():
            continue
        edges = [w.start() for w in words] + [len(line)]
        out.append(line[:edges[0]] + "".join(line[edges[j]:edges[j + 1]] for j in np.flatnonzero(~lost)))
    return "\n".join(out)


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents without the removed paragraphs and passages; texts that lose none are unchanged, to the byte.

    Rows that share an id can't be told apart here, so a place is cut only if it is removed in every one of them: a text that one
    of two equal rows keeps stays in both.
    """
    places = ["doc_id", *(c for c in ("paragraph", "word", "n_words") if c in found.columns)]
    gone = found.groupBy(places).agg(F.every("removed").alias("__all")).filter("__all").groupBy("doc_id").agg(
        F.collect_set("paragraph").alias("__gone"), F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", F.col("word") + F.col("n_words")))).alias("__spans"))
    cut = F.udf(lambda t, g, s: t if t is None or g is None else cut_text(t, g, [tuple(x) for x in s]), "string")
    return docs.join(gone, "doc_id", "left").withColumn("text", cut("text", "__gone", "__spans")).drop("__gone", "__spans")
