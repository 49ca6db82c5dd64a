"""Benchmark items inside documents, also with a fifth of their words changed.

Words are lower-cased and stripped of everything but letters and digits. Items and documents are embedded by CGK walks over words: at every
step the current word is the output, and a coin drawn for step and word says whether the walk moves on. Walks through two texts fall into step
again after a changed, inserted or lost word, so that edit distance becomes Hamming distance between outputs. Of a walk, SETS samples of
three steps, the first among them, are the LSH: a window of a document is a candidate for an item if one sample agrees.

Long walks drift apart, so a walk ends after STEPS steps, and an item is covered by windows that start at several of its words, the
starts: SPARE more than the edits allowed, hence at least SPARE of them stand unchanged in any match. Starts are the item's words
that are rarest in the benchmark, and document windows begin at such words alone; what a document gives does not depend on the documents beside it.

Walks are added until the recall, measured on copies of the benchmark's own items with the largest allowed number of edits (words changed,
inserted, lost, or all three; TRIALS copies or TRIAL_WORDS words per band of lengths and kind of edit), is TARGET_RECALL in every band and
kind, and as many again; at least LEAST_WALKS, at most MOST_WALKS. An unchanged item is always found.

Candidates are verified by the exact edit distance over words (bit-parallel, free start and end) in the item's place with a margin of
`edits` words. Before that, a filter without loss: a stretch within `edits` of an item misses at most `edits` of its words, so a region has at
least as many of them as the item less `edits`.

The benchmark is a stated query set against all documents. It goes to the tasks in blocks of at most BLOCK_ITEM_BYTES.

Defined results: null or empty texts and items match nothing; items of fewer than MIN_WORDS words are not
evidence and are not searched; an item that occurs several times in a document is one row, with the fewest
edits and, of the stretches with those, the one that ends first, the shortest of them; repeated rows give repeated rows; documents with a null id are searched and
reported with that null; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ripecast.llm import text
from ripecast.llm.exchange import release

SHARE = 0.2          # edits allowed per word of the item
MIN_WORDS = 8
TARGET_RECALL = 0.999
STEPS = 12            # of a walk
SETS = 4              # samples of a walk
SPARE = 6             # starts of an item beyond its edits
TAIL = 4              # words of an item behind its last possible start
LEAST_WALKS, MOST_WALKS = 4, 64
TRIALS, TRIAL_WORDS = 250, 50_000
SEED = 5
MASK_WORDS = 1024
BLOCK_ITEM_BYTES = 1 << 20
TEXT_BYTES = 3 << 20
CHUNK = 1 << 16

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("first_word", T.LongType()), T.StructField("item_words", T.IntegerType()),
])


def plain_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes by code, the words as codes, and each text's offsets; words without letter or digit are left out."""
    codes, names, offsets = text.coded_words(texts, lower=False)
    names = pc.replace_substring_regex(pc.utf8_lower(names), r"[^\p{L}\p{N}]+", "")
    full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.empty(0, bool)
    hashes = text.hash_strings(names)
    return hashes, codes[full], np.concatenate([[0], np.cumsum(full)])[offsets].astype(np.int64)


class Walk:
    """One random walk: coins by step and word, and the samples of all items' windows."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng([SEED, seed])
        self.coins = rng.integers(0, 2, (STEPS, size), np.int8)
        self.coins[:, size - 2:] = 0  # the two ends of text, behind which no walk goes
        first = rng.integers(1, STEPS // 2, SETS)
        self.samples = [(int(x), int(rng.integers(x + 2, STEPS))) for x in first]
        self.size = size
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def outputs(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Per sample, one exact number for the three sampled words of every walk."""
        wanted = {step for pair in self.samples for step in pair} | {0}
        seen, place = {}, starts
        for step in range(max(wanted) + 1):
            now = words[place]
            if step in wanted:
                seen[step] = now
            place = place + self.coins[step][now]
        for x, y in self.samples:
            yield (seen[0] * self.size + seen[x]) * self.size + seen[y]

    def learn(self, words: np.ndarray, starts: np.ndarray) -> None:
        end = self.size - 1
        for key in self.outputs(words, starts):
            own = np.flatnonzero((key % self.size != end) & (key // self.size % self.size != end))
            order = own[np.argsort(key[own], kind="stable")]
            distinct, first = np.unique(key[order], return_index=True)
            maybe = np.zeros(1 << max(16, 4 + len(distinct).bit_length()), bool)
            maybe[self.spots(distinct, len(maybe))] = True
            self.keys.append((distinct, np.append(first, len(order)), order, maybe))

    @staticmethod
    def spots(keys: np.ndarray, size: int) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())

    def meet(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the given starts and of the items' windows with which they share a sample."""
        for key, (distinct, first, order, maybe) in zip(self.outputs(words, starts), self.keys, strict=True):
            few = np.flatnonzero(maybe[self.spots(key, len(maybe))])
            if not len(few) or not len(distinct):
                continue
            at = np.minimum(np.searchsorted(distinct, key[few]), len(distinct) - 1)
            same = distinct[at] == key[few]
            few, at = few[same], at[same]
            low, many = first[at], first[at + 1] - first[at]
            yield np.repeat(few, many), order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]


class Items:
    """One block of benchmark items, prepared for the tasks."""

    def __init__(self, ids: list[int], texts: list[str | None], share: float, min_words: int):
        if min_words < MIN_WORDS:
            raise ValueError(f"samples need items of {MIN_WORDS} words or more")
        hashes, codes, offsets = plain_words(pa.array(texts, pa.string()))
        words = hashes[codes]
        self.ids, self.words = [], []
        for k, i in enumerate(ids):
            own = words[offsets[k]:offsets[k + 1]]
            if len(own) >= min_words:
                self.ids.append(i)
                self.words.append(own)
        self.vocabulary, place, often = (
            np.unique(np.concatenate(self.words), return_inverse=True, return_counts=True) if self.words
            else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([min(int(share * len(w)), len(w) - 1) for w in self.words], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.places = [place[x:y] for x, y in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        self.masks: dict[int, Masks] = {}
        # Codes: places in the vocabulary, then any other word, the end of a document, the end of an item.
        self.other, self.doc_end, self.item_end = (len(self.vocabulary) + x for x in range(3))
        self.start_item, self.start_place, self.walks = np.empty(0, np.int64), np.empty(0, np.int64), []
        self.begins = np.zeros(self.item_end + 1, bool)
        if not self.words:
            return
        starts = []
        for k, own in enumerate(self.places):
            # Rarest first, ties by the word's hash.
            able = own[:len(own) - TAIL]
            starts.append((k, np.lexsort((self.vocabulary[able], often[able]))[:self.edits[k] + SPARE]))
        self.start_item = np.concatenate([np.full(len(s), k) for k, s in starts])
        self.start_place = np.concatenate([s for _, s in starts])
        flat, offsets = ended(self.places, self.item_end)
        at = offsets[self.start_item] + self.start_place
        self.begins[flat[at]] = True
        self.add_walks(flat, at)

    def add_walks(self, flat: np.ndarray, at: np.ndarray) -> None:
        owners, cells, copies = self.trials()
        docs, offsets = ended(copies, self.doc_end)
        starts = np.flatnonzero(self.begins[docs])
        owner = np.searchsorted(offsets, starts, side="right") - 1
        found = np.zeros(len(copies), bool)
        enough = MOST_WALKS
        while len(self.walks) < enough:
            walk = Walk(len(self.walks), self.item_end + 1)
            walk.learn(flat, at)
            self.walks.append(walk)
            if enough < MOST_WALKS:
                continue
            for s, w in walk.meet(docs, starts):
                trial, k = owner[s], self.start_item[w]
                drift = np.abs(starts[s] - offsets[trial] - self.start_place[w])
                found[trial[(owners[trial] == k) & (drift <= self.edits[k])]] = True
            if (np.bincount(cells, found) >= TARGET_RECALL * np.bincount(cells)).all():
                enough = min(max(2 * len(self.walks), LEAST_WALKS), MOST_WALKS)

    def trials(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Items, cells (band of lengths and kind of edit) and copies with as many edits as are allowed."""
        rng = np.random.default_rng(SEED)
        bands = np.log2(self.sizes).astype(np.int64)
        owners, cells, copies = [], [], []
        for band in np.unique(bands).tolist():
            members = rng.permutation(np.flatnonzero(bands == band))
            for k in np.resize(members, max(8, min(TRIALS, TRIAL_WORDS >> band))).tolist():
                for kind in range(4):
                    n, edits = int(self.sizes[k]), int(self.edits[k])
                    how = rng.integers(0, 3, edits) if kind == 3 else np.full(edits, kind)
                    spots = rng.choice(n, edits, replace=False)
                    copy = self.places[k].copy()
                    copy[spots[how == 0]] = self.other
                    times = np.ones(n, np.int64)
                    times[spots[how == 1]] = 0
                    # An inserted word stands before the one at its place.
                    extra = spots[how == 2]
                    copy = np.insert(copy, extra, self.other)
                    times = np.insert(times, extra, 1)
                    owners.append(k)
                    cells.append(4 * band + kind)
                    copies.append(np.repeat(copy, times))
        return np.array(owners), np.array(cells), copies

    def mask(self, k: int) -> Masks:
        if k not in self.masks:
            self.masks[k] = mask_of(self.words[k].tolist())
        return self.masks[k]


def ended(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts after each other, each with the code `end` behind it, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    mark = np.array([end], np.int64)
    return np.concatenate([x for t in texts for x in (t, mark)]), np.cumsum(sizes) - sizes


class Masks:
    """Places of every word of a pattern as bits, in blocks of MASK_WORDS words, so that their size grows with the pattern alone."""

    def __init__(self, pattern: list[int]):
        self.blocks: list[tuple[dict[int, int], int]] = []
        for low in range(0, len(pattern), MASK_WORDS):
            part = pattern[low:low + MASK_WORDS]
            mask: dict[int, int] = {}
            for j, x in enumerate(part):
                mask[x] = mask.get(x, 0) | (1 << j)
            self.blocks.append((mask, len(part)))

    def __contains__(self, x: int) -> bool:
        return any(x in mask for mask, _ in self.blocks)


def mask_of(pattern: list[int]) -> Masks:
    return Masks(pattern)


def best_end(blocks: list[tuple[dict[int, int], int]], region: list[int]) -> tuple[int, int]:
    """Smallest edit distance between a pattern, given as blocks of masks, and any stretch of the region, and the first end of such a stretch."""
    n = sum(size for _, size in blocks)
    state = [[(1 << size) - 1, 0] for _, size in blocks]
    score, best, end = n, n, 0
    for at, x in enumerate(region, 1):
        step = 0  # how the distance at the block's upper edge changes with this word
        for (own, size), rows in zip(blocks, state, strict=True):
            plus, minus = rows
            ones = (1 << size) - 1
            eq = own.get(x, 0)
            xv = eq | minus
            if step < 0:
                eq |= 1
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = (minus | ~(xh | plus)) & ones
            mh = plus & xh & ones
            below = (ph >> (size - 1)) - (mh >> (size - 1))
            ph = ((ph << 1) | (step > 0)) & ones
            mh = ((mh << 1) | (step < 0)) & ones
            rows[0] = (mh | ~(xv | ph)) & ones
            rows[1] = ph & xv
            step = below
        score += step
        if score < best:
            best, end = score, at
    return best, end


def best_edits(mask: Masks | dict[int, int], n: int, region: list[int]) -> int:
    """Smallest edit distance between a pattern of n words and any stretch of the region; a single block's masks may be given alone."""
    return best_end([(mask, n)] if isinstance(mask, dict) else mask.blocks, region)[0]


def candidates(places: np.ndarray, offsets: np.ndarray, items: Items) -> np.ndarray:
    """Item, document, and place at which the item would start, of every sample shared; distinct, in order."""
    flat = np.insert(places, offsets[1:], items.doc_end)
    # A document's words lie behind the ends of those before it.
    starts = np.flatnonzero(items.begins[flat])
    found = []
    for low in range(0, len(starts), CHUNK):
        own = starts[low:low + CHUNK]
        for walk in items.walks:
            for s, w in walk.meet(flat, own):
                found.append(np.stack([items.start_item[w], own[s], items.start_place[w]]))
    if not found:
        return np.empty((3, 0), np.int64)
    item, spot, place = np.concatenate(found, axis=1)
    doc = np.searchsorted(offsets + np.arange(len(offsets)), spot, side="right") - 1
    return np.unique(np.stack([item, doc, spot - doc - place]), axis=1)


def search(t: pa.Table, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document number in the table, item number, edits, first word) of every match."""
    hashes, codes, offsets = plain_words(t["text"])
    if not len(codes) or not items.words:
        return
    at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)  # place in the vocabulary
    known = items.vocabulary[at] == hashes
    words = np.where(known, hashes, np.uint64(1))[codes]  # words outside the vocabulary are all alike
    places = np.where(known, at, len(items.vocabulary))[codes]  # of every word; one past the end: not in the vocabulary
    item, doc, start = candidates(places.astype(np.int64), offsets, items)
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    edges = np.searchsorted(item, np.arange(len(items.words) + 1))
    for k in np.unique(item).tolist():
        n, edits = int(items.sizes[k]), int(items.edits[k])
        mine = np.zeros(len(items.vocabulary) + 1, bool)
        mine[items.places[k]] = True
        for a in range(edges[k], edges[k + 1], CHUNK):
            z = min(a + CHUNK, edges[k + 1])
            low = np.maximum(start[a:z] - edits, offsets[doc[a:z]])
            high = np.minimum(start[a:z] + n + edits, offsets[doc[a:z] + 1])
            if (z - a) * (n + 2 * edits) > len(codes):
                upto = np.concatenate([[0], np.cumsum(mine[places])])
                hits = upto[np.maximum(high, low)] - upto[low]
            else:
                hits = np.zeros(z - a, np.int32)
                for step in range(n + 2 * edits):
                    there = low + step
                    hits += mine[places[np.minimum(there, len(codes) - 1)]] & (there < high)
            fits = hits >= n - edits
            for d, x, y in zip(doc[a:z][fits].tolist(), low[fits].tolist(), high[fits].tolist(), strict=True):
                own = regions.setdefault((d, k), [])
                if own and x <= own[-1][1]:
                    own[-1] = (own[-1][0], max(y, own[-1][1]))
                else:
                    own.append((x, y))
    for (d, k), own in sorted(regions.items()):
        n, mask = len(items.words[k]), items.mask(k)
        best, stop, low = n + 1, 0, 0
        for x, y in own:
            found, end = best_end(mask.blocks, words[x:y].tolist())
            if found < best:
                best, stop, low = found, x + end, x
        if best <= items.edits[k]:
            # Backwards from the end of the stretch to its start.
            _, length = best_end(mask_of(items.words[k][::-1].tolist()).blocks, words[low:stop][::-1].tolist())
            yield d, k, best, stop - length - int(offsets[d])


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_ITEM_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size, fetched one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len((r.text or "").encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def shared_items(docs: DataFrame, benchmark: DataFrame, share: float, min_words: int, limit: int):
    """Broadcasts of the benchmark's blocks."""
    text.require(benchmark, "item_id", "text")
    for ids, texts in item_blocks(benchmark, limit):
        yield docs.sparkSession.sparkContext.broadcast(Items(ids, texts, share, min_words))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, min_words: int = MIN_WORDS,
          limit: int = BLOCK_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, first_word, item_words) for every document and item found in it."""
    rows = text.only(docs, "doc_id", "text").filter("text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for shared in shared_items(docs, benchmark, share, min_words, limit):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for t in text.merged(batches, TEXT_BYTES):
                found = list(search(t, items))
                release()
                if found:
                    d, k, e, w = zip(*found, strict=True)
                    yield text.batch(
                        SCHEMA, doc_id=t["doc_id"].take(pa.array(d)).combine_chunks(), item_id=[items.ids[x] for x in k],
                        edits=list(e), first_word=list(w), item_words=[len(items.words[x]) for x in k])

        out = out.unionAll(rows.mapInArrow(find, SCHEMA))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, min_words: int = MIN_WORDS,
                  limit: int = BLOCK_ITEM_BYTES) -> DataFrame:
    """The rows in whose text no item is found, with all their columns. Every row is judged by its own text, whatever its id."""
    text.require(docs, "text")
    left = docs
    for shared in shared_items(docs, benchmark, share, min_words, limit):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for t in text.merged(batches, TEXT_BYTES):
                clean = np.ones(t.num_rows, bool)
                clean[[d for d, _, _, _ in search(t, items)]] = False
                release()
                yield from t.filter(pa.array(clean)).combine_chunks().to_batches()

        left = left.mapInArrow(keep, docs.schema)
    return left
