"""Bytes covered by a string of LENGTH bytes that also starts earlier, exactly, by a distributed suffix sort.

Not every suffix is sorted. Each window of LENGTH bytes has an anchor, its GRAM-byte string with the smallest hash (the first
of equals); equal windows have equal anchors at equal places. One anchor serves a run of windows, so there are
about 30 times fewer anchors than bytes, and windows can only be equal where their anchors' strings are.

1. A packed exchange tells every document which of its anchors occur elsewhere, and which are hot: in more than HOT different
   surroundings, counted by 16 bits of a hash. Those that occur nowhere else are done with.
2. Anchored suffixes: from the anchor to the end of its last window, then the bytes before the anchor backwards to
   the start of its first window. Every block sorts its suffixes per bucket (the anchor's hash) and sends them front-coded: length of
   the prefix shared with the one before, and the rest. Of a block's equal suffixes the first occurrence stands for all.
3. A bucket's runs are merged by a loser tree that keeps, per run, the prefix shared with the last winner: two suffixes are compared
   by those lengths, and only if they are equal byte by byte, from there on. The merge also says which neighbours are equal.
4. Of equal suffixes all but the first occurrence lose all their windows. Different suffixes of one anchor string share some
   windows at most; those are told by hashes of the windows, one per window of a distinct suffix.
5. A hot anchor's suffixes would meet in one task, so its windows are dealt one by one instead, by a hash of 96 bits: of a block's equal windows
   the first, so that a window costs one entry per block at most.
6. Blocks get back which windows of each suffix start earlier too, and turn them into byte spans.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; the order of occurrences is (doc_id, start), a
null id comes last; rows that share an id count as one document in that order, so equal starts are not earlier than each other (exact
repeats of a row keep each other's bytes); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import exchange as ex
from ripecast.llm import text
from ripecast.llm.jaccard_join import bucket_of
from ripecast.sources.files import materialize

LENGTH = 100
GRAM = 32                    # a power of two below LENGTH
BLOCK_BYTES = 2 << 20
BROADCAST_BYTES = 64 << 20   # marks and spans beyond this are joined by a shuffle
SLICE = 1024                 # suffixes hashed at once
HOT = 1 << 14                # different suffixes of one anchor string that are merged in one task
LAST = (1 << 63) - 1         # stands for a null id

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES = text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE2 = np.uint64(0x8CB92BA72F3D8DD7)
_BYTES2 = text.mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

MARKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("mark", T.BinaryType())])


def joined_bytes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, one after the other, and each text's offsets."""
    values = t["text"].combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from every place, by doubling."""
    h, power, size = _BYTES[raw], _BASE, 1
    while size < gram:
        h = h[:-size] * power + h[size:]
        power = power * power
        size *= 2
    return text.mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors in order: hash of their string, place, first and last window start, and number of their text."""
    empty = (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 4
    if len(raw) < length:
        return empty
    with np.errstate(over="ignore"):
        hashes = gram_hashes(raw, gram)
    span = length - gram + 1
    # Half of the hash, then the place: the smallest is the first of the smallest.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = np.repeat(offsets[:-1], whole) + np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    owner = np.repeat(np.arange(len(whole)), whole)
    if not len(starts):
        return empty
    at = place[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return hashes[at[first]], at[first], starts[first], starts[last], owner[first]


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every anchor. Anchors have the smallest hashes, so their upper bits are mostly zero and say nothing until they are mixed again."""
    return bucket_of(text.mix(keys), buckets)


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE, of_byte: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of the bytes from `start` to before `end`, for many such runs."""
    def powers(x: np.uint64) -> np.ndarray:
        out = np.ones(len(raw) + 1, np.uint64)
        out[1:] = x
        return np.multiply.accumulate(out, out=out)

    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(of_byte[raw] * powers(base)[:-1], out=sums[1:])
    return text.mix((sums[end] - sums[start]) * powers(np.uint64(pow(int(base), -1, 1 << 64)))[start])


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every run, one after the other."""
    count = count.astype(np.int64)
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def marked(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """MARKS: a bit per anchor of the document, set if another anchor has the same string (or, rarely, only the same fingerprint).

    If any is hot, as many bits more tell which.
    """
    buckets, most = ex.bucket_count(docs), HOT

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        raw, offsets = joined_bytes(t)
        keys, place, first, last, owner = anchors(raw, offsets, length, gram)
        own = dealt(keys, buckets)
        order, edges = ex.by_bucket(own, buckets)
        yield ex.OWN, ex.pack(t["doc_id"].to_numpy().astype(np.int64), t["digest"].to_numpy().astype(np.int64),
                              np.bincount(owner, minlength=t.num_rows).astype(np.uint32), own.astype(np.uint16 if buckets < 65536 else np.uint32))
        prints = keys[order].astype(np.uint32)
        surroundings = text.mix(run_hashes(raw, first, last + length) + (place - first).astype(np.uint64))[order].astype(np.uint16)
        for b in range(buckets):
            if edges[b + 1] > edges[b]:
                yield b, ex.pack(prints[edges[b]:edges[b + 1]], surroundings[edges[b]:edges[b + 1]])

    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        parts = [ex.unpack(p) for p in payloads]
        prints = np.concatenate([p for p, _ in parts])
        _, place, n = np.unique(prints, return_inverse=True, return_counts=True)
        often, hot = n[place] > 1, np.zeros(len(place), bool)
        if n.max() > most:
            kinds = np.unique(prints.astype(np.uint64) << np.uint64(16) | np.concatenate([x for _, x in parts]))
            hot = np.unique(kinds >> np.uint64(16), return_counts=True)[1][place] > most
        at = 0
        for p, _ in parts:
            yield ex.pack(np.packbits(often[at:at + len(p)]), np.packbits(hot[at:at + len(p)]))
            at += len(p)

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, digests, per, own = ex.unpack(notes)
        order, edges = ex.by_bucket(own, buckets)
        flags, hot = np.zeros(len(own), np.uint8), np.zeros(len(own), np.uint8)
        for b, payload in answers.items():
            for bits, given in zip((flags, hot), ex.unpack(payload), strict=True):
                bits[order[edges[b]:edges[b + 1]]] = np.unpackbits(given)[:edges[b + 1] - edges[b]]
        cuts = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
        keep = [k for k in range(len(ids)) if flags[cuts[k]:cuts[k + 1]].any()]
        marks = []
        for k in keep:
            more = hot[cuts[k]:cuts[k + 1]]
            marks.append(np.packbits(flags[cuts[k]:cuts[k + 1]]).tobytes() + (np.packbits(more).tobytes() if more.any() else b""))
        yield text.batch(MARKS, doc_id=ids[keep], digest=digests[keep], mark=marks)

    return ex.exchange(docs, ask, answer, settle, MARKS, BLOCK_BYTES)


def mark_bits(marks: list[bytes], per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each anchor of the documents occurs elsewhere, and whether it is hot."""
    flags, hot = [np.empty(0, np.uint8)], [np.empty(0, np.uint8)]
    for mark, n in zip(marks, per.tolist(), strict=True):
        bits, size = np.frombuffer(mark, np.uint8), (n + 7) // 8
        flags.append(np.unpackbits(bits[:size])[:n])
        hot.append(np.unpackbits(bits[size:])[:n] if len(bits) > size else np.zeros(n, np.uint8))
    return np.concatenate(flags) > 0, np.concatenate(hot) > 0


# -- sorted runs -----------------------------------------------------------------------------------

def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known:known + step] == b[known:known + step]:
        known += step
    x = int.from_bytes(a[known:known + step].ljust(step, b"\0"), "big") ^ int.from_bytes(b[known:known + step].ljust(step, b"\0"), "big")
    return min(n, known + step - (x.bit_length() + 7) // 8)


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix with the key before, rest's length, rests. Keys are sorted and shorter than 2 ** 16."""
    lcp, rest, before = np.empty(len(keys), np.uint16), [], b""
    for k, key in enumerate(keys):
        n = shared_prefix(before, key, 0)
        lcp[k] = n
        rest.append(key[n:])
        before = key
    return lcp, np.array([len(r) for r in rest], np.uint16), b"".join(rest)


def run_reader(lcp: np.ndarray, lengths: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared prefix with the key before, key) in order."""
    at, key = 0, b""
    for n, m in zip(lcp.tolist(), lengths.tolist(), strict=True):
        key = key[:n] + rests[at:at + m] if m or n != len(key) else key
        at += m
        yield n, key


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, prefix shared with the key before, key) in order of the keys; of equal keys the earlier run's first.

    A loser tree. Every waiting key has its shared prefix with the last winner that it met. The longer prefix
    is the smaller key; at equal prefixes the keys are compared from there, and the loser's prefix with the winner is
    what the comparison found.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    #: A player: (run, prefix shared with the last key put out, key); None: the run is over.
    losers: list[tuple[int, int, bytes] | None] = [None] * size

    def play(a, b):
        """(winner, loser), the loser's prefix relative to the winner."""
        if a is None:
            return b, a
        if b is None:
            return a, b
        if a[1] > b[1]:
            return a, b
        if b[1] > a[1]:
            return b, a
        x, y = a[2], b[2]
        n = shared_prefix(x, y, a[1])
        if n == len(x) and n == len(y):
            first = a[0] < b[0]
        elif n == len(x) or n == len(y):
            first = n == len(x)
        else:
            first = x[n] < y[n]
        return (a, (b[0], n, y)) if first else (b, (a[0], n, x))

    def pull(run: int):
        got = next(runs[run], None) if run < k else None
        return None if got is None else (run, got[0], got[1])

    level = [pull(r) for r in range(size)]
    level = [None if p is None else (p[0], 0, p[2]) for p in level]
    base = size
    while len(level) > 1:
        base //= 2
        nxt = []
        for i in range(base):
            winner, loser = play(level[2 * i], level[2 * i + 1])
            losers[base + i] = loser
            nxt.append(winner)
        level = nxt
    top = level[0] if level else None
    while top is not None:
        yield top
        run = top[0]
        # The next key of the winner's run: its prefix with the key before it in the run is its prefix with the last winner.
        now = pull(run)
        node = (size + run) // 2
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        top = now


def window_hashes(suffixes: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of every suffix, and the number of the suffix. A suffix is its bytes in text order and its window count.

    A slice of the suffixes at a time: the prefix sums take eight bytes per byte, the hashes that stay far less.
    """
    if len(suffixes) > SLICE:
        parts = [window_hashes(suffixes[at:at + SLICE], length) for at in range(0, len(suffixes), SLICE)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([w + k * SLICE for k, (_, w) in enumerate(parts)])
    width = max(len(s) for s, _ in suffixes)
    grid = np.zeros((len(suffixes), width + 1), np.uint64)
    for k, (s, _) in enumerate(suffixes):
        grid[k, 1:len(s) + 1] = _BYTES[np.frombuffer(s, np.uint8)]
    power = np.ones(width, np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    grid[:, 1:] *= power
    np.cumsum(grid, axis=1, out=grid)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.ones(width, np.uint64)
    back[1:] = inverse
    back = np.multiply.accumulate(back)
    most = width - length + 1
    hashes = (grid[:, length:length + most] - grid[:, :most]) * back[:most]
    count = np.array([n for _, n in suffixes])
    inside = np.arange(most) < count[:, None]
    return hashes[inside], np.repeat(np.arange(len(suffixes)), count)


def repeated_windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, digest, mark): byte spans to remove, as pairs of 64-bit numbers, of documents that have any. `docs` has the marks."""
    buckets = ex.bucket_count(docs)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        raw, offsets = joined_bytes(t)
        keys, place, first, last, owner = anchors(raw, offsets, length, gram)
        shared, hot = mark_bits(t["mark"].to_pylist(), np.bincount(owner, minlength=t.num_rows))
        ids = t["doc_id"].to_numpy().astype(np.int64)
        own, entry, at_head, windows, sent = suffixes(raw, offsets, ids, *(x[shared & ~hot] for x in (keys, place, first, last, owner)))
        notes = [ids, t["digest"].to_numpy().astype(np.int64), *own, entry, at_head, windows]
        own, entry, at_head, more = hot_windows(raw, offsets, ids, *(x[hot] for x in (first, last, owner)))
        yield ex.OWN, ex.pack(*notes, *own, entry, at_head)
        yield from sent
        yield from more

    def suffixes(raw, offsets, ids, keys, place, first, last, owner) -> tuple:
        """Runs of windows (document, start, count), the entry that stands for each, if it is at that one's place, windows per entry, and what is sent."""
        buf, starts, count = raw.tobytes(), first - offsets[owner], (last - first + 1).astype(np.uint16)
        order, edges = ex.by_bucket(dealt(keys, buckets), buckets)
        members, entries, heads, sent, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 0
        for b in range(buckets):
            own = order[edges[b]:edges[b + 1]]
            if not len(own):
                continue
            made = []
            for k in own.tolist():
                p, a, z = int(place[k]), int(first[k]), int(last[k])
                # Anchor to the end, the bytes before it backwards, and how many those are.
                made.append((buf[p:z + length] + buf[a:p][::-1] + (p - a).to_bytes(2, "big"), k))
            made.sort(key=lambda x: x[0])
            own = np.array([k for _, k in made], np.int64)
            new = np.array([k == 0 or made[k][0] != made[k - 1][0] for k in range(len(made))])
            entry = np.cumsum(new) - 1
            head = own[np.lexsort((starts[own], ids[owner[own]], entry))[new]]
            members.append(own)
            entries.append(entry + n)
            heads.append(head)
            n += len(head)
            sent.append((b, ex.pack(*front_coded([x for (x, _), f in zip(made, new.tolist(), strict=True) if f]), ids[owner[head]], starts[head], count[head])))
        own, entry, head = np.concatenate(members), np.concatenate(entries), np.concatenate(heads)
        at_head = (ids[owner[own]] == ids[owner[head[entry]]]) & (starts[own] == starts[head[entry]])
        return (owner[own].astype(np.uint32), starts[own], count[own]), entry.astype(np.uint32), np.packbits(at_head), count[head], sent

    def hot_windows(raw, offsets, ids, first, last, owner) -> tuple:
        """The same for the windows of hot anchors: an entry is one window, its buckets come after those of the suffixes."""
        count = (last - first + 1).astype(np.uint16)
        runs = owner.astype(np.uint32), first - offsets[owner], count
        if not len(first):
            return runs, np.empty(0, np.uint32), np.empty(0, np.uint8), []
        place, where = ranges(first, count), np.repeat(owner, count)
        one = run_hashes(raw, place, place + length)
        two = (run_hashes(raw, place, place + length, _BASE2, _BYTES2) >> np.uint64(32)).astype(np.uint32)
        starts, own_ids = place - offsets[where], ids[where]
        order = np.lexsort((starts, own_ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        head = order[new]
        entry = np.empty(len(order), np.uint32)
        entry[order] = np.cumsum(new) - 1
        at_head = (own_ids == own_ids[head[entry]]) & (starts == starts[head[entry]])
        # Sorted by the hash, so by the bucket too.
        edges = np.searchsorted(bucket_of(one[head], buckets), np.arange(buckets + 1))
        sent = [(buckets + b, ex.pack(*(x[head[a:z]] for x in (one, two, own_ids, starts))))
                for b, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if z > a]
        return runs, entry, np.packbits(at_head), sent

    def firsts(parts: list[list[np.ndarray]]) -> Iterator[bytes]:
        """Hot windows: True, if the same window starts earlier."""
        one, two, ids, starts = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((starts, ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        gone = np.empty(len(order), bool)
        gone[order] = (ids[order] != ids[lead]) | (starts[order] != starts[lead])
        at = 0
        for p in parts:
            yield ex.pack(np.packbits(gone[at:at + len(p[0])]), np.array([len(p[0])]))
            at += len(p[0])

    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        parts = [ex.unpack(p) for p in payloads]
        if len(parts[0]) == 4:
            yield from firsts(parts)
            return
        sizes = np.array([len(p[0]) for p in parts])
        offset = np.concatenate([[0], np.cumsum(sizes)])
        ids, starts, count = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        # Windows of every suffix, in the order of the runs; True: also starts earlier.
        cuts = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        gone = np.zeros(cuts[-1], bool)
        at = offset[:-1].tolist()
        group: list[tuple[bytes, list[int]]] = []   # distinct suffixes of one anchor string, and their numbers

        def close() -> None:
            heads = []
            for _, members in group:
                least = min(members, key=lambda m: (ids[m], starts[m]))
                heads.append(least)
                for m in members:
                    if (ids[m], starts[m]) != (ids[least], starts[least]):
                        gone[cuts[m]:cuts[m + 1]] = True
            if len(group) < 2:
                return
            plain = []
            for (key, _), head in zip(group, heads, strict=True):
                before = int.from_bytes(key[-2:], "big")
                body = key[:-2]
                plain.append((body[len(body) - before:][::-1] + body[:len(body) - before], int(count[head])))
            hashes, which = window_hashes(plain, length)
            heads_a = np.array(heads)
            own_ids = ids[heads_a][which]
            turn = np.arange(len(which)) - np.repeat(np.cumsum([n for _, n in plain]) - [n for _, n in plain], [n for _, n in plain])
            own_starts = starts[heads_a][which] + turn
            order = np.lexsort((own_starts, own_ids, hashes))
            same = np.zeros(len(order), bool)
            same[1:] = hashes[order][1:] == hashes[order][:-1]
            # The first of equal windows; others at the very same place of the same id are not later than it.
            lead = order[np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))]
            later = (own_ids[order] != own_ids[lead]) | (own_starts[order] != own_starts[lead])
            hit = order[later]
            gone[cuts[heads_a[which[hit]]] + turn[hit]] = True
            # Every equal of a head shares its windows' fate, unless it is at the head's own place.
            for (_, members), head in zip(group, heads, strict=True):
                for m in members:
                    if m != head and (ids[m], starts[m]) == (ids[head], starts[head]):
                        gone[cuts[m]:cuts[m + 1]] = gone[cuts[head]:cuts[head + 1]]

        for run, shared, key in merge_runs([run_reader(*p[:3]) for p in parts]):
            number = at[run]
            at[run] += 1
            if group and shared == len(key) == len(group[-1][0]):
                group[-1][1].append(number)
                continue
            if group and shared < gram:
                close()
                group.clear()
            group.append((key, [number]))
        if group:
            close()
        for k in range(len(parts)):
            own = gone[cuts[offset[k]]:cuts[offset[k + 1]]]
            yield ex.pack(np.packbits(own), np.array([len(own)]))

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, digests, owner, first, count, entry, at_head, windows, *hot = ex.unpack(notes)
        spans: dict[int, list[np.ndarray]] = {}

        def fates(buckets_of: list[int]) -> np.ndarray:
            given = [ex.unpack(answers[b]) for b in buckets_of]
            return np.concatenate([np.empty(0, np.uint8), *(np.unpackbits(bits)[:n[0]] for bits, n in given)]) > 0

        def later(at_head: np.ndarray, n: int) -> np.ndarray:
            """Occurrences that are not at the place of the one that stands for them."""
            return np.unpackbits(at_head)[:n] == 0

        if answers:
            of_suffix, of_window = fates(sorted(b for b in answers if b < buckets)), fates(sorted(b for b in answers if b >= buckets))
            at = (np.cumsum(windows, dtype=np.int64) - windows)[entry]
            gone = of_suffix[ranges(at, count)] | np.repeat(later(at_head, len(entry)), count)
            where, start = np.repeat(owner.astype(np.int64), count), ranges(first, count)
            owner, first, count, entry, at_head = hot
            gone = np.concatenate([gone, of_window[entry] | later(at_head, len(entry))])
            where, start = np.concatenate([where, np.repeat(owner.astype(np.int64), count)]), np.concatenate([start, ranges(first, count)])
            where, start = where[gone], start[gone]
            order = np.lexsort((start, where))
            where, start = where[order], start[order]
            if not len(start):
                yield text.batch(MARKS, doc_id=[], digest=[], mark=[])
                return
            new = np.ones(len(start), bool)
            new[1:] = (where[1:] != where[:-1]) | (start[1:] > start[:-1] + length)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start)) - 1
            for d, a, z in zip(where[head].tolist(), start[head].tolist(), start[tail].tolist(), strict=True):
                spans.setdefault(d, []).append(np.array([a, z + length], np.int64))
        keep = sorted(spans)
        yield text.batch(MARKS, doc_id=ids[keep], digest=digests[keep], mark=[np.concatenate(spans[k]).tobytes() for k in keep])

    return ex.exchange(docs, ask, answer, settle, MARKS, BLOCK_BYTES)


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Joined by id and digest of the text; the marks are broadcast if they are few bytes."""
    marks = marks.dropDuplicates(["doc_id", "digest"])
    size = marks.agg(F.coalesce(F.sum(F.length("mark") + 32), F.lit(0))).first()[0]
    return docs.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, ["doc_id", "digest"], how)


def keyed(docs: DataFrame) -> DataFrame:
    rows = text.only(docs, "doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    return rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("text"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, digest, mark) of keyed documents that lose bytes; see repeated_windows."""
    marks = materialize(marked(docs, length, gram), "anchor-marks")
    return repeated_windows(with_marks(docs, marks, "inner"), length, gram)


def apply_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of keyed documents; kept are the remaining bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for raw, mark in zip(t["text"].cast(pa.binary()).to_pylist(), t["mark"].to_pylist(), strict=True):
                pairs = np.frombuffer(mark or b"", np.int64).reshape(-1, 2).tolist()
                at, kept = 0, []
                for a, z in pairs:
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((len(raw), len(raw) - len(left), len(pairs), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([
                t["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_marks(docs, found, "left").select("doc_id", "text", "mark").mapInArrow(cut, schema).withColumn(
        "doc_id", F.nullif(F.col("doc_id"), F.lit(LAST)))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    if gram & (gram - 1) or not 1 <= gram < length:
        raise ValueError("gram must be a power of two below length")
    rows = keyed(docs)
    return apply_spans(rows, materialize(spans(rows, length, gram), "removed-spans"))
