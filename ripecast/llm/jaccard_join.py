"""Documents whose word n-gram sets overlap by a Jaccard share, joined by signature trees.

Exact for every pair, in steps that leave out only what can't link:

1. How many of a document's shingles occur in another document? A packed exchange of 32-bit
   fingerprints answers (a false match only lets a document through). A document with fewer than the share can have no link.
2. The others' sets are stored; equal sets become one class with its smallest id.
3. Shingles are ordered from rare to frequent. Two sets that link share one of their first n - ceil(share * n) + 1 shingles, so
   classes meet by those.
4. Signature trees: leaves are sets, nodes hold the OR of their token bitmaps and the range of their sizes. A dual traversal of a tree with
   itself, or of two, drops node pairs whose largest possible overlap is too small for their sizes, or that
   are in one component already; pairs of leaves that remain are counted exactly. Trees of few sets are one node, with a bit for every
   token; the nodes of many such trees are compared at once.
   First every class goes into one tree: that of the smallest class it meets most often, dealt in tiles of TILE classes.
5. Shingles whose classes are all linked by then have nothing left to tell. The classes of the others with the same smallest class go
   into one further tree, as long as they are no more than a TILE; beyond, every shingle's classes do, and a shingle with more than TILE
   classes is dealt out in pairs of tiles, so that no task gets an unbounded group.
6. Components of all links.

No step lists the pairs of a group of copies: equal sets are one class, and the traversal stops at what is joined.

Defined results: null or wordless text has an empty set and links with nothing; a text shorter than the n-gram is one
shingle; rows that share an id are one document (they link by any of their texts) and are all returned; a row with a
null id is a document of its own, greater than all others, and component_id is null if its group has no id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.llm import exchange as ex
from ripecast.llm import text
from ripecast.llm.components import components
from ripecast.sources.files import materialize

SIZE, SHARE = 5, 80   # words per shingle, per cent of the union
TILE = 1024
FAN_OUT = 8
LEAF, LEAF_TOKENS = 32, 4096   # groups of so few sets and tokens are one node
GROUP_BYTES = 4 << 20          # of groups read at once
SMALL_IDS = 2_000_000  # so many ids (16 MB) may be broadcast
MAP_BITS = 1 << 28     # of all leaf bitmaps of a tree

COUNTED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType()),
])
SETS = "doc_id long, n int, digest binary, tokens binary"
GROUP = ["kind", "token", "i", "j"]
PREFIX = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType())])


def sets_of(t: pa.Table, size: int) -> list[np.ndarray]:
    codes, names, offsets = text.coded_words(t["text"])
    return text.shingle_sets(text.hash_strings(names)[codes], offsets, size)


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (((tokens >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def shared_counts(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, n_shared): shingles that another document, or rarely another shingle by chance, has too."""
    buckets = ex.bucket_count(docs)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        sets = sets_of(t, size)
        lengths = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        own = bucket_of(tokens, buckets)
        order, edges = ex.by_bucket(own, buckets)
        prints = tokens[order].astype(np.uint32)
        doc = np.repeat(np.arange(len(sets)), lengths)
        per = np.bincount(own * len(sets) + doc, minlength=buckets * len(sets)).astype(np.uint32) if len(sets) else np.empty(0, np.uint32)
        yield ex.OWN, ex.pack(t["doc_id"].to_numpy().astype(np.int64), lengths, per)
        for b in range(buckets):
            if edges[b + 1] > edges[b]:
                yield b, ex.pack(prints[edges[b]:edges[b + 1]])

    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        parts = [ex.unpack(p)[0] for p in payloads]
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = n[place] > 1
        at = 0
        for p in parts:
            yield ex.pack(np.packbits(often[at:at + len(p)]))
            at += len(p)

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, lengths, per = ex.unpack(notes)
        shared = np.zeros(len(ids), np.int64)
        per = per.reshape(buckets, len(ids))
        for b, payload in answers.items():
            flags = np.unpackbits(ex.unpack(payload)[0])[:int(per[b].sum())]
            shared += np.bincount(np.repeat(np.arange(len(ids)), per[b])[flags > 0], minlength=len(ids))
        yield text.batch(COUNTED, doc_id=ids, n_shingles=lengths, n_shared=shared)

    return ex.exchange(docs, ask, answer, settle, COUNTED)


def of_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows whose key is among distinct ids, or with "left_anti" is not: by broadcast if the ids are few, else by a shuffled join."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, key, how)


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest of the set, and the sorted set as bytes; documents without words are left out."""
    import hashlib

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text.merged(batches, ex.BLOCK_BYTES):
            sets = sets_of(t, size)
            keep = [k for k, s in enumerate(sets) if len(s)]
            raw = [sets[k].tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([
                t["doc_id"].combine_chunks().take(pa.array(keep, pa.int64())), pa.array([len(sets[k]) for k in keep], pa.int32()),
                pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()),
            ], ["doc_id", "n", "digest", "tokens"])
            ex.release()

    return docs.mapInArrow(make, SETS)


def least_overlap(n: int, m: int, share: int) -> int:
    """Fewest common tokens with which sets of n and m tokens link: 100 * o >= share * (n + m - o)."""
    return -(-share * (n + m) // (100 + share))


def prefixes(classes: DataFrame, share: int) -> DataFrame:
    """(token, node): the rarest shingles of every class by which a link must show, without those that no other class has."""
    buckets = ex.bucket_count(classes)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        raw = t["tokens"].to_pylist()
        lengths = np.array([len(r) // 8 for r in raw], np.int64)
        tokens = np.frombuffer(b"".join(raw), np.uint64)
        order, edges = ex.by_bucket(bucket_of(tokens, buckets), buckets)
        prints = tokens[order].astype(np.uint32)
        yield ex.OWN, ex.pack(t["node"].to_numpy().astype(np.int64), lengths, tokens)
        for b in range(buckets):
            if edges[b + 1] > edges[b]:
                yield b, ex.pack(prints[edges[b]:edges[b + 1]])

    def answer(payloads: list[bytes]) -> Iterator[bytes]:
        parts = [ex.unpack(p)[0] for p in payloads]
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = n[place].astype(np.uint32)
        at = 0
        for p in parts:
            yield ex.pack(often[at:at + len(p)])
            at += len(p)

    def settle(notes: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        nodes, lengths, tokens = ex.unpack(notes)
        order, edges = ex.by_bucket(bucket_of(tokens, buckets), buckets)
        count = np.empty(len(tokens), np.uint32)
        for b, payload in answers.items():
            count[order[edges[b]:edges[b + 1]]] = ex.unpack(payload)[0]
        at, found, owners = 0, [], []
        for node, n in zip(nodes.tolist(), lengths.tolist(), strict=True):
            c, own = count[at:at + n], tokens[at:at + n]
            at += n
            first = np.lexsort((own, c))[:n - (share * n + 99) // 100 + 1]
            kept = own[first[c[first] > 1]]
            found.append(kept)
            owners.append(np.full(len(kept), node, np.int64))
        yield text.batch(PREFIX, token=np.concatenate(found).view(np.int64), node=np.concatenate(owners))

    return ex.exchange(classes.select("node", "tokens"), ask, answer, settle, PREFIX)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    need = least_overlap(len(a), len(b), share)
    return min(len(a), len(b)) >= need and overlap(a, b) >= need


class Tree:
    """Signature tree: level 0 are sets, each higher level joins FAN_OUT nodes: OR of token bitmaps, range of sizes."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray, bits: int):
        self.sets = sets
        self.comps = comps.tolist()
        lanes = bits // 64
        maps = np.zeros((len(sets), lanes), np.uint64)
        for k, s in enumerate(sets):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(maps[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        sizes = np.array([len(s) for s in sets], np.int64)
        # Tokens that share a bit with another of their own set: the bitmaps can't count them.
        lost = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, lost = self.levels[-1]
            at = np.arange(0, len(m), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(lost, at)))
        #: Per level, nodes known to lie in one component, and a label of it. Components only grow, so this stays true.
        self.whole: list[dict[int, int]] = [{} for _ in self.levels]

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def below(self, level: int, node: int) -> range:
        return range(node * FAN_OUT, min((node + 1) * FAN_OUT, len(self.levels[level - 1][0])))


class Walk:
    """Dual traversal of trees. `links` join components that no link found before has joined; `pruned` counts node pairs
    that were dropped by bitmap or size, `compared` the pairs of sets that were counted exactly."""

    def __init__(self, share: int):
        self.share = share
        self.above: dict[int, int] = {}
        self.links: list[tuple[Tree, int, Tree, int]] = []
        self.pruned = self.compared = 0

    def root(self, c: int) -> int:
        above = self.above
        while (p := above.get(c, c)) != c:
            above[c] = above.get(p, p)
            c = p
        return c

    def component(self, tree: Tree, level: int, node: int) -> int | None:
        """The component that holds all sets below the node, if one does."""
        if level == 0:
            return self.root(tree.comps[node])
        known = tree.whole[level].get(node)
        if known is not None:
            return self.root(known)
        first = None
        for k in tree.below(level, node):
            c = self.component(tree, level - 1, k)
            if c is None or (first is not None and c != first):
                return None
            first = c
        tree.whole[level][node] = first
        return first

    def within(self, tree: Tree, level: int, node: int) -> None:
        """All links among the sets below a node; sets beside each other first, since what they join is not looked at again."""
        if level == 0 or self.component(tree, level, node) is not None:
            return
        for k in tree.below(level, node):
            self.within(tree, level - 1, k)
        self.across(tree, level, node, tree, level, node)

    def across(self, left: Tree, i: int, a: int, right: Tree, j: int, b: int) -> None:
        """Links between the sets below two nodes; of one node with itself, between its children."""
        if i == 0 and j == 0:
            self.compared += 1
            if linked(left.sets[a], right.sets[b], self.share):
                x, y = self.root(left.comps[a]), self.root(right.comps[b])
                self.above[max(x, y)] = min(x, y)
                self.links.append((left, a, right, b))
            return
        own = left is right and (i, a) == (j, b)
        xs, ys = (left.below(i, a) if i >= j else range(a, a + 1)), (right.below(j, b) if j >= i else range(b, b + 1))
        i, j = i - (i >= j), j - (j >= i)
        ma, lo_a, hi_a, lost_a = (v[xs.start:xs.stop, None] for v in left.levels[i])
        mb, lo_b, hi_b, lost_b = (v[None, ys.start:ys.stop] for v in right.levels[j])
        most = np.bitwise_count(ma & mb).sum(axis=2, dtype=np.int64) + np.minimum(lost_a, lost_b)
        able = (100 * hi_a >= self.share * lo_b) & (100 * hi_b >= self.share * lo_a) & (
            (100 + self.share) * most >= self.share * (lo_a + lo_b))
        if own:
            able = np.triu(able, 1)
        self.pruned += (len(xs) * (len(xs) - 1) // 2 if own else able.size) - int(able.sum())
        for x, y in np.argwhere(able).tolist():
            c = self.component(left, i, xs.start + x)
            if c is None or c != self.component(right, j, ys.start + y):
                self.across(left, i, xs.start + x, right, j, ys.start + y)


def tree_of(sets: list[np.ndarray], comps: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree, and the order of its leaves: sets of a component beside each other, alike ones (by smallest token) too."""
    sizes = np.array([len(s) for s in sets])
    least = np.array([s[0] for s in sets], np.uint64)
    single = len(np.unique(comps)) == len(comps)
    order = np.lexsort((sizes, least) if single else (sizes, least, comps))
    bits = 64
    while bits < 8 * int(sizes.max()) and bits * len(sets) < MAP_BITS:
        bits *= 2
    return Tree([sets[k] for k in order], comps[order], bits), order


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by GROUP as tables of whole groups, with the groups' first rows and the end."""
    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in GROUP:
            v = t[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GROUP_BYTES:
            t = pa.Table.from_batches(held)
            starts = starts_of(t)
            if len(starts) > 1:
                # The last group may go on in the next batch.
                yield t.slice(0, starts[-1]), starts
                t = t.slice(starts[-1])
            held, size = t.to_batches(), t.nbytes
    if size:
        t = pa.Table.from_batches(held)
        yield t, np.append(starts_of(t), t.num_rows)


def tokens_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sets, and each set's offsets into them."""
    raw = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    cuts = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8) >> 3
    return np.frombuffer(raw.buffers()[2], np.uint64, int(cuts[-1]))[cuts[0]:], cuts - cuts[0]


def node_links(tokens: np.ndarray, sizes: np.ndarray, group: np.ndarray, label: np.ndarray, share: int) -> np.ndarray:
    """Of sets that lie together by group the first set of their component, by all links within groups; `label` is that by the links known before."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((tokens, group[owner]))
    own, sorted_tokens = group[owner[order]], tokens[order]
    first = np.append(True, own[1:] != own[:-1])
    rank = np.cumsum(np.append(True, first[1:] | (sorted_tokens[1:] != sorted_tokens[:-1]))) - 1
    # A bit for every token of a group.
    bit = np.empty(len(tokens), np.int64)
    bit[order] = rank - np.repeat(rank[first], np.diff(np.append(np.flatnonzero(first), len(rank))))
    lanes = (int(bit.max(initial=0)) >> 6) + 1
    maps = np.zeros(n * lanes, np.uint64)
    np.bitwise_or.at(maps, owner * lanes + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    maps = maps.reshape(n, lanes)

    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    members = np.diff(np.append(starts, n))
    x, y = [], []
    for g in np.unique(members).tolist():
        left, right = np.triu_indices(g, 1)
        at = starts[members == g, None]
        x.append((at + left).ravel())
        y.append((at + right).ravel())
    x, y = np.concatenate(x), np.concatenate(y)
    able = (label[x] != label[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= share * np.maximum(sizes[x], sizes[y]))
    x, y = x[able], y[able]
    step = max(1, (1 << 18) // lanes)
    both = [np.bitwise_count(maps[x[k:k + step]] & maps[y[k:k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step)]
    linked_ones = (100 + share) * np.concatenate([np.empty(0, np.int64), *both]) >= share * (sizes[x] + sizes[y])
    known = np.flatnonzero(label != np.arange(n))
    x, y = np.append(x[linked_ones], known), np.append(y[linked_ones], label[known])
    while True:
        least, after = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        if (after == label).all():
            return label
        label = after


Run = Callable[[pa.Table], tuple[list[int], list[int]]]


def joined_groups(groups: DataFrame, share: int, known: bool, run: Run) -> DataFrame:
    """(a, b): links within groups. Groups of one node are joined many at once, the others by `run`; `known`: sets of one `comp` are joined before."""

    def joined(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, offsets = tokens_of(t["tokens"])
        sizes = np.diff(offsets)
        rows = np.diff(starts)
        small = (rows <= LEAF) & (np.add.reduceat(sizes, starts[:-1]) <= LEAF_TOKENS) & (
            t["i"].to_numpy()[starts[:-1]] == t["j"].to_numpy()[starts[:-1]])
        a, b = [], []
        for k in np.flatnonzero(~small).tolist():
            left, right = run(t.slice(starts[k], rows[k]))
            a.append(np.array(left, np.int64))
            b.append(np.array(right, np.int64))
        group, node = np.repeat(np.arange(len(rows)), rows), t["node"].to_numpy()
        # A set may be its group's smallest class and be listed once more.
        picked = np.repeat(small, rows) & np.append(True, (node[1:] != node[:-1]) | (group[1:] != group[:-1]))
        if picked.any():
            group = group[picked]
            few = t.filter(pa.array(picked))
            nodes, label = few["node"].to_numpy(), np.arange(len(group))
            if known:
                comps = few["comp"].to_numpy()
                order = np.lexsort((label, comps, group))
                head = np.append(True, (comps[order][1:] != comps[order][:-1]) | (group[order][1:] != group[order][:-1]))
                label[order] = order[head][np.cumsum(head) - 1]
            after = node_links(tokens_of(few["tokens"])[0], sizes[picked], group, label, share)
            moved = (after != label) & (label == np.arange(len(label)))
            a.append(nodes[after[moved]])
            b.append(nodes[moved])
        return np.concatenate(a), np.concatenate(b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches):
            a, b = joined(t, starts)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            del t
            ex.release()

    return groups.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInArrow(work, "a long, b long")


def tree_join(groups: DataFrame, share: int) -> DataFrame:
    """Links within groups: rows (kind, token, i, j, tile, node, comp, tokens); tile i is joined with tile j, or with itself."""

    def run(t: pa.Table) -> tuple[list[int], list[int]]:
        tile = t["tile"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        nodes, comps = t["node"].to_numpy(), t["comp"].to_numpy()
        raw = t["tokens"].to_pylist()
        walk, made = Walk(share), []
        for number in sorted({i, j}):
            own = np.flatnonzero(tile == number)
            if len(own):
                tree, order = tree_of([np.frombuffer(raw[k], np.uint64) for k in own.tolist()], comps[own])
                made.append((tree, nodes[own[order]]))
        if made and i == j:
            walk.within(made[0][0], made[0][0].top, 0)
        elif len(made) == 2:
            (left, _), (right, _) = made
            # One width of bitmap for both.
            lanes = min(left.levels[0][0].shape[1], right.levels[0][0].shape[1])
            left, right = (x if x.levels[0][0].shape[1] == lanes else Tree(x.sets, np.array(x.comps), 64 * lanes) for x in (left, right))
            made = [(left, made[0][1]), (right, made[1][1])]
            walk.across(left, left.top, 0, right, right.top, 0)
        names = {id(tree): n for tree, n in made}
        return [int(names[id(left)][x]) for left, x, _, _ in walk.links], [int(names[id(right)][y]) for _, _, right, y in walk.links]

    return joined_groups(groups, share, True, run)


def home_links(groups: DataFrame, share: int) -> DataFrame:
    """(a, b): every class that its tree links with others, and the smallest class of those; rows as for `tree_join`."""

    def run(t: pa.Table) -> tuple[list[int], list[int]]:
        # A set may be its group's smallest class and be listed once more.
        nodes, at = np.unique(t["node"].to_numpy(), return_index=True)
        raw = t["tokens"].to_pylist()
        tree, _ = tree_of([np.frombuffer(raw[k], np.uint64) for k in at.tolist()], nodes)
        walk = Walk(share)
        walk.within(tree, tree.top, 0)
        label = np.array([walk.root(c) for c in nodes.tolist()], np.int64)
        moved = label != nodes
        return label[moved].tolist(), nodes[moved].tolist()

    return joined_groups(groups, share, False, run)


def group_links(meet: DataFrame, classes: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Links between classes (node, tokens) that share a token of `meet` (token, node): those found in a class's own tree,
    as (node, component), and those that further trees add to them. Together they connect all classes that links connect."""
    # Tokens of one class alone, as those that only equal sets have, end here.
    ends = meet.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("token", "a")
    met = materialize(meet.join(ends, "token"), "met-tokens")
    often = met.filter("a <> node").groupBy("node", "a").agg(F.count("*").alias("n"))
    homes = often.groupBy("node").agg(F.max(F.struct("n", (-F.col("a")).alias("minus"))).alias("best")).select(
        (-F.col("best.minus")).alias("token"), "node")
    # A class goes into one tree: that of the smallest class it meets most often, which is in each of its tiles.
    tiles = homes.groupBy("token").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    home = homes.join(tiles, "token").select("token", "node", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    first = home.unionAll(home.select("token", F.col("token").alias("node"), "tile").distinct())
    trees = first.join(classes, "node").select(F.lit(0).alias("kind"), "token", F.col("tile").alias("i"), F.col("tile").alias("j"),
                                               "tile", "node", F.col("node").alias("comp"), "tokens")
    stars = materialize(home_links(trees, share), "home-links")
    # A class is known to be linked with the smallest of its tree, and with that one's: labels good enough to tell what is settled.
    own = stars.select(F.col("b").alias("node"), F.col("a").alias("center"))
    known = materialize(own.join(own.select(F.col("node").alias("center"), F.col("center").alias("next")), "center", "left").select(
        "node", F.coalesce("next", "center").alias("component")), "home-labels")
    placed = met.join(known, "node", "left").select("token", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("least"),
                                        F.count("*").alias("g"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("lo <> hi")
    # Of tokens with the very same classes one is enough.
    telling = mixed.groupBy("g", "who", "least").agg(F.min("token").alias("token"))
    dealt = materialize(placed.join(telling, "token").select("token", "node", "comp", "least", "g"), "mixed-tokens")
    # Tokens with the same smallest class are joined at once, each set sent once, unless those are more than a tile of classes.
    members = dealt.select("least", "node", "comp").distinct()
    sizes = members.groupBy("least").agg(F.count("*").alias("members"))
    small = members.join(sizes, "least").filter(F.col("members") <= TILE).select(
        F.lit(0).alias("kind"), F.col("least").alias("token"), "node", "comp", F.lit(1).alias("tiles"))
    large = dealt.join(sizes, "least").filter(F.col("members") > TILE).select(
        F.lit(1).alias("kind"), "token", "node", "comp", F.ceil(F.col("g") / TILE).cast("int").alias("tiles"))
    parted = small.unionAll(large).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "kind", "token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp")
    links = materialize(tree_join(tiled.join(classes, "node"), share), "tree-links")
    return known, links


def numbered(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows with a number for every null id, and the smallest number used for that, greater than any id; None: there is no null id."""
    most, nulls = rows.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if not nulls:
        return rows, None
    beyond = max(-1 if most is None else most, -1) + 1
    # Stored, since both scans of the texts must see the same numbers.
    lone = materialize(rows.filter("doc_id IS NULL").select((F.lit(beyond).cast("long") + F.monotonically_increasing_id()).alias("doc_id"), "text"), "numbered")
    return rows.filter("doc_id IS NOT NULL").unionAll(lone), beyond


def join(docs: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest id reachable by links."""
    rows, beyond = numbered(text.only(docs, "doc_id", "text"))
    counted = materialize(shared_counts(rows, size), "shared-shingles")
    able = counted.filter(f"n_shingles > 0 AND 100 * n_shared >= {share} * n_shingles").select("doc_id").distinct()
    sets = materialize(token_sets(of_ids(rows, able), size).withColumn("row", F.monotonically_increasing_id()), "token-sets")
    # One row per distinct set stands for it.
    firsts = materialize(sets.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies")).select(
        "digest", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row")), "set-classes")
    # Read four times below.
    classes = materialize(of_ids(sets, firsts.select("row"), "row").select(F.col("doc_id").alias("node"), "tokens"), "classes")
    member = sets.select("doc_id", "digest").join(firsts.select("digest", "node"), "digest").select("doc_id", "node").filter(
        "doc_id <> node")

    known, links = group_links(materialize(prefixes(classes, share), "prefixes"), classes, share)
    ends = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links).unionAll(
        member.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    final = components(ends).withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    done = counted.select("doc_id", "n_shingles").join(final, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    if beyond is None:
        return done
    return done.withColumns({c: F.when(F.col(c) < beyond, F.col(c)) for c in ("doc_id", "component_id")})
