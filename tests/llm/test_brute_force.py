"""Whole queries against plain Python on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import duckdb
import pytest
from textcases import TESTDATA, words

from ripecast.llm import jaccard_join, queries


def read_documents(folder):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{folder}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return read_documents(TESTDATA)


def run(spark, name, folder=TESTDATA):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


class Groups:
    def __init__(self, items):
        self.above = {x: x for x in items}

    def root(self, x):
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, x, y):
        a, b = self.root(x), self.root(y)
        self.above[max(a, b)] = min(a, b)


def linked_groups(sets, share):
    groups, where = Groups(sets), collections.defaultdict(list)
    for d, s in sets.items():
        met = collections.Counter(e for x in s for e in where[x])
        for e, o in met.items():
            if 100 * o >= share * (len(s) + len(sets[e]) - o):
                groups.join(d, e)
        for x in s:
            where[x].append(d)
    return groups


def test_scores(spark, documents):
    tokens = {d: [*words(t), 0] for d, t, *_ in documents}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    count = collections.Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(count.values()), len(count)
    got = run(spark, "op1_lm_scoring")
    assert len(got) == len(documents)
    for r in got:
        w = tokens[r["doc_id"]]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (
            len(w), sum(count[x] > 0 for x in w), n, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    tested = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


def test_shards(spark, documents):
    got = run(spark, "op2_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in documents)
    texts = {d: (t or "").encode() for d, t, *_ in documents}
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(load.values()) - sum(load.values()) / queries.SHARDS <= largest


def test_repeated_bytes(spark, documents):
    first, want = set(), {}
    for d, t, *_ in sorted(documents):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            piece = raw[i:i + 100]
            if piece in first:
                gone[i:i + 100] = b"\1" * 100
            first.add(piece)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op3_suffix_dedup")}
    assert got == want


def test_paragraphs(spark, documents):
    sets = {}
    for d, t, *_ in documents:
        for k, line in enumerate((t or "").split("\n")):
            w = words(line)
            if len(w) >= 20:
                sets[d, k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    groups = linked_groups(sets, 80)
    size = collections.Counter(groups.root(x) for x in sets)
    want = {x: groups.root(x) for x in sets if size[groups.root(x)] > 1}
    got = run(spark, "op4_paragraph_dedup")
    found = {(r["doc_id"], r["paragraph"]): (r["first_doc_id"], r["first_paragraph"]) for r in got}
    assert len(found) >= 0.99 * len(want)
    assert all(want[x] == head for x, head in found.items())
    assert all(r["removed"] == ((r["doc_id"], r["paragraph"]) != (r["first_doc_id"], r["first_paragraph"])) for r in got)


@pytest.mark.parametrize("folder", [TESTDATA, TESTDATA.replace("sf0.001", "sf0.01")])
def test_jaccard(spark, folder, monkeypatch):
    sets = {}
    for d, t, *_ in read_documents(folder):
        w = words(t)
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    groups = linked_groups(sets, 85)
    by_trees = []
    plain = jaccard_join.group_links

    def counted(*args):
        known, links = plain(*args)
        by_trees.append(known.count() + links.count())
        return known, links

    monkeypatch.setattr(jaccard_join, "group_links", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op6_jaccard_join", folder)}
    assert got == {d: (len(s), groups.root(d)) for d, s in sets.items()}
    # Equal sets apart, every link comes from a tree.
    shown = {frozenset(s): groups.root(d) for d, s in sets.items() if s}
    assert sum(by_trees) >= len(shown) - len(set(shown.values()))


def test_quality_statistics(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op8_quality_rules")}
    assert len(got) == len(documents)
    for d, t, *_ in documents:
        r, w = got[d], words(t, lower=False)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_languages(spark, documents):
    got = run(spark, "op9_language_id")
    known = {d: lang for d, _, lang, _ in documents}
    tested = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in got} == set(known)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
