"""Edge cases, recall and equal results by either way of the operators."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from textcases import EDGE, make_docs  # noqa: F401

from ripecast.llm import (
    components, decontaminate, jaccard_join, language_id, lm_scoring, mixing, paragraph_dedup, quality_rules, sharding,
    suffix_dedup, url_filter,
)


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def edge(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="module")
def empty(make_docs):
    return make_docs([])


def test_scores_by_either_way(spark, edge, empty):
    one, two = rows(lm_scoring.score(edge)), rows(lm_scoring.score(edge, broadcast_bytes=0))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["score"])
    assert len(one) == len(EDGE)
    for a, b in zip(sorted(one, key=key), sorted(two, key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"], rel=1e-9) and a["n_known"] == b["n_known"]
    assert next(r for r in one if r["doc_id"] == 2)["n_tokens"] == 1
    assert rows(lm_scoring.score(empty)) == []


def test_filter_never_underestimates():
    rng = np.random.default_rng(3)
    keys = lm_scoring.short_key(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.zipf(1.5, 20_000).clip(1, 10**6)
    bits = lm_scoring.segment(keys, counts)
    got = lm_scoring.read_levels(keys, bits)
    want = lm_scoring.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.95
    others = lm_scoring.short_key(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    assert (lm_scoring.read_levels(others, bits) > 0).mean() < 0.03


def test_sharding(edge, empty, make_docs):
    got = rows(sharding.assign(edge, 3))
    assert len(got) == len(EDGE) and all(0 <= r["shard"] < 3 for r in got)
    assert rows(sharding.assign(empty, 3)) == []
    docs = make_docs([(i, "w" * (i % 97) * 10) for i in range(4000)])
    load = Counter()
    for r in rows(sharding.assign(docs, 7)):
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 1000
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


def test_map_is_edited(make_docs):
    docs = make_docs([(i, "w" * (i % 97) * 10) for i in range(2000)])
    measured = sharding.measured(docs)
    first = sharding.stored_map(docs.sparkSession, measured, 5)
    second = rows(sharding.slot_map(sharding.slot_sizes(measured), 6, previous=first))
    was = {r["virtual_slot"]: r["shard"] for r in rows(first)}
    assert {r["version"] for r in second} == {2}
    assert all(r["moved"] == (r["shard"] != was[r["virtual_slot"]]) for r in second)
    assert sum(r["bytes"] for r in second if not r["moved"]) > 0.8 * sum(r["bytes"] for r in second)


def test_suffixes(edge, empty, make_docs):
    got = rows(suffix_dedup.dedup(edge))
    assert len(got) == len(EDGE) and rows(suffix_dedup.dedup(empty)) == []
    for r in got:
        if r["doc_id"] == 8:
            assert r["n_bytes"] == 16 * 40 and r["n_spans"] == 1 and r["n_removed"] == 16 * 40 - 16
        if r["doc_id"] == 11:
            assert r["n_removed"] == 50_000 - 1
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 700))) for _ in range(30)]
    texts += [rng.choice(texts)[rng.randrange(60):] + rng.choice(texts)[:rng.randrange(1, 400)] for _ in range(60)]
    first, want = set(), {}
    for d, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i:i + 100] in first:
                gone[i:i + 100] = b"\1" * 100
            first.add(t[i:i + 100])
        want[d] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in rows(suffix_dedup.dedup(make_docs(list(enumerate(texts)))))} == want


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    lists = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 40))) for _ in range(13)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.run_reader(*suffix_dedup.front_coded(x)) for x in lists]))
    assert [k for _, _, k in merged] == sorted(k for x in lists for k in x)
    before = b""
    for _, shared, key in merged:
        assert shared == suffix_dedup.shared_prefix(before, key, 0) or before == b""
        before = key
    assert list(suffix_dedup.merge_runs([])) == []


def test_paragraphs(edge, empty, make_docs):
    assert rows(paragraph_dedup.repeats(empty)) == []
    got = rows(paragraph_dedup.repeats(edge))
    assert {r["doc_id"] for r in got} == {8, 9}
    bands, height = paragraph_dedup.tune(80)
    assert 1 - (1 - 0.8**height) ** bands >= 0.99
    p = " ".join(f"w{i}" for i in range(60))
    q = " ".join(f"v{i}" for i in range(60))
    docs = make_docs([(1, f"short\n{p}"), (2, f"{p} end\n{q}"), (3, "other words")])
    found = paragraph_dedup.repeats(docs)
    kept = {r["doc_id"]: r["text"] for r in rows(paragraph_dedup.without_repeats(docs, found))}
    assert kept == {1: f"short\n{p}", 2: q, 3: "other words"}


def test_leaks(spark, edge, empty, make_docs):
    rng = random.Random(2)
    bench = [(i, " ".join(f"b{rng.randrange(4000)}" for _ in range(rng.randrange(12, 60)))) for i in range(60)] + [(98, None), (99, "too short")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    made, want = [], set()
    for i, t in bench[:60]:
        w = t.split()
        for _ in range(int(0.2 * len(w))):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at:at + (kind > 0)] = [f"e{rng.randrange(99)}"] if kind < 2 else []
        made.append((1000 + i, "some text before " * 5 + " ".join(w) + " and behind" * 5))
        made.append((2000 + i, "Some text, " + t.upper().replace(" ", ", ") + "."))
        want |= {(1000 + i, i), (2000 + i, i)}
    made += [(3000 + i, " ".join(f"b{rng.randrange(4000)}" for _ in range(300))) for i in range(50)]
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.leaks(make_docs(made), items))}
    assert not got - want
    assert {x for x in want if x[0] >= 2000} <= got
    assert len(got) >= 0.9 * len(want)
    assert got == {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.leaks(make_docs(made), items, limit=2000))}
    assert rows(decontaminate.leaks(edge, items)) == [] and rows(decontaminate.leaks(empty, items)) == []
    assert rows(decontaminate.leaks(make_docs(made), items.limit(0))) == []


def test_edit_distance():
    def plain(p, t):
        last = list(range(len(p) + 1))
        best = last[-1]
        for x in t:
            now = [0]
            for j, y in enumerate(p, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last, best = now, min(best, now[-1])
        return best
    rng = random.Random(9)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 15))]
        mask = {}
        for j, x in enumerate(p):
            mask[x] = mask.get(x, 0) | 1 << j
        assert decontaminate.best_edits(mask, len(p), t) == plain(p, t)


def test_jaccard(edge, empty, monkeypatch, make_docs):
    assert rows(jaccard_join.join(empty)) == []
    got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.join(edge))}
    assert got[9] == 8 and got[1] == 1 and len(rows(jaccard_join.join(edge))) == len(EDGE)
    # A family of near copies with texts that share much of them but don't link, through tiles of three.
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    made = []
    for d in range(40):
        w = base.copy()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(30)}"
        made.append((d, " ".join(w)))
    sets = {d: {tuple(t.split()[i:i + 5]) for i in range(116)} for d, t in made}
    above = dict.fromkeys(sets)
    for d in sets:
        above[d] = d
    root = lambda x: x if above[x] == x else root(above[x])
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    want = {d: root(d) for d in sets}
    assert 1 < len(set(want.values())) < 40
    docs = make_docs(made)
    assert {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.join(docs))} == want
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    assert {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.join(docs))} == want


def test_jaccard_without_ids(make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    got = rows(jaccard_join.join(make_docs([(None, long), (7, long), (None, long + " more"), (None, "alone in this text of words"), (None, None)])))
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [
        (0, 0, 0), (0, 2, 0), (0, 56, 7), (0, 57, 7), (7, 56, 7)]


def test_trees_join_what_links():
    rng = np.random.default_rng(8)
    families = [rng.integers(0, 1 << 63, 150).astype(np.uint64) for _ in range(25)]
    sets = [np.unique(rng.choice(f, int(n), replace=False)) for f in families for n in rng.integers(110, 150, 12)]
    sets += [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(40)]
    names = np.arange(len(sets))

    def plain(groups):
        above = {int(g): int(g) for g in groups}
        root = lambda x: x if above[x] == x else root(above[x])
        for a in range(len(sets)):
            for b in range(a):
                if jaccard_join.linked(sets[a], sets[b], 80):
                    x, y = root(int(groups[a])), root(int(groups[b]))
                    above[max(x, y)] = min(x, y)
        return [root(int(g)) for g in groups]

    for comps in (names, names // 3 * 3):
        walk = jaccard_join.Walk(80)
        tree, order = jaccard_join.tree_of(sets, comps)
        walk.within(tree, tree.top, 0)
        assert [walk.root(int(c)) for c in comps] == plain(comps)
        assert 0 < len(walk.links) < len(sets)
        assert walk.pruned > 0 and walk.compared < len(sets) * (len(sets) - 1) // 4
    # Two trees give the links between them.
    half = len(sets) // 2
    walk = jaccard_join.Walk(80)
    one, two = jaccard_join.Tree(sets[:half], names[:half], 1024), jaccard_join.Tree(sets[half:], names[half:], 1024)
    walk.across(one, one.top, 0, two, two.top, 0)
    walk.within(one, one.top, 0)
    walk.within(two, two.top, 0)
    assert [walk.root(int(c)) for c in names] == plain(names)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    above = {x: x for e in edges for x in e}
    root = lambda x: x if above[x] == x else root(above[x])
    for a, b in edges:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


def test_mixing(edge, empty, make_docs):
    assert rows(mixing.mix(empty)) == []
    assert all(r["repeats"] >= r["replica"] >= 1 for r in rows(mixing.mix(edge)))
    docs = make_docs([(i, "w" * 100, "en", "big" if i % 3 else "small") for i in range(6000)])
    got = rows(mixing.mix(docs, {"big": 1, "small": 3}))
    share = Counter(r["source"] for r in got)
    assert share["small"] / len(got) == pytest.approx(0.75, abs=0.03) and len(got) == pytest.approx(6000, rel=0.06)
    assert {r["source"] for r in rows(mixing.mix(docs, {"big": 1}))} == {"big"}
    counts = Counter(r["doc_id"] for r in got if r["source"] == "small")
    assert all(r["repeats"] == counts[r["doc_id"]] for r in got if r["source"] == "small")
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": -1})


def test_large_rates_do_not_underflow(spark):
    rates = spark.createDataFrame([("a", 10, 2000.0), ("b", 10, 0.0)], "source_key string, bytes long, rate double")
    steps = {r["source_key"]: r["steps"] for r in rows(mixing.poisson_steps(rates))}
    assert steps["a"][2000] == pytest.approx(0.506, abs=0.01) and steps["b"][0] == 1.0


def test_rules(spark, edge, empty, make_docs):
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)], "doc_id long, quality int")
    text = lambda i: " ".join(f"w{i}x{k}" + ("###" if i % 4 == 0 else "") for k in range(80))
    docs = make_docs([(i, text(i)) for i in range(500)])
    rules = quality_rules.learn(docs, labels)
    assert rules.rules
    got = {r["doc_id"]: r["kept"] for r in rows(quality_rules.judge(docs, labels))}
    assert got == {i: i % 4 != 0 for i in range(500)}
    none = labels.limit(0)
    assert quality_rules.learn(docs, none).rules == ()
    assert rows(quality_rules.judge(empty, labels)) == []
    assert len(rows(quality_rules.judge(edge, none))) == len(EDGE)


def test_repeated_windows_in_long_text(make_docs):
    r = rows(quality_rules.with_statistics(make_docs([(1, "a b c " * 20_000), (2, "a a a a"), (3, "p q r s p q r")])))
    assert [x["n_repeat_words"] for x in sorted(r, key=lambda x: x["doc_id"])] == [60_000, 4, 6]


def test_languages(edge, empty, make_docs):
    learned = language_id.profiles(make_docs([(i, "der die und das" if i % 2 else "the of and to", "de" if i % 2 else "en") for i in range(40)]))
    got = {(r["doc_id"], r["lang_pred"]) for r in rows(language_id.identify(edge, learned)) if r["doc_id"] in (1, 2, 3)}
    assert got == {(1, "und"), (2, "und"), (3, "und")}
    assert len(rows(language_id.identify(edge, learned))) == len(EDGE)
    assert rows(language_id.identify(empty, learned)) == []
    assert {r["lang_pred"] for r in rows(language_id.identify(edge, language_id.profiles(empty)))} == {"und"}
    # Profiles in blocks: the same results, ties of equal profiles to the smaller name.
    many = language_id.profiles(make_docs([(i, "der die und das" if i % 2 else "the of and to", f"l{i % 7}") for i in range(60)]))
    want = sorted(tuple(r) for r in rows(language_id.identify(edge, many)) if r["doc_id"])
    for limit in (1, 3, 7):
        assert sorted(tuple(r) for r in rows(language_id.identify(edge, many, limit=limit)) if r["doc_id"]) == want


def test_long_text_in_pieces(monkeypatch):
    raw = "Ein Text, der in Stücke geschnitten wird. " * 30
    whole = language_id.grams(raw)
    monkeypatch.setattr(language_id, "PIECE", 17)
    parts = language_id.grams(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_urls(spark):
    day = dt.date
    captures = spark.createDataFrame([
        (1, "http://a.bad.example/x", day(2024, 1, 5), "x"), (1, "http://a.bad.example/x", day(2024, 1, 5), "x"),
        (2, "https://user@BAD.example.:80/", day(2024, 2, 1), "x"), (3, "http://bad.example", day(2024, 3, 1), "x"),
        (4, None, day(2024, 1, 5), "x"), (5, "no url", day(2024, 1, 5), "x"), (6, "http://good.example", day(2024, 1, 5), "x"),
        (7, "http://bad.example", None, "x"),
    ], "page_id long, url string, fetched_on date, host string")
    changes = spark.createDataFrame([
        ("bad.example", "spam", "add", day(2024, 1, 1)), ("bad.example", "spam", "remove", day(2024, 2, 1)),
        ("BAD.example", "adult", "add", day(2024, 2, 20)), ("bad.example", "adult", "add", day(2024, 2, 25)),
        (None, "spam", "add", day(2024, 1, 1)), ("x.example", None, "add", day(2024, 1, 1)),
    ], "pattern string, category string, action string, changed_on date")
    got = [(r["page_id"], r["blocked"], r["categories"], r["listed_on"]) for r in rows(url_filter.judge(captures, changes))]
    assert sorted(got, key=str) == sorted([
        (1, True, "spam", day(2024, 1, 1)), (1, True, "spam", day(2024, 1, 1)), (2, False, None, None),
        (3, True, "adult", day(2024, 2, 25)), (4, False, None, None), (5, False, None, None), (6, False, None, None), (7, False, None, None),
    ], key=str)
    assert len(rows(url_filter.judge(captures, changes.limit(0)))) == 8 and rows(url_filter.judge(captures.limit(0), changes)) == []


def test_words():
    from ripecast.llm import text
    values, offsets = text.words_of(pa.array(["  A b\x0b", None, "", "c d \x1c e"]))
    assert values.to_pylist() == ["a", "b", "c d", "\x1c", "e"] and offsets.tolist() == [0, 2, 2, 2, 5]
