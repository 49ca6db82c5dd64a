"""Every benchmark item within the allowed distance is found: by length and kind of edit, and against a search of everything."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from textcases import TESTDATA, make_docs, words  # noqa: F401

from ripecast.llm import decontaminate, queries
from ripecast.llm.queries import table


def edited(rng, w, kind, edits):
    w = w.copy()
    for p in sorted(rng.sample(range(len(w)), edits), reverse=True):
        how = rng.choice(["change", "insert", "delete"]) if kind == "mixed" else kind
        w[p:p + (how != "insert")] = [] if how == "delete" else [f"e{rng.randrange(99)}"]
    return w


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "mixed"])
@pytest.mark.parametrize("n", [8, 15, 40, 59, 120, 300])
def test_edited_items_alone(n, kind):
    rng = random.Random(n)
    items, texts = [], []
    for i in range(30):
        w = [f"b{i}x{rng.randrange(4000)}" for _ in range(n)]
        behind = " ".join(f"f{rng.randrange(900)}" for _ in range(60))
        items.append(" ".join(w))
        texts.append(f"{behind} {' '.join(edited(rng, w, kind, int(0.2 * n)))} {behind}")
    made = decontaminate.Items(list(range(30)), items, decontaminate.SHARE, decontaminate.MIN_WORDS)
    got = list(decontaminate.search(pa.table({"text": texts}), made))
    assert [(d, k) for d, k, _, _ in got] == [(i, i) for i in range(30)]
    assert all(e <= int(0.2 * n) for _, _, e, _ in got)


def test_place_and_blocks(spark, make_docs, monkeypatch):
    item = " ".join(f"b{i}" for i in range(30))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = item.replace("b7 ", "other ")
    docs = make_docs([(d, f"{'x ' * d}{near} and {item} end {item}") for d in range(20)])
    want = [(d, 1, 0, d + 31, 30) for d in range(20)]
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect()) == want
    monkeypatch.setattr(decontaminate, "TEXT_BYTES", 300)
    assert sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect()) == want


def test_against_all_places(spark):
    """The query's items and edits on the smallest tables, by the edit distance of every item to every document."""
    plain = lambda t: [x for w in words(t) if (x := re.sub(r"[\W_]+", "", w.lower()))]
    items = [(r.item_id, plain(r.text)) for r in table(spark, TESTDATA, "benchmark").collect()]
    codes: dict[str, int] = {}
    masks = [(i, len(w), decontaminate.mask_of([codes.setdefault(x, len(codes)) for x in w])) for i, w in items]
    want = set()
    for r in table(spark, TESTDATA, "documents").select("doc_id", "text").collect():
        own = [codes.get(x, -1) for x in plain(r.text)]
        for i, n, mask in masks:
            if n >= 8 and sum(x in mask for x in own) >= n - int(0.2 * n):
                best = decontaminate.best_edits(mask, n, own)
                if best <= int(0.2 * n):
                    want.add((r.doc_id, i, best, n))
    assert want
    assert {(r.doc_id, r.item_id, r.edits, r.item_words) for r in queries.op5_decontaminate(spark, TESTDATA).collect()} == want
