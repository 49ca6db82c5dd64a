"""Repeated passages that are not lines of their own."""

from __future__ import annotations

import random

import numpy as np
from textcases import TESTDATA, make_docs, words  # noqa: F401

from ripecast.llm import paragraph_dedup, queries
from ripecast.llm.queries import table


def prose(rng, n):
    return [f"u{rng.randrange(10**6)}" for _ in range(n)]


def test_passages_in_lines_and_over_lines(make_docs):
    rng = random.Random(7)
    made, n = [], 40
    for k in range(n):
        p = prose(rng, 60)
        short = "\n".join(" ".join(p[i:i + 12]) for i in range(0, 60, 12))
        made += [(3 * k, " ".join(prose(rng, 200) + p + prose(rng, 150))), (3 * k + 1, " ".join(prose(rng, 90) + p + prose(rng, 300))),
                 (3 * k + 2, f"{' '.join(prose(rng, 10))}\n{short}\n{' '.join(prose(rng, 10))}")]
    docs = make_docs(made)
    found = paragraph_dedup.repeats(docs)
    got = [r.asDict() for r in found.collect()]
    assert all(r["paragraph"] is None for r in got)
    assert {r["doc_id"] for r in got if r["removed"]} == {d for d in range(3 * n) if d % 3}
    texts = {d: words(t) for d, t in made}
    for r in got:
        a, first = texts[r["doc_id"]][r["word"]:r["word"] + r["n_words"]], set(texts[r["first_doc_id"]])
        assert sum(w in first for w in a) >= 0.8 * r["n_words"] and r["n_words"] >= 20 and r["first_doc_id"] <= r["doc_id"]
    kept = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs, found).collect()}
    for d, t in made:
        gone = {i for r in got if r["doc_id"] == d and r["removed"] for i in range(r["word"], r["word"] + r["n_words"])}
        assert words(kept[d]) == [w for i, w in enumerate(texts[d]) if i not in gone]
        assert d % 3 or kept[d] == t


def test_one_copy_has_no_repeats(make_docs):
    rng = random.Random(8)
    assert paragraph_dedup.repeats(make_docs([(1, " ".join(prose(rng, 3000))), (2, "x " * 3000), (3, "\n".join(prose(rng, 300)))])).count() == 0


def test_cuts_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2**63, 400).astype(np.uint64)
    alone = paragraph_dedup.cuts_of(w, np.zeros(400, np.int64), 4)
    other = rng.integers(0, 2**63, 77).astype(np.uint64)
    behind = paragraph_dedup.cuts_of(np.concatenate([other, w]), np.repeat([0, 1], [77, 400]), 4) - 77
    assert (behind[behind >= 0] == alone).all()
    run_on = paragraph_dedup.cuts_of(np.concatenate([other, w]), np.zeros(477, np.int64), 4) - 77
    assert set(run_on[run_on >= 4]) == set(alone[alone >= 4])


def test_long_common_runs_of_the_tables(spark):
    """Of 50 words and more that another text has too, outside of removed lines, nearly all are reported."""
    got = [r.asDict() for r in queries.op4_passage_dedup(spark, TESTDATA).collect()]
    seen: dict[int, set[int]] = {}
    lines = {(r["doc_id"], r["paragraph"]) for r in got if r["paragraph"] is not None and r["removed"]}
    for r in got:
        if r["paragraph"] is None:
            seen.setdefault(r["doc_id"], set()).update(range(r["word"], r["word"] + r["n_words"]))
    where: dict[tuple, set[tuple[int, int]]] = {}
    for d, t in table(spark, TESTDATA, "documents").select("doc_id", "text").collect():
        at, stream = 0, []
        for k, line in enumerate((t or "").split("\n")):
            w = words(line)
            stream += [None] * len(w) if (d, k) in lines else w
            at += len(w)
        for i in range(len(stream) - 49):
            if None not in (run := tuple(stream[i:i + 50])):
                where.setdefault(run, set()).add((d, i))
    runs = [x for places in where.values() if len({d for d, _ in places}) > 1 for x in places]
    assert len(runs) > 50
    assert sum(bool(seen.get(d, set()) & set(range(i, i + 50))) for d, i in runs) >= 0.99 * len(runs)
    assert {x for x in queries.op4_paragraph_dedup(spark, TESTDATA).columns} < set(got[0])


def test_a_text_given_twice_under_one_id_is_not_lost(spark):
    line = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"thing{i}" for i in range(40))
    docs = spark.createDataFrame([(1, line), (1, line), (2, f"{line}\n{other}"), (3, other)], "doc_id long, text string")
    found = paragraph_dedup.repeats(docs)
    left = sorted((r.doc_id, r.text) for r in paragraph_dedup.without_repeats(docs, found).collect())
    assert left == [(1, line), (1, line), (2, other), (3, "")]
