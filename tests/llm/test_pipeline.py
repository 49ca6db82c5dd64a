from __future__ import annotations

import random
import re

from textcases import EDGE, TESTDATA, make_docs, words  # noqa: F401

import corpus_pipeline
from ripecast.llm import decontaminate
from ripecast.llm.queries import table
from ripecast.sources.files import materialize


def test_stages(spark):
    docs = table(spark, TESTDATA, "documents")
    names, sizes = [], [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, TESTDATA), "stage")
        names.append(name)
        sizes.append(docs.count())
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        if name == "benchmark decontamination":
            items = [words(r.text) for r in table(spark, TESTDATA, "benchmark").collect()]
            texts = [f" {' '.join(words(r.text))} " for r in docs.collect()]
            assert not any(f" {' '.join(i)} " in t for i in items for t in texts)
    assert len(names) == 5 and sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, TESTDATA).count() > 0
    docs = table(spark, TESTDATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, TESTDATA), "empty")
    assert docs.count() == 0


def plain_near_duplicates(rows):
    """Rows that stay: one of each group, by union of all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                head[root(a)] = root(b)
    best = {}
    for x, (d, _) in enumerate(rows):
        best.setdefault(root(x), []).append((d is None, d or 0, x))
    return [rows[min(group)[2]] for group in best.values()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_kept_rows_against_plain_python(spark):
    docs = table(spark, TESTDATA, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, TESTDATA)
    want = plain_near_duplicates(rows)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(want) and len(want) < len(rows)

    plain = lambda t: [x for w in words(t) if (x := re.sub(r"[\W_]+", "", w.lower()))]
    items = [w for r in table(spark, TESTDATA, "benchmark").collect() if len(w := plain(r.text)) >= 8]
    codes: dict[str, int] = {}
    masks = [(len(w), decontaminate.mask_of([codes.setdefault(x, len(codes)) for x in w])) for w in items]

    def leaks(t):
        own = [codes.get(x, -1) for x in plain(t)]
        return any(sum(x in m for x in own) >= n - int(0.2 * n) and decontaminate.best_edits(m, n, own) <= int(0.2 * n) for n, m in masks)

    clean = corpus_pipeline.decontaminated(spark, docs, TESTDATA)
    want = [(d, t) for d, t in rows if not leaks(t)]
    assert order((r.doc_id, r.text) for r in clean.collect()) == order(want) and len(want) < len(rows)


def test_stages_on_nulls_repeats_and_clashing_names(spark, make_docs):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    item = table(spark, TESTDATA, "benchmark").first().text
    leak = f"{long[::-1]} {item} {long[:90]}"
    rows = [*EDGE, (20, long), (20, long), (None, long), (None, long), (19, long + " tail"), (None, leak), (None, leak), (21, leak), (21, leak)]
    made = [(r[0], r[1], "en", "a") for r in rows]
    docs = make_docs(made).withColumnRenamed("size", "row").selectExpr("*", "0L AS n_chars", "1 AS `group`", "2 AS component_id")
    pairs = lambda df: order((r.doc_id, r.text) for r in df.collect())
    given = [(r[0], r[1]) for r in made]
    kept = corpus_pipeline.near_duplicates(spark, docs, TESTDATA)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and pairs(kept) == order(plain_near_duplicates(given))
    clean = corpus_pipeline.decontaminated(spark, docs, TESTDATA)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and pairs(clean) == order(r for r in given if r[1] != leak)
    assert (None, None) not in pairs(corpus_pipeline.quality(spark, docs, TESTDATA))
    assert {r[0] for r in pairs(corpus_pipeline.mixed(spark, docs, TESTDATA))} <= {r[0] for r in given}
    assert pairs(corpus_pipeline.shards(spark, docs, TESTDATA)) == order(given)
