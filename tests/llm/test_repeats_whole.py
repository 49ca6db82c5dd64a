from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from textcases import make_docs  # noqa: F401

from ripecast.llm import exchange as ex
from ripecast.llm import suffix_dedup


def asked(monkeypatch, make_docs, step, table):
    """What a block of documents sends in one of the two exchanges: (bucket, arrays), without its notes."""
    with monkeypatch.context() as m:
        m.setattr(ex, "exchange", lambda docs, ask, *rest: ask)
        ask = step(make_docs([(1, "x")]), suffix_dedup.LENGTH, suffix_dedup.GRAM)
    return [(b, ex.unpack(payload)) for b, payload in ask(table) if b >= 0]


def test_buckets_are_even(monkeypatch, make_docs):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=5000)) for _ in range(60)]
    raw, offsets = suffix_dedup.joined_bytes(pa.table({"text": texts}))
    per = np.bincount(suffix_dedup.anchors(raw, offsets, suffix_dedup.LENGTH, suffix_dedup.GRAM)[4])
    marks = [np.packbits(np.ones(n, np.uint8)).tobytes() for n in per.tolist()]
    table = pa.table({"doc_id": list(range(60)), "digest": list(range(60)), "text": texts, "mark": marks})
    for step in (suffix_dedup.marked, suffix_dedup.repeated_windows):
        sizes = [len(arrays[0]) for _, arrays in asked(monkeypatch, make_docs, step, table)]
        assert len(sizes) == 32 and sum(sizes) > 6000
        assert max(sizes) < 2 * sum(sizes) / 32


def in_one_process(sizes):
    """ex.exchange over a table, without Spark; `sizes` gets how many keys each bucket was sent."""
    def run(docs, ask, answer, settle, schema, block_bytes):
        notes, by = {}, {}
        for k in range(0, docs.num_rows, 40):
            for b, payload in ask(docs.slice(k, 40)):
                if b == ex.OWN:
                    notes[k] = payload
                else:
                    by.setdefault(b, []).append((k, payload))
        answers = {k: {} for k in notes}
        for b, sent in by.items():
            sizes[b] = sum(len(ex.unpack(p)[0]) for _, p in sent)
            for (k, _), given in zip(sent, answer([p for _, p in sent]), strict=True):
                answers[k][b] = given
        return pa.Table.from_batches([x for k in notes for x in settle(notes[k], answers[k])])
    return run


def spans_here(docs, monkeypatch, sizes):
    """(id, text) -> byte spans to remove."""
    monkeypatch.setattr(ex, "exchange", in_one_process(sizes))
    monkeypatch.setattr(ex, "bucket_count", lambda docs: 32)
    table = pa.table({"doc_id": [d for d, _ in docs], "digest": list(range(len(docs))), "text": [t for _, t in docs]})
    marks = suffix_dedup.marked(table, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    table = table.take(marks["digest"]).append_column("mark", marks["mark"]).combine_chunks()
    sizes.clear()
    found = suffix_dedup.repeated_windows(table, suffix_dedup.LENGTH, suffix_dedup.GRAM).to_pylist()
    return {r["digest"]: np.frombuffer(r["mark"], np.int64).reshape(-1, 2).tolist() for r in found}


def spans_wanted(docs):
    """Rows of an id count as one document: equal starts of equal ids are not earlier than each other."""
    least, want = {}, {}
    for d, t in docs:
        for i in range(len(t) - 99):
            piece = t[i:i + 100]
            least[piece] = min(least.get(piece, (d, i)), (d, i))
    for k, (d, t) in enumerate(docs):
        out = []
        for i in range(len(t) - 99):
            if least[t[i:i + 100]] != (d, i):
                if out and i <= out[-1][1]:
                    out[-1][1] = i + 100
                else:
                    out.append([i, i + 100])
        if out:
            want[k] = out
    return want


def test_a_footer_in_many_surroundings_is_dealt_by_windows(monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    foot = word(100)
    docs = [(k, word(200) + foot + word(200)) for k in range(400)]
    monkeypatch.setattr(suffix_dedup, "HOT", 50, raising=False)
    sizes = {}
    assert spans_here(docs, monkeypatch, sizes) == spans_wanted(docs)
    assert max(sizes.values()) < 0.1 * sum(sizes.values())


def test_equal_suffixes_of_a_block_are_sent_once(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=600))
    docs = [(k, text) for k in range(400)]
    sizes = {}
    assert spans_here(docs, monkeypatch, sizes) == spans_wanted(docs) == {k: [[0, 600]] for k in range(1, 400)}
    one = {}
    spans_here(docs[:40], monkeypatch, one)
    assert sum(sizes.values()) == 10 * sum(one.values()) < 10 * 40


def test_hot_or_not_the_spans_are_those_of_brute_force(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 500))) for _ in range(30)]
    texts += [rng.choice(texts)[rng.randrange(60):] + rng.choice(texts)[:rng.randrange(1, 400)] for _ in range(80)]
    docs = [(rng.choice([k, 5, suffix_dedup.LAST]), t) for k, t in enumerate(texts)]
    docs += docs[:20] + [(1, "z" * 400), (1, "z" * 400), (2, "z" * 300)]
    want = spans_wanted(docs)
    for most in (0, 2, 1 << 14):
        monkeypatch.setattr(suffix_dedup, "HOT", most, raising=False)
        assert spans_here(docs, monkeypatch, {}) == want


def test_hot_anchors_through_spark(monkeypatch, make_docs):
    rng = random.Random(10)
    foot = "".join(rng.choices("abcdefgh ", k=130))
    docs = [(k, "".join(rng.choices("ab", k=90)) + foot + "é" * rng.randrange(1, 60)) for k in range(60)] + [(None, "x" + foot), (7, foot), (7, foot), (8, None)]
    got = []
    for most in (1 << 14, 5):
        monkeypatch.setattr(suffix_dedup, "HOT", most)
        got.append(sorted((str(r["doc_id"]), bytes(r["kept"]), r["n_spans"]) for r in suffix_dedup.dedup(make_docs(docs)).collect()))
    assert got[0] == got[1] and len(got[0]) == len(docs) and sum(n for _, _, n in got[0]) >= 60
