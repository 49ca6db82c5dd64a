"""Exact duplicates, importance resampling and clustering: edge cases and plain Python beside them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from textcases import EDGE, lowered, make_docs  # noqa: F401

from ripecast.llm import centroid_clustering, exact_dedup, importance_resampling


def rows(df):
    return [r.asDict() for r in df.collect()]


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


# -- exact duplicates --------------------------------------------------------------------------

REPEATED = [*EDGE, (12, "two  words"), (13, "two\twords"), (13, "two words"), (None, "two words"), (14, " two words"),
            (None, "no id"), (None, "no id"), (20, "same"), (20, "same"), (20, "same"), (15, " x"), (16, " x")]


@pytest.mark.parametrize("broadcast_bytes", [0, exact_dedup.BROADCAST_BYTES])
def test_copies(make_docs, broadcast_bytes):
    docs = make_docs(REPEATED).selectExpr("*", "'x' AS kept", "'x' AS group_size", "'x' AS n", "'x' AS row")
    got = rows(exact_dedup.classes(docs, broadcast_bytes))
    groups = defaultdict(list)
    for doc_id, text, *_ in REPEATED:
        groups[digest(text)].append(doc_id)
    assert Counter((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in got) == Counter(
        (doc_id, d, min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items() for doc_id in ids)
    stays = Counter(r["text_sha256"] for r in got if r["kept"])
    assert stays == dict.fromkeys(groups, 1)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_copies_with_all_columns(make_docs):
    docs = make_docs(REPEATED)
    left = rows(exact_dedup.dedup(docs))
    assert sorted(left[0]) == sorted(docs.columns)
    assert Counter(digest(r["text"]) for r in left) == Counter({digest(t): 1 for _, t, *_ in REPEATED})


def test_unique_rows_pass_straight_through(spark, make_docs):
    docs = make_docs([(i, f"text {i if i % 10 else 0}") for i in range(20_000)])
    stored = exact_dedup.with_digest(docs)
    segments = exact_dedup.segments_for(20_000)
    seen = exact_dedup.probe(stored, exact_dedup.repeated_filter(stored, segments), segments)
    maybe = {r["doc_id"] for r in seen.filter("__maybe").select("doc_id").collect()}
    assert {i for i in range(0, 20_000, 10)} <= maybe and len(maybe) < 2000 + 0.05 * 18_000
    # A filter far too small lets every row through to the exact step, for the same result.
    small, right = (Counter(map(str, rows(exact_dedup.judge(stored.select("doc_id", "text_sha256"), n)))) for n in (1, 20_000))
    assert small == right


def test_no_copies_of_nothing(make_docs):
    assert rows(exact_dedup.classes(make_docs([]))) == []


# -- importance resampling ---------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall(lowered(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])] * (longest == 2)


def drawn_plainly(docs, target, longest, buckets, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in runs(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = runs(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in found)
        out.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k for k, r in enumerate(able[:len(able) * percent // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("longest", [1, 2])
@pytest.mark.parametrize("head", [3, 20_000])
def test_draws(spark, make_docs, longest, head):
    rng = random.Random(longest)
    names = ["alpha", "Beta", "GAMMA", "d1", "ünï", "漢字", "x" * 100, "it's", "a_b", "end.", "İ", "K"]
    docs = [(i, " ".join(rng.choices(names, range(1, 13), k=rng.randrange(0, 60)))) for i in range(200)]
    docs += [r[:2] for r in EDGE if r[0] != 9] + [(500, "word.word\x00word\x7fword-word")]
    target = ["alpha beta gamma", None, "", "漢字 alpha"]
    got = importance_resampling.resample(
        make_docs(docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"),
        longest, 97, head, 30, 5)
    assert Counter(tuple(r.values()) for r in rows(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank"))) == Counter(
        drawn_plainly(docs, target, longest, 97, 30, 5))


def test_draws_of_nothing_and_of_ties(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(importance_resampling.resample(make_docs([]), none)) == []
    same = rows(importance_resampling.resample(make_docs([(None, "w " * 30)] * 10 + [(1, "w " * 30)] * 10), none, percent=50))
    assert sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 11))
    with pytest.raises(ValueError):
        importance_resampling.resample(make_docs([]), none, longest=3)


def test_head_holds_every_frequent_word(make_docs):
    docs = make_docs([(i, "often " * 8 + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(50)])
    head = importance_resampling.choose_head(docs, 4)
    assert head.words == {b"often": zlib.crc32(b"often")}


# -- clustering --------------------------------------------------------------------------------

def clustered_plainly(vectors, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"2:{kept[k][0]}".encode()).hexdigest(), kept[k]))
    x = np.array([v for _, v in kept], np.int64)
    c = x[order[:clusters]]
    for step in range(rounds + 1):
        far = np.square(x[:, None, :] - c).sum(2)
        own = far.argmin(1)
        if step < rounds:
            c = np.array([x[own == k].sum(0) // (own == k).sum() if (own == k).any() else c[k] for k in range(len(c))])
    best = far[np.arange(len(x)), own]
    sha = [hashlib.sha256(",".join(map(str, k)).encode()).hexdigest() for k in c.tolist()]
    return Counter((kept[k][0], int(own[k]), int(best[k]), int(best[own == own[k]].sum()), int(best.sum()), sha[own[k]]) for k in range(len(x)))


def vectors_of(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr(
        "*", "'x' AS cluster", "'x' AS distance", "'x' AS whole")


@pytest.mark.parametrize("spread", [0.01, 1.0, 1e5])
def test_clusters(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, spread, (6, 8))
    vectors = [(i, (centres[i % 6] + rng.normal(0, spread / 10, 8)).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)] + [(3, vectors[3][1])] * 2  # equal vectors and repeated rows
    got = centroid_clustering.cluster(vectors_of(spark, vectors), 9, 4, 8, 3)
    assert Counter(tuple(r) for r in got.collect()) == clustered_plainly(vectors, 9, 4)


def test_vectors_that_cannot_be_clustered(spark):
    good = [(i, [float(i), 0.0, -1.0]) for i in range(4)]
    bad = [(10, None), (11, [1.0, 2.0]), (12, [1.0, None, 2.0]), (13, [1.0, float("nan"), 0.0]), (14, [float("inf"), 0.0, 0.0]),
           (15, [1e9, 0.0, 0.0]), (16, [])]
    got = centroid_clustering.cluster(vectors_of(spark, good + bad), 9, 2, 3, 2)
    assert Counter(tuple(r) for r in got.collect()) == clustered_plainly(good, 9, 2)
    assert centroid_clustering.cluster(vectors_of(spark, bad), 9, 2, 3, 2).collect() == []
    assert centroid_clustering.cluster(vectors_of(spark, []), 9, 2, 3, 2).collect() == []


def test_most_distances_are_not_measured(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 4)) @ rng.normal(0, 1, (4, 32))
    vectors = [(i, (centres[i % 20] + rng.normal(0, 0.05, 32)).tolist()) for i in range(1000)]
    whole = centroid_clustering.kept(vectors_of(spark, vectors), 32)
    turn = centroid_clustering.rotation(whole, 32, 6)
    x = np.array([r.whole for r in whole.collect()])
    leading, rest = turn.split(x.astype(float))
    c = x[:20]
    own, far, measured = centroid_clustering.nearest(x, leading, rest, c, turn)
    every = np.square(x[:, None, :] - c).sum(2)
    assert (own == every.argmin(1)).all() and (far == every.min(1)).all()
    assert measured < 0.2 * every.size
