from __future__ import annotations

import numpy as np

from ripecast.llm import jaccard_join


def labels(edges):
    """The smallest node of every node's component."""
    above = {}

    def root(c):
        while above.get(c, c) != c:
            c = above[c]
        return c

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    return {n: root(n) for e in edges for n in e}


def near_sets(rng, families, most):
    """Sets of 3 to 60 tokens in families of near copies: (family, tokens)."""
    found = []
    for f in range(families):
        base = rng.integers(1, 1 << 62, rng.integers(3, 60))
        for _ in range(rng.integers(1, most + 1)):
            own = base.copy()
            own[rng.integers(0, len(own), 1 + len(own) // 15)] = rng.integers(1, 1 << 62)
            found.append((f // 2, np.unique(own.astype(np.uint64))))
    return found


def test_many_small_groups_are_joined_at_once_and_as_by_trees(spark, monkeypatch):
    """Before, every group was a call of its own, with a tree of its own."""
    rng = np.random.default_rng(3)
    sets = near_sets(rng, 120, 24)
    rows = [(0, f, 0, 0, 0, n, n - n % 2, s.tobytes()) for n, (f, s) in enumerate(sets)]
    # The smallest set of a group may be listed twice.
    rows += [r for r in rows if r[1] % 3 == 0 and (r[5] == 0 or rows[r[5] - 1][1] != r[1])]
    groups = spark.createDataFrame(rows, "kind int, token long, i int, j int, tile int, node long, comp long, tokens binary")
    assert "FlatMapGroupsInArrow" not in jaccard_join.home_links(groups, 80)._jdf.queryExecution().toString()
    pairs = [(a, b) for a, (f, s) in enumerate(sets) for b, (g, t) in enumerate(sets[:a]) if f == g and jaccard_join.linked(s, t, 80)]
    known = [(n, n - n % 2) for n in range(len(sets))]
    want_home, want_tree = labels(pairs), labels([(a - a % 2, b - b % 2) for a, b in pairs] + known)
    for leaf, size in ((32, 4 << 20), (5, 4000), (1, 1)):
        monkeypatch.setattr(jaccard_join, "LEAF", leaf)
        monkeypatch.setattr(jaccard_join, "GROUP_BYTES", size)
        home = [tuple(r) for r in jaccard_join.home_links(groups, 80).collect()]
        assert labels(home) == want_home and all(want_home[b] == a for a, b in home)
        tree = [tuple(r) for r in jaccard_join.tree_join(groups, 80).collect()]
        assert labels(tree + known) == want_tree
    assert jaccard_join.home_links(groups.limit(0), 80).count() == 0
