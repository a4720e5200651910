"""The similarity join beside all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from rasterlake.llm import jaccard_join as J


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """(doc_id, class_id, class_size, links) by all pairs of different texts."""
    texts = defaultdict(list)
    for d, t in rows:
        texts[tuple((t or "").lower().encode().split())].append(d)
    names = list(texts)
    sets = [grams(w) for w in names]
    root, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, w in enumerate(names):
        members[find(i)] += texts[w]
    out = []
    for i, w in enumerate(names):
        m = members[find(i)]
        for d in texts[w]:
            out.append((d, min((x for x in m if x is not None), default=None), len(m), links[i]))
    return sorted(out, key=repr)


def same(docs):
    got = sorted([(r.doc_id, r.class_id, r.class_size, r.links) for r in J.near_copies(docs).collect()], key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_join_equals_all_pairs(edge, documents):
    same(edge)
    same(documents.select("doc_id", "text"))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(400):  # several blocks of one component
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    got = same(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r[3] for r in got) > 400


def test_nothing_to_join(empty, edge):
    assert J.near_copies(empty).count() == 0 and J.drop_near_copies(empty).count() == 0
    kept = J.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len({(r.class_id, r.class_size) for r in J.near_copies(edge).collect()})


def test_pruning_keeps_what_may_reach_the_threshold():
    least = dict(J.least_matches())
    # a pair at the threshold has Binomial(h, 0.8) matches; fewer than the bound are very unlikely
    rng = np.random.default_rng(1)
    for h, m in least.items():
        assert (rng.binomial(h, 0.8, 200_000) < m).mean() < 1e-3
        assert m > 0.2 * h
