"""Block naming and mixing beside brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from rasterlake.llm import exact_blocks, mixing


def brute_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        flat = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[flat])
        out.append((d, keep[3], len(groups[flat]), hashlib.sha256(flat.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_copies_equal_brute_force(edge, documents):
    for docs in (edge, documents.select("doc_id", "text")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = exact_blocks.exact_copies(docs).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_copies(rows)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_long_copies_need_several_levels(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(40_000))
    rows = [(1, a), (2, a[:20_000] + " " + a[20_000:]), (3, a[:39_999] + "!"), (4, a[:30_000] + "!" + a[30_001:])]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_blocks.exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_dropping_copies_keeps_columns(edge, empty):
    out = exact_blocks.drop_copies(edge)
    assert out.columns == edge.columns and out.count() == exact_blocks.exact_copies(edge).filter("kept").count()
    assert exact_blocks.drop_copies(empty).count() == 0 == exact_blocks.exact_copies(empty).count()


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """The rule as it reads: share, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not above:
            return out | share
        for s in above:
            out[s] = cap * sizes[s]
            free.discard(s)


def check_mix(docs):
    got = mixing.mix(docs).collect()
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got if r.doc_id is not None) == sorted(
        (d, n, sizes[s], round(want[s], 6)) for d, s, n in rows if d is not None
    )
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in taken.items():
        assert abs(n - target * sum(1 for s in sizes if (sizes[s], round(want[s], 6)) == (size, target))) <= len(sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_mix_equals_brute_force(edge, documents):
    check_mix(documents)
    check_mix(edge)


def test_mixed_rows_hold_the_taken_words(edge, empty):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in mixing.mix(edge).collect())
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()
