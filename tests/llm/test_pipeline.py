"""The pipeline beside its stages' rules."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import regex

import corpus_pipeline
from rasterlake.llm import packing
from rasterlake.llm.word_ids import word_ids
from rasterlake.session import cut
from test_jaccard_join import brute


def test_stages_take_effect(spark, edge):
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = cut(stage(spark, docs, "/nowhere"))
        assert docs.columns == edge.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language":
            assert sorted(map(repr, got)) == sorted(repr(r) for r in rows if regex.search(r"\p{L}", r[1] or ""))
        if name == "exact":
            flat = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in got]
            assert len(flat) == len(set(flat)) and set(flat) == {re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows}
        if name == "near":
            assert len(got) == len({(c, n) for _, c, n, _ in brute(rows)})
        if name == "mix":
            mixes(rows_with_sources(before), rows_with_sources(docs))
    packed(corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere"), docs)


def rows_with_sources(docs):
    return [(r.source, r.doc_id, r.text) for r in docs.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mixes(before, after):
    """Words per source near its target by water-filling, each text taken whole or, once per source, from its beginning."""
    size = Counter()
    for source, _, text in before:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    whole = {(s, d, t) for s, d, t in before}
    cut = Counter()
    for source, doc, text in after:
        taken[source] += len(words(text))
        if (source, doc, text) not in whole:
            assert any(s == source and d == doc and (t or "").startswith(text) for s, d, t in before)
            cut[source] += 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and all(n == 1 for n in cut.values())


def packed(pieces, docs):
    """Every id of every row in one piece, sequences without gaps."""
    encode = word_ids(packing.VOCABULARY).tokenizer.encode
    want = Counter()
    for r in docs.collect():
        ids = np.array(encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id, len(ids)] += len(ids)
    got, sequences = Counter(), {}
    for p in pieces.collect():
        got[p.doc_id, p.doc_tokens] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 4096


def test_run_over_the_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    packed(corpus_pipeline.run(spark, sf_dir), docs)
