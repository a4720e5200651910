"""Spelling variants beside a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from rasterlake.llm import spelling as S


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_vocabulary(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out = {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(others), None if form is None else n[form])

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {(w, f, root(w), c, k, fn) for w, (f, c, k, fn) in out.items()}


def rows(spark, docs, **options):
    df = spark.createDataFrame([(*d, "w", 3, "k") for d in docs], "doc_id long, text string, word string, n int, key string").repartition(3)
    return [tuple(r) for r in S.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def words_like(rng, count, letters="ab", sizes=(7, 11)):
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))) for _ in range(count)}


def test_index_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(40):
        size = rng.randrange(1, 6)
        words = sorted(words_like(rng, 30, "abc", (size, size + 2)))
        for inner in (False, True):
            found = {w: (k, b) for w, k, _, b in S.search_bucket([(w, w, 1) for w in words], size, inner)}
            for w in words:
                want = [v for v in words if near(w, v) and size in (len(v), len(w))]
                if inner:  # an insert that can stand behind the last letter belongs to the next interval
                    want = [v for v in want if not (v.startswith(w) or w.startswith(v))]
                assert found.get(w, (0, None)) == (len(want), min(want, default=None))


@pytest.mark.parametrize("limit", [1, 3, 20, 4096])
def test_every_pair_in_buckets_of_any_size(spark, limit):
    rng = random.Random(limit)
    docs = [(i, " ".join([w] * rng.choice([2, 3, 25, 260]))) for i, w in enumerate(sorted(words_like(rng, 90) | words_like(rng, 40, "aàÿz")))]
    n = brute_vocabulary(docs)
    got = rows(spark, docs, limit=limit)
    assert len(n) > 100 and len(got) == len(n) and set(got) == brute(n)


def test_odd_rows(spark):
    docs = [
        (1, None), (None, None), (2, ""), (3, "short words only"), (None, "Nullids Nullids nullidz " * 12), (4, "STRASSE Äpfelchen äpfelchen Äpfelchen"),
        (5, "x" * 50_000 + " " + "x" * 50_000), (6, "x" * 49_999 + " " + "x" * 49_999), (7, "a×b÷cdefg a×b÷cdefg naïveté naïveté"), (8, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa baaaaaaa baaaaaaa"),
        (9, "wordone wordone"), (9, "wordone wordone"), (10, "worrdone worrdone " + "wordone " * 40 + "wordones " * 900), (11, "𝒳wordone𝒳 1wordone2 wordone_wordone"),
    ]
    got = rows(spark, docs)
    assert len(got) == len(set(got)) and set(got) == brute(brute_vocabulary(docs))
    assert any(r[1] is not None and r[2] != r[1] for r in got)
    assert rows(spark, [(1, None)]) == []


def test_given_documents(spark, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    n = brute_vocabulary(docs)
    got = {tuple(r) for r in S.variants(documents).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    buckets = {}
    for w in n:  # deletion neighbourhoods find all pairs, and some others that ``near`` rejects
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            buckets.setdefault(k, set()).add(w)
    pairs = {w: set() for w in n}
    for group in buckets.values():
        for a in group:
            pairs[a] |= {b for b in group if near(a, b)}
    assert {(r[0], r[4]) for r in got} == {(w, len(p)) for w, p in pairs.items()}
    best = {w: min(p, key=lambda v: (-n[v], v), default=None) for w, p in pairs.items()}
    assert {(r[0], r[1]) for r in got} == {(w, b if b is not None and n[b] >= 10 * n[w] else None) for w, b in best.items()}
