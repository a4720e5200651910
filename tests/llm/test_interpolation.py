"""Scores of the interpolated model beside a model of plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterlake.llm import interpolation as I


def rest(doc):
    return None if doc is None else zlib.crc32(str(doc).encode()) % 10


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [" end"]


def count(docs, order):
    n = [Counter() for _ in range(order + 1)]
    for _, text in docs:
        line = [" begin"] * order + words(text)
        for i in range(order - 1, len(line)):
            for k in range(1, order + 1):
                n[k][tuple(line[max(0, i - k + 1) : i + 1])] += 1
    n[0] = sum(c for g, c in n[1].items() if g != (" begin",))
    return n


def shares(n, line, i, order):
    """(bucket, estimates) of the token at i."""
    bucket, out = 0, [n[1][(line[i],)] / max(n[0], 1)]
    for k in range(2, order + 1):
        c = n[k - 1][tuple(line[i - k + 1 : i])]
        out.append(n[k][tuple(line[i - k + 1 : i + 1])] / max(c, 1))
        bucket = bucket * I.BUCKETS + c.bit_length()
    return bucket, out


def brute(docs, order):
    train = [d for d in docs if rest(d[0]) != 0]
    kept, every = count([d for d in train if rest(d[0]) != 1], order), count(train, order)
    vocab = [sum(g != (" begin",) for g in n[1]) for n in (kept, every)]
    events = []
    for _, text in [d for d in train if rest(d[0]) == 1]:
        line = [" begin"] * order + words(text)
        events += [shares(kept, line, i, order) for i in range(order, len(line))]
    weights = I.normalised(np.zeros((I.BUCKETS ** (order - 1), order + 1)), kept[0])
    for _ in range(I.ROUNDS):
        sums = np.zeros_like(weights)
        for b, f in events:
            part = weights[b] * np.array([1 / (vocab[0] + 1), *f])
            sums[b] += part / part.sum()
        after, before = I.normalised(sums, kept[0]), weights
        weights = after
        if np.abs(after - before).max() < I.SETTLED:
            break
    if not every[0]:
        weights = I.normalised(np.zeros_like(weights), 0)
    out = []
    for doc, text in docs:
        line = [" begin"] * order + words(text)
        base = score = known = 0
        for i in range(order, len(line)):
            c = every[1][(line[i],)]
            known += c > 0
            base += math.log10((c + 0.1) / (every[0] + 0.1 * (vocab[1] + 1)))
            b, f = shares(every, line, i, order)
            score += math.log10(float(weights[b] @ [1 / (vocab[1] + 1), *f]))
        out.append((doc, rest(doc) == 0, len(line) - order, known, every[0], base, score))
    return sorted(out, key=str), weights


def got(spark, docs, **options):
    df = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "doc_id long, text string, row int, part int, fold string").repartition(3)
    return sorted([tuple(r) for r in I.scores(df, **options).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()], key=str)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9, abs=1e-9) and x[6] == pytest.approx(y[6], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("order,limit,bits", [(1, 10**6, 13), (2, 10**6, 13), (2, 150, 13), (2, 1, 2), (3, 500, 4)])
def test_scores_equal_dictionaries(spark, order, limit, bits):
    rng = np.random.default_rng(order)
    docs = [(i, " ".join(rng.choice(["A", "b", "Ça", "çA", "dd", "E.", f"x{i}"], int(rng.integers(0, 40))))) for i in range(120)]
    docs += [(7, None), (7, ""), (None, " \t\n"), (None, None), (8, "b " * 3000), (9, "b b b\x1cb"), (10, "</s> <s>"), *docs[:9], *docs[:3]]
    want, _ = brute(docs, order)
    same(got(spark, docs, order=order, limit=limit, part_bits=bits), sorted(want, key=str))


def test_no_training_or_no_deleted_documents(spark):
    held = [i for i in range(200) if rest(i) == 0][:3]
    docs = [(i, "some words") for i in held]
    assert got(spark, docs) == sorted([(i, True, 3, 0, 0, 0.0, 0.0) for i in held], key=str)
    kept = [(i, "some words") for i in range(200) if rest(i) > 1][:20]
    same(got(spark, docs + kept), brute(docs + kept, 2)[0])
    assert I.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_add_up_to_one():
    docs = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefg"), 30))) for i in range(100)]
    every = count([d for d in docs if rest(d[0]) != 0], 2)
    _, weights = brute(docs, 2)
    vocab = [g[0] for g in every[1] if g != (" begin",)]
    for context in [" begin", "a", "g", "never"]:
        total = 0.0
        for w in [*vocab, "unknown"]:
            b, f = shares(every, [" begin", context, w], 2, 2)
            total += float(weights[b] @ [1 / (len(vocab) + 1), *f])
        assert total == pytest.approx(1, abs=1e-9)


def test_arrays_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        for top in (2**64 - 1, 1000):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (I.unpack_keys(I.pack_keys(keys), len(keys)) == keys).all()
        counts = rng.choice([0, 1, 254, 255, 256, 10**12], n)
        assert (I.unpack_counts(I.pack_counts(counts), n) == counts).all()


def test_held_out_texts_are_likelier_than_by_words_alone(spark, documents):
    out = [r for r in I.scores(documents).collect()]
    assert len(out) == documents.count()
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
