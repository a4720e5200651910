"""Packing: every id in one piece, gapless sequences, ids as the library gives them."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from rasterlake.llm import packing
from rasterlake.llm.word_ids import word_ids

TEXTS = ["", "  ", "Hello  WORLD's it's 12", "\x1cab Σας İx é é <|endoftext|>x don't", "日本語 𝒳 a b​c \x85d aaaaaaaaa 'sre''ll", "x" * 1001 + " " + "ab" * 501, "!!!???...---''''s"]


def test_ids_equal_the_library(documents):
    words = word_ids(packing.VOCABULARY)
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    for text, ids in zip(texts, words.block(texts)):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    words = word_ids(packing.VOCABULARY)
    assert words.block([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_assign_takes_the_cheapest_sequence_with_room():
    placed = packing.assign([60, 30, 50, 40, 20], 100)
    whole = {d: s for d, start, n, s in placed if start == 0 and n == [60, 30, 50, 40, 20][d]}
    assert whole[0] != whole[2] and whole[3] == whole[2] and whole[1] == whole[0]


def pieces_of(docs):
    pieces = packing.pack(docs).collect()
    words = word_ids(packing.VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.collect():
        ids = np.array(words.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = [p for p in by_doc[r.doc_id] if p.doc_tokens == len(ids)]
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 or len({q.doc_tokens for q in by_doc[r.doc_id]}) > 1 or r.doc_id is None for p in mine)
        assert {x for p in mine for x in range(p.start, p.start + p.length)} == set(range(len(ids)))
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:])) and s[-1].offset + s[-1].length <= 4096
    return pieces, by_sequence


def test_pieces_cover_all_ids_without_gaps(edge, documents, empty):
    pieces, sequences = pieces_of(documents.coalesce(2))
    tokens = sum(p.length for p in pieces)
    assert len(sequences) <= tokens / 4096 + 2
    pieces_of(edge)
    assert packing.pack(empty).count() == 0


def by_hand(lengths, capacity):
    """Pieces in order of falling cost to the cheapest sequence with room, all sequences looked at."""
    out, pieces, full = [], [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n // capacity * capacity, capacity):
            out.append((d, s, capacity, full))
            full += 1
        if n % capacity:
            pieces.append((n % capacity, d, n // capacity * capacity))
    bins = [[0.0, b, capacity] for b in range(-(-sum(p[0] for p in pieces) // capacity))]
    left = []
    for n, d, s in sorted(pieces, key=lambda p: (-p[0], p[1])):
        fits = [b for b in bins if b[2] >= n]
        if not fits:
            left.append((n, d, s))
            continue
        best = min(fits)
        best[0] += n + n * n / capacity
        best[2] -= n
        out.append((d, s, n, full + best[1]))
    return out, left


def test_a_piece_is_cut_only_if_it_fits_nowhere():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 4000, 1200), rng.integers(1, 4000, 300), rng.integers(1, 9000, 200), rng.integers(1, 60, 500)):
        want, left = by_hand(lengths.tolist(), 4096)
        got = packing.assign(lengths.tolist(), 4096)
        assert got[: len(want)] == want
        assert sum(n for _, _, n, _ in got) == lengths.sum() and sum(n for _, _, n, _ in got[len(want) :]) == sum(n for n, _, _ in left)
