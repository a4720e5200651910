"""Token ids: a word is merged once, in whatever chunks it stands, and ids stay those of the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from rasterlake.llm import word_ids as W


def test_a_word_is_merged_once():
    words = W.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    merged, merge = [], words._merge
    words._merge = lambda ids, word: merged.append(len(np.unique(word))) or merge(ids, word)
    got = words.block(["Sentence sentence, (sentence) sentence.", "", 'sentence!\t"sentence, sentence'])
    got += words.block(["SENTENCE;"])
    assert [len(x) for x in got] == [8, 0, 6, 2]
    assert sum(merged) == len({"sentence", ",", "(", ")", ".", "!", '"', ";"})


def test_ids_are_those_of_the_library(monkeypatch):
    words_path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(11)
    parts = ["Word", "it's", "aaaa", "x1y22", "été", "é", "привет", "…", "--", "中文", "'", "we'll", " ", "\n", " ", "  ", "\t", "?!", "naïve", "İ", "\U0001f600", ""]
    texts = ["", " ", *("".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(60))) for _ in range(300))]
    for chunks, pieces, block in ((200_000, 400_000, 500_000), (40, 12, 200), (3, 3, 1)):
        for name, value in (("CACHE_CHUNKS", chunks), ("CACHE_PIECES", pieces), ("BLOCK_CHARS", block)):
            monkeypatch.setattr(W, name, value)
        words = W.WordIds(words_path)
        for text, got in zip(texts, words.stream(iter(texts)), strict=True):
            assert np.array_equal(got, words.tokenizer.encode(text, add_special_tokens=False).ids), text
