"""Token ids of many texts by a word-end BPE vocabulary of the ``tokenizers`` library.

White space never lies inside a pre-token, so a text is the concatenation of its chunks between white space. Chunks are
encoded once per worker and kept, and so are the pre-tokens they consist of, because a word stands in many chunks, with and
without a mark. All new pre-tokens of a block of texts are encoded together with numpy: in each step every pre-token merges
its pair of lowest rank, as the library does one pre-token at a time. Texts with rarer characters, which the two
lower case rules or Unicode tables may treat differently, or with a special token go to the library as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np
import regex

CACHE_CHUNKS = 200_000
CACHE_PIECES = 400_000
BLOCK_CHARS = 500_000
NONE = np.int64(1) << 40

# fixed value: the vocabulary's own pre-token pattern, plus the space between chunks
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
# what the two lower case rules or Unicode tables may treat differently, and special tokens
_ODD = re.compile("[\x1c-\x1fΣİ]|<\\||[^\\x00-\u02ff\u0370-\u052f\u2010-\u2060\u20a0-\u20bf\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")


def _odd(text: str) -> bool:
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


class Ids:
    """Ids of strings: those of string ``s`` are ``flat[begin[place[s]] : begin[place[s] + 1]]``."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def places(self, strings: list[str], most: int) -> tuple[np.ndarray, list[str]]:
        """Places of ``strings`` and the new ones among them, whose ids are to be added next; a full table is forgotten."""
        if len(self.place) > most:
            self._forget()
        old = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))
        new = list(islice(reversed(self.place), len(self.place) - old))
        return at, new[::-1]

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, np.cumsum(size) + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids.astype("<u4")])

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings at these places one after the other, and the number of each."""
        first = self.begin[at]
        size = self.begin[at + 1] - first
        return self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # printable bytes stand for themselves in the byte alphabet, the others follow from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = iter(range(256, 512))
        letter = [chr(b) if b in shown else chr(next(other)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letter], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in letter], np.int64)
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.chunks, self.pieces = Ids(), Ids()

    def _merge(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair of any word has a rank; ``word`` is the rising word number of each id."""
        done_ids, done_word = [], []
        while len(ids):
            pair = np.full(len(ids), NONE)
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            pair[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.repeat(np.minimum.reduceat(pair, starts), sizes)
            over = best == NONE
            done_ids.append(ids[over])
            done_word.append(word[over])
            take = (pair == best) & ~over
            if take[1:].any() and (take[1:] & take[:-1]).any():  # a run of one symbol: every second pair
                i = np.arange(len(take))
                first = np.maximum.accumulate(np.where(take, -1, i))
                take &= (i - first) % 2 == 1
            ids = np.where(take, self.made[np.where(take, pair, 0)], ids)
            keep = ~over
            keep[1:] &= ~take[:-1]
            ids, word = ids[keep], word[keep]
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], all_words[order]

    def _learn_pieces(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(size) - 1
        ids[ends] = self.final[data[ends]]
        gap = [i for i, p in enumerate(pieces) if p == " "]
        word = np.repeat(np.arange(len(size)), size)
        if gap:  # the space between chunks has no ids
            ids, word = ids[word != gap[0]], word[word != gap[0]]
        if len(ids):
            ids, word = self._merge(ids, word)
        self.pieces.add(ids, np.bincount(word, minlength=len(pieces)))

    def learn(self, chunks: list[str]) -> None:
        found = _PRE.findall(unicodedata.normalize("NFC", " ".join(chunks)) + " ")
        at, new = self.pieces.places(found, CACHE_PIECES)
        if new:
            self._learn_pieces(new)
        ids, size = self.pieces.get(at)
        stop = np.cumsum(size)[at == self.pieces.place[" "]]
        self.chunks.add(ids, np.diff(stop, prepend=0))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of a block."""
        split = [None if _odd(t) else t.lower().split() for t in texts]
        at, new = self.chunks.places([w for words in split if words for w in words], CACHE_CHUNKS)
        if new:
            self.learn(new)
        ids, size = self.chunks.get(at)
        stop = np.r_[0, np.cumsum(size)]
        stop = stop[np.cumsum([0, *(len(words or ()) for words in split)])].tolist()
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if words is None else ids[i:j]
            for t, words, i, j in zip(texts, split, stop, stop[1:])
        ]

    def stream(self, texts):
        """Ids of each text of an iterator, block by block."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from self.block(held)
                held, size = [], 0
        yield from self.block(held)


_LOADED: dict[str, WordIds] = {}


def word_ids(name_or_path: str) -> WordIds:
    """Loaded once per worker process; a bare file name is looked up in the public vocabulary folder."""
    if name_or_path not in _LOADED:
        path = name_or_path
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(name_or_path)
        _LOADED[name_or_path] = WordIds(path)
    return _LOADED[name_or_path]
