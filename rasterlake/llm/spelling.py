"""Spelling variants by a bit-sliced position index.

Words that differ by exactly one inserted, deleted or replaced letter are near. A set of words is indexed by one bitset
per (position, letter); the bits are the words. A query runs through its letters once and keeps four bitsets at a time:
the words without an error so far, and those with one replaced, inserted or deleted letter, whose next letter is compared
at the same, the next or the previous position. All words of the set advance with one machine operation per 64 of them.
Bits are in the order of falling count, then of the word, so the variant that wins is the lowest bit of the result.

A vocabulary is not compared as a whole. A pair of lengths (L, L) or (L, L + 1) belongs to length class L, and its error
lies at one place, so the letters before the lower and behind the upper end of an interval around that place are equal.
Every word stands in the buckets (class, interval, letters outside) of its two classes and of both halves. A bucket of more
than ``LIMIT`` words is replaced by those of the two halves of its interval, round by round, down to one position, where
a bucket holds at most one word per letter and length: buckets are bounded for any vocabulary and no pair is lost. An insert could be
placed at several positions of a run; it counts where the longest common prefix ends, so each pair is found in one bucket,
and a bucket returns counts and the best variant of each of its words, never pairs.

Defined cases: a null text has no words, a null id is hashed as an empty one; repeated rows count again; ties go to the
smaller word in code-point order; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.operators.graphs import follow
from rasterlake.session import cut

LEAST_LETTERS = 7
LEAST_COUNT = 2
FACTOR = 10
DAMAGED = 31
LIMIT = 4096
HELD = 100_000
RUNS = "[A-Za-zÀ-ÿ]{%d,}"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counts(least: int):
    runs = re.compile(RUNS % least)

    def flush(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                head = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall(text.as_buffer().to_pybytes().translate(LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush(held)
                    held = Counter()
        yield flush(held)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters and ``least_count`` occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(_counts(least), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets per (position, letter) of the words of one set, shorter words (length ``size``) and longer ones by one.

    With ``inner`` an insert behind the last position is left to the interval that follows.
    """

    def __init__(self, words: list[str], size: int, inner: bool):
        self.size, self.inner = size, inner
        self.at: list[dict[str, int]] = [{} for _ in range(size + 1)]
        self.short = 0
        for i, word in enumerate(words):
            bit = 1 << i
            if len(word) == size:
                self.short |= bit
            for at, letter in zip(self.at, word):
                at[letter] = at.get(letter, 0) | bit
        self.long = ((1 << len(words)) - 1) ^ self.short

    def near_short(self, word: str) -> int:
        """Words that differ from a shorter one by one replaced or inserted letter."""
        none = self.short | self.long
        replaced = 0
        inserted = self.long
        at = self.at
        here = at[0]
        for i, letter in enumerate(word):
            there = at[i + 1]
            same = here.get(letter, 0)
            replaced = replaced & same | none & ~same
            none &= same
            inserted = inserted & there.get(letter, 0) | none
            here = there
        found = inserted & self.long
        return replaced & self.short | (found & ~none if self.inner else found)

    def near_long(self, word: str) -> int:
        """Shorter words that a longer one makes by losing a letter."""
        none, deleted = self.short, 0
        at = self.at
        before: dict[str, int] = {}
        for i, letter in enumerate(word):
            deleted = deleted & before.get(letter, 0) | none
            before = at[i]
            if i < self.size:
                none &= before.get(letter, 0)
        return deleted & ~none if self.inner else deleted


def search_bucket(entries: list[tuple[str, str, int]], size: int, inner: bool):
    """(word, number of near words, best n, best word) of every word that has any in the bucket.

    ``entries`` are (window, word, n), ordered by falling n and then word; windows are the letters that may differ.
    """
    index = PositionIndex([e[0] for e in entries], size, inner)
    if not index.short or (not index.long and len(entries) < 2):
        return
    for window, word, _ in entries:
        found = index.near_short(window) if len(window) == size else index.near_long(window)
        if found:
            best = entries[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), best[2], best[1]


def _search(batches):
    key, held = None, []
    out: list = []

    def close():
        if len(held) > 1:
            size, inner = held[0][3], held[0][4]
            out.extend(search_bucket([(e[0], e[1], e[2]) for e in held], size, inner))

    def flush():
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["word", "near", "n", "best"])
        out.clear()
        return batch

    for batch in batches:
        for k, *entry in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                close()
                key, held = k, []
            held.append(entry)
        yield flush()
    close()
    yield flush()


def _halves(rows: DataFrame) -> DataFrame:
    """(word, n, size, low, high) in the two halves of their intervals, where there are two."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    pieces = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    pieces = F.filter(pieces, lambda p: p["low"] < p["high"])
    return rows.select("word", "n", "size", F.explode(pieces).alias("p")).select("word", "n", "size", "p.low", "p.high")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the bucket and the window: the letters outside and inside of the interval."""
    back = F.col("size") - F.col("high")
    window = F.expr("substring(word, low + 1, length(word) - low - (size - high))").alias("window")
    key = F.concat_ws(":", "size", "low", "high", F.expr("left(word, low)"), F.expr("right(word, size - high)"))
    return rows.select("*", F.when(back >= 0, key).alias("key"), window)


def buckets(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, window, word, n, size, low, high) rows of buckets of at most ``limit`` words, or of one position."""
    classes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows = words.select("word", "n", classes).withColumn("low", F.lit(0)).withColumn("high", F.col("size"))
    rows = _keyed(_halves(rows))
    done: DataFrame | None = None
    while True:
        hot = cut(rows.groupBy("key").agg(F.count("*").alias("__m"), F.any_value(F.col("high") - F.col("low")).alias("__w")).filter((F.col("__m") > limit) & (F.col("__w") > 1)).select("key"))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(hot, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = _keyed(_halves(cut(rows.join(hot, "key", "left_semi"))))


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has near words in the same (word, n) table."""
    rows = buckets(words, limit)
    rows = rows.select("key", "window", "word", "n", (F.col("high") - F.col("low")).alias("size"), (F.col("high") < F.col("size")).alias("inner"))
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("n").desc(), "word")
    found = ordered.mapInArrow(_search, "word string, near long, n long, best string")
    rank = F.struct((-F.col("n")).alias("m"), F.col("best").alias("best"))
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(rank).alias("first"))
    return best.select("word", "n_near", (-F.col("first.m")).alias("best_n"), F.col("first.best").alias("best"))


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FACTOR, limit: int = LIMIT,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut(vocabulary(docs, id_col, text_col, least, least_count))
    near = words.join(near_words(words, limit), "word", "left")
    enough = F.col("best_n") >= F.col("n") * factor
    forms = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    ends = follow(forms.filter("form is not null").select(F.col("word").alias("id"), F.col("form").alias("to")), [])
    rooted = forms.join(ends.withColumnRenamed("id", "word"), "word", "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
