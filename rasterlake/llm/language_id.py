"""Language of a text by string kernels.

The blended-spectrum presence kernel of two texts counts the distinct character n-grams (n = 1 to 3) that both hold, over
the square root of the product of their own counts. Letters are lower-cased and each has a code of its own, whether the sample
has it or not; everything that is no letter is one boundary sign, so every n-gram has an exact 64-bit code.
``LANDMARKS`` sample texts of each language span the kernel space (Nyström); one-versus-rest kernel ridge regression is
solved in it on the sample. A batch of texts is scored by two matrix products: presence by landmark presence gives the
kernel values, those by the regression weights the class scores.

The sample is bounded: at most ``PER_LANGUAGE`` labelled texts of each language, by a seeded hash of the id, and of
each its first ``SAMPLE_CHARS`` code points, so at most 4 times as many bytes. Everything else reads all rows and whole texts.

Defined cases: a null text and a text without a letter are ``und`` with score 0, as is every text where the sample is
empty; rows with a null language or id are not learned from; repeated rows are scored alike; an empty table gives an
empty result; further columns are not looked at and come back unchanged from ``keep_known``.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.session import cut, small_batches

PER_LANGUAGE = 300
SAMPLE_CHARS = 8192
LANDMARKS = 40
CODE_BITS = 18  # of a letter; Unicode has fewer than 2**18 of them
RIDGE = 1e-3
BATCH = 256
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    classes: list[str]
    codes: np.ndarray  # of each code point: 0 boundary, then letters
    grams: np.ndarray  # codes of the n-grams that a landmark holds
    landmarks: np.ndarray  # presence of each, over the root of the landmark's count
    weights: np.ndarray

    def presence(self, text: str) -> np.ndarray:
        """The distinct n-grams of a text, sorted."""
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        c = np.concatenate([[0], c, [0]]).astype(np.int64)
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        two = (c[:-1] << CODE_BITS) | c[1:]
        three = np.unique((two[:-1] << CODE_BITS) | c[2:])
        two = np.unique(np.concatenate([three >> CODE_BITS, two[-1:]]))
        one = np.unique(np.concatenate([two >> CODE_BITS, c[-1:]]))
        return np.concatenate([three, one | (1 << 60), two | (1 << 61)])

    def kernel(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.grams)), np.float32)
        for r, text in enumerate(texts):
            held = self.presence(text)
            at = np.minimum(np.searchsorted(self.grams, held), len(self.grams) - 1)
            x[r, at[self.grams[at] == held]] = 1 / np.sqrt(len(held))
        return x @ self.landmarks.T

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def fit(sample: list[tuple[str, str]]) -> Model:
    """(language, text) rows, the landmarks of a language first."""
    classes = sorted({lang for lang, _ in sample})
    letters = Counter(ch for _, text in sample for ch in text.lower() if _LETTER.match(ch))
    known = sorted(letters, key=lambda ch: (-letters[ch], ch))
    others = [ch for ch in map(chr, range(1 << 16)) if ch not in letters and _LETTER.match(ch)]
    others += [ch for ch in map(chr, range(1 << 16, 0x110000)) if unicodedata.category(ch)[0] == "L" and ch not in letters]
    codes = np.zeros(0x110000, np.int32)
    codes[[ord(ch) for ch in known + others]] = np.arange(1, len(known) + len(others) + 1)
    model = Model(classes, codes, np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    marks, used = [], Counter()
    for lang, text in sample:
        used[lang] += 1
        if used[lang] <= LANDMARKS:
            marks.append(text)
    held = [model.presence(text) for text in marks]
    model.grams = np.unique(np.concatenate(held))
    model.landmarks = np.array([np.isin(model.grams, h) / np.sqrt(len(h)) for h in held], np.float32)
    k = model.kernel([text for _, text in sample]).astype(np.float64)
    inner = model.kernel(marks).astype(np.float64)
    y = np.array([[1.0 if lang == c else -1.0 for c in classes] for lang, _ in sample])
    left = k.T @ k + RIDGE * len(sample) * inner + 1e-6 * np.eye(len(marks))
    model.weights = np.linalg.solve(left, k.T @ y).astype(np.float32)
    return model


def seeded_share(counts: DataFrame, per_label: int) -> DataFrame:
    """(label, share) of (label, n): a share of hashes that holds ``per_label`` rows of the label all but surely."""
    wanted = per_label + 8 * math.sqrt(per_label) + 8
    return cut(counts.select("label", (F.lit(wanted) / F.col("n")).alias("share")))


def below(h: Column, share: Column) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of all."""
    return F.pmod(h, F.lit(1 << 31)) <= share * float(1 << 31)


def bounded_sample(docs: DataFrame, learn: Column, label: str, id_col: str, text_col: str, per_label: int, chars: int) -> list[tuple]:
    """At most ``per_label`` (label, text) rows of each label, in the order of a seeded hash of the id.

    Labels are counted first, so that only the rows with the lowest hashes are ranked, however many there are.
    """
    text = F.substring(F.col(text_col).cast("string"), 1, chars)
    rows = docs.filter(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(label).alias("label"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h"), F.col(id_col).cast("string").alias("i"))
    shares = seeded_share(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), per_label)
    low = rows.join(shares, "label").filter(below(F.col("h"), F.col("share")))
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "i", "text"))
    chosen = low.withColumn("n", first).filter(F.col("n") <= per_label)
    return [(r["label"], r["text"]) for r in sorted(chosen.collect(), key=lambda r: (r["label"], r["n"]))]


def not_held_out(id_col: str) -> Column:
    return ~held_out(id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _predict(model: Model | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a batch."""
    preds, scores = [], []
    for start in range(0, len(column), BATCH):
        texts = [t or "" for t in column.slice(start, BATCH).to_pylist()]
        good = [i for i, t in enumerate(texts) if model and _LETTER.search(t)]
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if good:
            s = model.scores([texts[i] for i in good])
            best = s.argmax(axis=1)
            value = np.clip((s[np.arange(len(good)), best] + 1) / 2, 0, 1)
            for i, b, v in zip(good, best.tolist(), value.tolist()):
                pred[i], score[i] = model.classes[b], float(v)
        preds += pred
        scores += score
    return preds, scores


def _predictor(shared):
    def run(batches):
        for batch in batches:
            preds, scores = _predict(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    return run


def _keeper(shared, text_at: int):
    def known(column: pa.Array) -> list[bool]:
        if shared.value is None:  # nothing to learn from: a text with a letter is in some language
            return [_LETTER.search(t or "") is not None for t in column.to_pylist()]
        return [pred != UNKNOWN for pred in _predict(shared.value, column)[0]]

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(known(batch.column(text_at)), pa.bool_()))

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The model of the rows that may be learned from, shared with all tasks (None without any)."""
    sample = bounded_sample(docs, not_held_out(id_col), lang_col, id_col, text_col, PER_LANGUAGE, SAMPLE_CHARS)
    return docs.sparkSession.sparkContext.broadcast(fit(sample) if sample else None)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predictor(model), "key long, lang_pred string, score double")
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the model gives a language, with all their columns: ``und`` goes, a low score does not."""
    small_batches(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col)
    return docs.mapInArrow(_keeper(model, docs.columns.index(text_col)), docs.schema)
