"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters and digits) enters with three numbers: how strongly the word itself, and the strongest of its
character 4-grams and 5-grams (word ends included), mark toxic texts. These tables are learned from the sample as the
standardised difference of document shares, zero below ``LEAST``. A forward and a backward GRU read windows of ``WINDOW``
words that overlap by ``WINDOW - STRIDE``; attention pools their states to one logit. A text's score is that of its
highest window, and training goes by that too: each pass takes the highest window of every sample text.

The sample is bounded: at most ``PER_LABEL`` texts of each label, by a seeded hash of the id, of at most ``SAMPLE_CHARS``
code points each. All windows of all texts are scored; a window whose inputs are all zero has the same score as any other
of its length, which is computed once.

Defined cases: a null text is empty; a text without a word has the score of an empty window; without labelled rows of both
labels every score is 0; rows with a null id or label are not learned from; repeated rows are scored alike; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.llm.jaccard_join import shingles
from rasterlake.llm.language_id import below, held_out, not_held_out, seeded_share
from rasterlake.session import cut

PER_LABEL = 1500
SAMPLE_CHARS = 8192
WINDOW, STRIDE = 32, 24
UNITS = 8
TABLE_BITS = 18
LEAST = 4.0
THRESHOLD = 0.7
PASSES = 40
BLOCK_CHARS = 1_000_000

_SLOT = np.uint32((1 << TABLE_BITS) - 1)
_ODD = np.uint32(0x9E3779B1)
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Table slots: of the character n-grams at each byte (word ends are spaces), and of each word; the first bytes of the
    words, and the first word of each text (one entry more than texts)."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw) + b"      ", np.uint8)
    inside = _WORDY[data]
    x = np.where(inside, data, 32).astype(np.uint32)
    space = np.cumsum(~inside)
    n = len(data) - 5
    grams = []
    for size in (4, 5):
        h = np.zeros(n, np.uint32)
        for k in range(size):
            h = (h ^ x[k : k + n]) * _ODD
            h ^= h >> np.uint32(15)
        # neither two words in one n-gram nor mere spaces
        fits = (space[size - 2 : size - 2 + n] == space[:n]) & (inside[1 : n + 1])
        grams.append(np.where(fits, (h & _SLOT) + np.uint32(1), 0).astype(np.int64))
    begins = np.flatnonzero(inside[1:n] & ~inside[: n - 1]) + 1
    ends = np.cumsum([len(r) for r in raw])
    firsts = np.searchsorted(begins, np.r_[0, ends])
    if not len(begins):
        return grams, np.empty(0, np.int64), begins, firsts
    body = np.arange(begins[0], n) - np.repeat(begins, np.diff(np.r_[begins, n]))
    value = (x[begins[0] : n] * inside[begins[0] : n]).astype(np.uint64)
    place = (body.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value + np.uint64(1)) * (place ^ (place >> np.uint64(29))) * inside[begins[0] : n]
    value ^= value >> np.uint64(31)
    word = np.add.reduceat(value * np.uint64(0xBF58476D1CE4E5B9), begins - begins[0])
    word ^= word >> np.uint64(32)
    return grams, ((word & np.uint64(_SLOT)) + np.uint64(1)).astype(np.int64), begins, firsts


def _marks(sample: list[tuple[int, str]]) -> list[np.ndarray]:
    """The three tables: standardised difference of document shares of each slot; slot 0 is empty."""
    counts = np.zeros((2, 3, (1 << TABLE_BITS) + 1), np.float64)
    totals = np.zeros(2)
    for label, text in sample:
        grams, words, _, _ = slots([text])
        totals[label] += 1
        for k, s in enumerate((words, *grams)):
            counts[label, k][np.unique(s)] += 1
    both = counts.sum(axis=0) / totals.sum()
    spread = np.sqrt(np.maximum(both, 1e-12) * (1 / totals[0] + 1 / totals[1]))
    z = (counts[1] / totals[1] - counts[0] / totals[0]) / spread
    z = np.where((np.abs(z) >= LEAST) & (both > 0), np.clip(z, -10, 10) / 10, 0).astype(np.float32)
    z[:, 0] = 0
    return list(z)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two GRUs, attention over their joined states, one logit. ``x``: windows x words x inputs; ``mask``: real words."""

    def __init__(self, inputs: int = 3, units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.units = units
        self.p = {
            **{f"w{d}": draw(inputs, 3 * units) for d in (0, 1)}, **{f"u{d}": draw(units, 3 * units) for d in (0, 1)},
            **{f"b{d}": np.zeros(3 * units, np.float32) for d in (0, 1)},
            "wa": draw(2 * units, units), "ba": np.zeros(units, np.float32), "va": draw(units), "wo": draw(2 * units), "bo": np.full(1, -1, np.float32),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        p, n, steps = self.p, self.units, x.shape[1]
        keep: dict = {"x": x, "mask": mask}
        states = np.zeros((len(x), steps, 2 * n), np.float32)
        for d in (0, 1):
            h = np.zeros((len(x), n), np.float32)
            drive = x @ p[f"w{d}"] + p[f"b{d}"]
            trace = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                back = h @ p[f"u{d}"]
                gate = _sigmoid(drive[:, t, : 2 * n] + back[:, : 2 * n])
                z, r = gate[:, :n], gate[:, n:]
                new = np.tanh(drive[:, t, 2 * n :] + r * back[:, 2 * n :])
                m = mask[:, t, None]
                after = np.where(m, (1 - z) * new + z * h, h)
                trace.append((t, h, z, r, new, back[:, 2 * n :]))
                h = after
                states[:, t, d * n : (d + 1) * n] = h
            keep[d] = trace
        a = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        share = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-12)
        pooled = np.einsum("bt,bts->bs", share, states)
        keep |= {"states": states, "a": a, "share": share, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"][0], keep

    def backward(self, keep: dict, d_logit: np.ndarray) -> dict:
        p, n = self.p, self.units
        x, mask, states, a, share = (keep[k] for k in ("x", "mask", "states", "a", "share"))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["wo"], g["bo"] = keep["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["wo"]
        d_share = np.einsum("bs,bts->bt", d_pooled, states)
        d_states = share[:, :, None] * d_pooled[:, None, :]
        d_e = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("bt,btu->u", d_e, a)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["ba"] = d_a.sum(axis=(0, 1))
        g["wa"] = np.einsum("bts,btu->su", states, d_a)
        d_states += d_a @ p["wa"].T
        for d in (0, 1):
            d_h = np.zeros((len(x), n), np.float32)
            for t, h, z, r, new, back in reversed(keep[d]):
                d_h = d_h + d_states[:, t, d * n : (d + 1) * n]
                m = mask[:, t, None]
                d_now = d_h * m
                d_new = d_now * (1 - z) * (1 - new * new)
                d_z = d_now * (h - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_drive = np.concatenate([d_z, d_r, d_new], axis=1)
                d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"w{d}"] += x[:, t].T @ d_drive
                g[f"b{d}"] += d_drive.sum(axis=0)
                g[f"u{d}"] += h.T @ d_back
                d_h = d_h * ~m + d_now * z + d_back @ p[f"u{d}"].T
        return g

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, moments: dict, rate: float) -> None:
        """One pass of Adam over the windows."""
        order = np.random.default_rng(moments["t"]).permutation(len(x))
        for i in range(0, len(x), 128):
            b = order[i : i + 128]
            logit, keep = self.forward(x[b], mask[b])
            g = self.backward(keep, ((_sigmoid(logit) - y[b]) / len(b)).astype(np.float32))
            moments["t"] += 1
            for k, v in self.p.items():
                m1, m2 = moments.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
                d = g[k] + 1e-4 * v
                m1, m2 = 0.9 * m1 + 0.1 * d, 0.999 * m2 + 0.001 * d * d
                moments[k] = (m1, m2)
                v -= (rate * (m1 / (1 - 0.9 ** moments["t"])) / (np.sqrt(m2 / (1 - 0.999 ** moments["t"])) + 1e-8)).astype(np.float32)


@dataclass
class Scorer:
    tables: list[np.ndarray]
    network: Network
    plain: dict[int, float] = field(default_factory=dict)

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, word counts, text number) of all windows of all texts."""
        grams, words, begins, firsts = slots(texts)
        inputs = np.zeros((len(words) + 1, 3), np.float32)
        if len(words):
            inputs[:-1, 0] = self.tables[0][words]
            for k, g in enumerate(grams):
                z = self.tables[k + 1][g]
                inputs[:-1, k + 1] = np.maximum.reduceat(z, begins - 1)
        counts = np.diff(firsts)
        per = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(WINDOW, counts[text] - nth * STRIDE)
        at = (firsts[:-1][text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        at = np.where(np.arange(WINDOW) < size[:, None], at, len(words))
        return inputs[at], size, text

    def logits(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        mask = np.arange(WINDOW) < size[:, None]
        return np.concatenate([self.network.forward(x[i : i + 2048], mask[i : i + 2048])[0] for i in range(0, len(x), 2048)] or [np.empty(0)])

    def top(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Highest logit of each text, and the inputs and sizes of all windows with the number of the highest."""
        x, size, text = self.windows(texts)
        logit = np.empty(len(x), np.float32)
        marked = x.any(axis=(1, 2))
        logit[marked] = self.logits(x[marked], size[marked])
        for n in np.unique(size[~marked]).tolist():
            if n not in self.plain:
                self.plain[n] = float(self.logits(np.zeros((1, WINDOW, 3), np.float32), np.array([n]))[0])
            logit[~marked & (size == n)] = self.plain[n]
        first = np.searchsorted(text, np.arange(len(texts)))
        best = np.maximum.reduceat(logit, first) if len(texts) else logit
        at = np.lexsort((-logit, text))[first] if len(texts) else first
        return best, x, size, at

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.top(texts)[0])


def distinct(sample: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The sample without texts of which more than half of the word 5-grams stand in an earlier one: the words that near
    copies share would else seem to mark their label."""
    seen: set[int] = set()
    out = []
    for label, text in sample:
        grams = shingles([text.lower().encode("utf-8", "surrogatepass")])[0].tolist()
        if 2 * sum(g in seen for g in grams) <= len(grams):
            out.append((label, text))
            seen.update(grams)
    return out


def fit(sample: list[tuple[int, str]]) -> Scorer | None:
    """The scorer of (label, text) rows; None unless both labels are there."""
    sample = distinct(sample)
    if {label for label, _ in sample} != {0, 1}:
        return None
    scorer = Scorer(_marks(sample), Network())
    texts, y = [t for _, t in sample], np.array([label for label, _ in sample], np.float32)
    moments: dict = {"t": 0}
    x, size, text = scorer.windows(texts)
    first = np.searchsorted(text, np.arange(len(texts)))
    at = np.lexsort((-x.sum(axis=(1, 2)), text))[first]  # at the start the most marked window
    for turn in range(PASSES):
        if turn and turn % 8 == 0:
            logit = scorer.logits(x, size)
            at = np.lexsort((-logit, text))[first]
        scorer.network.fit(x[at], np.arange(WINDOW) < size[at][:, None], y, moments, 0.02 if turn < PASSES // 2 else 0.005)
    return scorer


def _score(shared):
    def run(batches):
        scorer: Scorer | None = shared.value
        for batch in batches:
            column, out = batch.column(1), []
            held, chars = [], 0

            def flush(held=held):
                out.extend(scorer.scores(held).tolist() if scorer else [0.0] * len(held))
                held.clear()

            for i in range(len(column)):
                held.append(column[i].as_py() or "")
                chars += len(held[-1])
                if chars >= BLOCK_CHARS:
                    flush()
                    chars = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[tuple[int, str]]:
    """At most ``PER_LABEL`` (label, text) rows of each label: ids are chosen among those of texts that are short enough."""
    known = labels.filter(not_held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("h")).distinct()
    text = F.col(text_col).cast("string")
    short = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(id_col).cast("long").alias("i"), text.alias("text"))
    known = cut(known.join(short.select("i"), "i", "left_semi"))
    shares = F.broadcast(seeded_share(known.groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n")), PER_LABEL))  # two rows
    low = known.join(shares, known["toxic"] == shares["label"]).filter(below(F.col("h"), F.col("share")))
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.pmod("h", F.lit(1 << 31)), "h", "i"))
    chosen = F.broadcast(low.select("i", "toxic", nth.alias("n")).filter(F.col("n") <= PER_LABEL))  # at most two times PER_LABEL rows
    rows = short.join(chosen, "i")
    return [(r["toxic"], r["text"]) for r in sorted(rows.select("toxic", "n", "text").collect(), key=lambda r: (r["toxic"], r["n"], r["text"]))]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, id_col, text_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_score(scorer), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
