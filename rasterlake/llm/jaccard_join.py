"""Self-join of texts by the Jaccard similarity of their word n-grams, with Bayesian candidate pruning.

Words are the lower-case runs between white space; a text is the set of its hashed runs of ``WORDS`` words (all its words
as one run, if it has fewer). Texts of equal word sequence are one class of copies and join once. The others get ``BANDS
* ROWS`` MinHash values; at the threshold a pair is missed by all bands with probability ``(1 - 0.8**5)**30 < 1e-5``.
Texts that share a band are linked to the band's first text only, so candidates grow linearly; connected candidates form
a component, and every pair that could share a band lies in one. A component is cut into blocks of about ``BLOCK`` texts
by hash, and each pair of blocks is one small group of rows, however large the component. In a group MinHash values are
compared ``STEP`` at a time and a pair is dropped once the posterior probability (uniform prior) of reaching the threshold
is below ``TOLERANCE``; the rest is verified exactly on the sets. A group returns counts and the roots of its connected
rows, never pairs.

Defined cases: null, empty and blank texts have no n-grams, are copies of one another and have no links; repeated rows
are copies; the class id is the smallest id in the class (null only if all are); an empty table gives an empty result;
further columns are not looked at and come back unchanged from ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.bitmap import only_rows, without_rows
from rasterlake.llm.rows import numbered, unpack
from rasterlake.operators.graphs import components
from rasterlake.session import cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
STEP = 15
TOLERANCE = 1e-6
BLOCK = 128
TEXTS_CHARS = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_MUL = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = _mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each lower-case UTF-8 text, all texts at once."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(begins):
        return [np.empty(0, np.uint64) for _ in texts]
    at = np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.r_[begins, len(data)]))
    powers = _powers(int(at.max()) + 1)
    body = data[begins[0] :].astype(np.uint64) + np.uint64(1)
    body *= inside[begins[0] :]
    word = _mix(np.add.reduceat(body * powers[at], begins - begins[0]))
    first = np.searchsorted(begins, np.r_[0, ends[:-1]])
    last = np.r_[first[1:], len(begins)]
    weight = _powers(words + 1)[1:]
    runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        runs += word[k : k + len(runs)] * weight[k]
    runs = _mix(runs)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(_mix(np.add.reduce(word[a:b] * weight[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(runs[:0])
    return out


def signature(x: np.ndarray) -> bytes:
    """MinHash values of a set, 32 bits each."""
    low = np.full(len(_MUL), np.uint64(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(low, ((x[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1), out=low)
    return low.astype("<u4").tobytes()


def _blocks(keys: pa.Array, column: pa.Array):
    """(keys, lower-case texts) of bounded size."""
    held, ids, size = [], [], 0
    for i in range(len(column)):
        t = (column[i].as_py() or "").lower().encode("utf-8", "surrogatepass")
        held.append(t)
        ids.append(keys[i].as_py())
        size += len(t)
        if size >= TEXTS_CHARS:
            yield ids, held
            held, ids, size = [], [], 0
    if ids:
        yield ids, held


def _sign(batches):
    for batch in batches:
        for ids, texts in _blocks(batch.column(0), batch.column(1)):
            copies = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
            signs = [signature(x) if len(x) else None for x in shingles(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(signs, pa.binary())], ["row", "copy", "sign"])


def _sets(batches):
    for batch in batches:
        for ids, texts in _blocks(batch.column(0), batch.column(1)):
            sets = [x.tobytes() for x in shingles(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["row", "grams"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped)."""
    out = []
    for h in range(STEP, BANDS * ROWS + 1, STEP):
        # posterior Beta(m + 1, h - m + 1) above t is the chance of at most m successes in h + 1 trials of t
        below, m = 0.0, 0
        while m <= h:
            below += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((h, m))
    return out


def similar(signs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Pairs (i, j), i in left and j in right, i != j, that reach the threshold."""
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if left is right:
        i, j = i[i < j], j[i < j]
    matches = np.zeros(len(i), np.int16)
    for h, least in least_matches(threshold):
        matches += (signs[i, h - STEP : h] == signs[j, h - STEP : h]).sum(axis=1, dtype=np.int16)
        good = matches >= least
        i, j, matches = i[good], j[good], matches[good]
        if not len(i):
            break
    if not len(i):
        return np.empty((0, 2), np.int64)
    size = np.array([len(s) for s in sets])
    if len(i) < 200:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
    else:  # presence matrices, a slice of the n-grams at a time
        used = np.unique(np.r_[i, j])
        grams, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size[used])
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        both = np.zeros((len(used), len(used)), np.float32)
        for start in range(0, len(grams), 8192):
            a, b = np.searchsorted(column, [start, start + 8192])
            x = np.zeros((len(used), 8192), np.float32)
            x[row[a:b], column[a:b] - start] = 1
            both += x @ x.T
        common = both[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    found = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return np.stack([i[found], j[found]], axis=1)


def _verify(table: pa.Table) -> pa.Table:
    """Links and local roots of one pair of blocks."""
    rows = table["row"].to_numpy()
    part = table["part"].to_numpy()
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    signs = np.stack([np.frombuffer(s.as_py(), "<u4") for s in table["sign"]])
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["grams"]]
    left = np.flatnonzero(part == a)
    pairs = similar(signs, sets, left, left if a == b else np.flatnonzero(part == b))
    links = np.bincount(pairs.ravel(), minlength=len(rows))
    root = rows.copy()
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        if (before == root).all():
            break
    hit = links > 0
    return pa.table({"row": pa.array(rows[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(root[hit])})


def _classes(base: DataFrame) -> DataFrame:
    """(row, class_row, class_id, class_size, links) of (row, doc_id, text)."""
    signed = cut(base.select("row", "text").mapInArrow(_sign, "row long, copy binary, sign binary"))
    first = signed.groupBy("copy").agg(F.min("row").alias("first"))
    copies = cut(signed.select("row", "copy").join(first, "copy").select("row", "first"))
    texts = cut(signed.filter("sign is not null").join(first.select(F.col("first").alias("row")), "row", "left_semi").select("row", "sign"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sign", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])
    bands = texts.select("row", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub")
    stars = bands.join(shared, "band").filter("row <> hub").select(F.col("row").alias("src"), F.col("hub").alias("dst")).distinct()
    found = components(stars, []).select(F.col("id").alias("row"), F.col("root").alias("part_of"))
    members = cut(found.unionByName(found.select(F.col("part_of").alias("row"), "part_of").distinct()))
    sizes = members.groupBy("part_of").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    parted = members.join(sizes, "part_of").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    parted = cut(parted.join(texts, "row"))
    sets = only_rows(base.select("row", "text"), parted.select("row")).mapInArrow(_sets, "row long, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = parted.join(sets, "row").select("row", "part_of", "part", "sign", "grams", other)
    pairs = pairs.select("row", "part_of", "part", "sign", "grams", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    verified = cut(pairs.groupBy("part_of", "a", "b").applyInArrow(_verify, "row long, links long, root long"))
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    near = components(verified.filter("row <> root").select(F.col("row").alias("src"), F.col("root").alias("dst")), [])
    joined = copies.join(near.select(F.col("id").alias("first"), F.col("root")), "first", "left")
    joined = joined.join(links.withColumnRenamed("row", "first"), "first", "left")
    out = cut(
        joined.select("row", F.coalesce("root", "first").alias("class_row"), F.coalesce("links", F.lit(0)).alias("links"))
        .join(base.select("row", "doc_id"), "row")
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = cut(out.groupBy("class_row").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size")))  # so that the join may split a hot class
    return out.join(groups, "class_row").select(
        "row", "doc_id", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("keep_row"), "class_size", "links"
    )


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, links (other texts within the threshold)."""
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return _classes(base.select("row", "doc.doc_id", "doc.text")).select("doc_id", "class_id", "class_size", "links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class (that with the smallest id), with all columns."""
    base = numbered(docs)
    rows = base.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    dropped = cut(_classes(rows).filter(F.col("row") != F.col("keep_row")).select("row"))
    return unpack(without_rows(base, dropped))
