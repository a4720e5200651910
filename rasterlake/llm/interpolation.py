"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of n-grams of order 1 to ``ORDER`` and of the
uniform distribution over the vocabulary and one unknown word. The weights depend on how often the context was seen (its
count by powers of two) and are learned by expectation-maximisation: estimates from the training documents but a tenth of them are
mixed so that the tokens of that deleted tenth become likeliest. Scores then use counts of all training documents.

Documents are counted in parts: up to ``TOKENS`` tokens of rows that follow each other, apart for held-out, deleted and
other rows. A part sends each distinct n-gram once, as a 64-bit hash with its count, in one compact array per range of
hashes. A range adds the counts of all parts and answers each part with the totals of its n-grams in the same order. The
documents meet the answers by part, so that neither counts nor texts of the corpus are gathered anywhere: a task holds one
range or one part. All counting is numpy; Spark moves arrays, not n-grams.

Only the totals, and per round of the expectation-maximisation one sum per context bucket and order, come to the driver.

Defined cases: a null or empty text is the end token alone; a document without id is trained on; without training
documents every token has the probability 1 (one unknown word), without deleted ones the components weigh the same; an empty table
gives an empty result; repeated rows count again; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.session import cut, small_batches

ORDER = 2
TOKENS = 200_000
PART_BITS = 13  # rows of one part at most, as a power of two
RANGE_BYTES = 8_000_000
HELD_OUT, DELETED, KEPT = 0, 1, 2
FOLDS = 10
SMOOTHING = 0.1
BUCKETS = 48
ROUNDS = 40
SETTLED = 1e-4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64
_ODD = np.uint64(0x9E3779B97F4A7C15)
BEGIN, END = np.uint64(1), np.uint64(2)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, the end token behind them and begin marks before them."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").translate(LOWER).split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return out


def grams(docs: list[np.ndarray], order: int) -> list[np.ndarray]:
    """Keys of the n-grams of each order that end at each position; the lowest two bits tell the order."""
    line = np.concatenate(docs)
    begins = line == BEGIN
    before = line.copy()
    out, key = [], _mix(line)
    for k in range(order):
        if k:
            shifted = np.empty_like(before)  # the token one further back; before a text stand begin marks only
            shifted[0], shifted[1:] = BEGIN, before[:-1]
            shifted[begins] = BEGIN
            before = shifted
            key = _mix(key * _ODD + before)
        out.append((key & ~np.uint64(3)) | np.uint64(k))
    return out


BEGIN_KEY = grams([np.array([BEGIN])], 1)[0][0]


def distinct(keys: np.ndarray, with_places: bool = False):
    """Sorted distinct keys with their counts, or with the place of each key among them."""
    if with_places:
        order = np.argsort(keys)
        ranked = keys[order]
    else:
        ranked = np.sort(keys)
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if with_places:
        places = np.empty(len(keys), np.int64)
        places[order] = np.cumsum(new) - 1
        return ranked[new], places
    starts = np.flatnonzero(new)
    return ranked[new], np.diff(np.r_[starts, len(ranked)])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their first, then gaps in as few byte planes as the largest needs."""
    gaps = np.diff(keys, prepend=keys[:1])
    planes = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return keys[:1].tobytes() + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T[:planes]).tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, 1)
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : len(planes)] = planes.T
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + first


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte per count; counts from 255 on follow behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.uint8, offset=n).view("<i8")
    return out


PART = "part long, fold int, first long, range long, n long"
PART_FIELDS = [("part", pa.int64()), ("fold", pa.int32()), ("first", pa.int64()), ("range", pa.int64()), ("n", pa.int64())]


def _records(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _gather(order: int, limit: int, bits: int):
    fields = [*PART_FIELDS, ("keys", pa.binary()), ("counts", pa.binary())]

    def close(part, fold, held):
        first, docs = held
        keys, counts = distinct(np.concatenate(grams(docs, order)))
        edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
        bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        rows = [
            (part, fold, first, i, b - a, pack_keys(keys[a:b]), None if fold == HELD_OUT else pack_counts(counts[a:b]))
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b
        ]
        return _records(rows, fields)

    def run(batches):
        held: dict[int, tuple[int, list]] = {}
        sizes: dict[int, int] = {}
        part = last = None
        for batch in batches:
            for row, p, fold, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if p != part or row != last + 1:  # rows of a part follow each other in one file
                    for f, v in held.items():
                        yield close(part, f, v)
                    held, part = {}, p
                last = row
                if fold not in held:
                    held[fold], sizes[fold] = (row, []), 0
                doc = tokens(text.as_buffer().to_pybytes() if text.is_valid else None)
                held[fold][1].append(doc)
                sizes[fold] += len(doc)
                if sizes[fold] >= limit:
                    yield close(part, fold, held.pop(fold))
        for f, v in held.items():
            yield close(part, f, v)

    return run


ANSWER = f"{PART}, counts binary, kept binary, tokens long, known long, kept_tokens long, kept_known long"


def _add(batches):
    """Totals of a range, dealt back to the parts; and the number of tokens and of distinct tokens in the range."""
    fields = [*PART_FIELDS, ("counts", pa.binary()), ("kept", pa.binary()), *[(c, pa.int64()) for c in ("tokens", "known", "kept_tokens", "kept_known")]]

    def close(held):
        keys = [unpack_keys(r[5], r[4]) for r in held]
        learned = [(k, unpack_counts(r[6], r[4]), r[1] == DELETED) for k, r in zip(keys, held) if r[6] is not None]
        total, places = distinct(np.concatenate([k for k, _, _ in learned] or [np.empty(0, np.uint64)]), True)
        counts, deleted, at = np.zeros(len(total) + 1, np.int64), np.zeros(len(total) + 1, np.int64), 0
        for k, c, out in learned:
            here = places[at : at + len(k)]  # distinct inside a part
            counts[here] += c
            if out:
                deleted[here] += c
            at += len(k)
        kept = counts - deleted
        words = np.append((total & np.uint64(3) == 0) & (total != BEGIN_KEY), False)
        rows = [(None, None, None, held[0][3], 0, None, None, int(counts[words].sum()), int((counts[words] > 0).sum()), int(kept[words].sum()), int((kept[words] > 0).sum()))]
        for k, r in zip(keys, held):
            here = np.searchsorted(total, k)
            if r[6] is None and len(total):
                here[total[np.minimum(here, len(total) - 1)] != k] = len(total)
            rows.append((*r[:5], pack_counts(counts[here]), pack_counts(kept[here]) if r[1] == DELETED else None, 0, 0, 0, 0))
        return _records(rows, fields)

    held: list = []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][3] != r[3]:
                yield close(held)
                held = []
            held.append(r)
    if held:
        yield close(held)


def _parts(batches, column: str):
    """(document ids, token arrays, counts of the distinct keys in order) of each part of rows sorted by part."""
    ids, docs, answers, open_part = [], [], [], None
    for batch in batches:
        for part, fold, answer, n, doc_id, text, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "fold", "answer", "n", "doc_id")], batch.column("text"), batch.column(column)):
            if docs and (answer or open_part != (part, fold)):
                yield ids, docs, np.concatenate(answers)
                ids, docs, answers = [], [], []
            open_part = (part, fold)
            if answer:
                answers.append(unpack_counts(counts.as_py(), n))
            else:
                ids.append(doc_id)
                docs.append(tokens(text.as_buffer().to_pybytes() if text.is_valid else None))
    if docs:
        yield ids, docs, np.concatenate(answers)


def estimates(docs: list[np.ndarray], counts: np.ndarray, order: int, total: int):
    """Of every token of a part: its count, the context bucket, and the estimates of all orders as columns."""
    keys = grams(docs, order)
    known, places = distinct(np.concatenate(keys), True)
    if len(known) != len(counts):
        raise RuntimeError("a part has met the counts of another one")
    seen = counts[places].reshape(order, -1)
    begins = np.concatenate(docs) == BEGIN
    token = np.flatnonzero(~begins)
    share = np.empty((len(token), order))
    share[:, 0] = seen[0, token] / max(total, 1)
    bucket = np.zeros(len(token), np.int64)
    for k in range(1, order):
        context = seen[k - 1, token - 1]
        share[:, k] = seen[k, token] / np.maximum(context, 1)
        bucket = bucket * BUCKETS + np.frexp(context.astype(float))[1]
    return seen[0, token], bucket, share


def _events(order: int, total: int):
    def run(batches):
        for _, docs, counts in _parts(batches, "kept"):
            _, bucket, share = estimates(docs, counts, order, total)
            yield _records([(bucket.astype("<i4").tobytes(), share.astype("<f4").tobytes())], [("bucket", pa.binary()), ("share", pa.binary())])

    return run


def _expect(weights: np.ndarray, uniform: float):
    """Sums of the shares that each component has in the deleted tokens, by context bucket."""

    def run(batches):
        total = np.zeros_like(weights)
        for batch in batches:
            for b, f in zip(batch.column(0), batch.column(1)):
                bucket = np.frombuffer(b.as_buffer(), "<i4")
                share = np.frombuffer(f.as_buffer(), "<f4").reshape(len(bucket), -1)
                parts = weights[bucket]
                parts[:, 0] *= uniform
                parts[:, 1:] *= share
                parts /= parts.sum(axis=1, keepdims=True)
                for k in range(parts.shape[1]):
                    total[:, k] += np.bincount(bucket, parts[:, k], len(total))
        used = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["bucket", "sums"])

    return run


def normalised(sums: np.ndarray, total: int) -> np.ndarray:
    """Weights of each bucket (uniform first): one expected token is added to every component, and a component whose
    context was never seen has none."""
    buckets, components = sums.shape
    usable = np.ones_like(sums, bool)
    usable[:, 1] = total > 0
    digit = np.arange(buckets)
    for k in range(components - 1, 1, -1):
        usable[:, k] = digit % BUCKETS > 0
        digit = digit // BUCKETS
    used = np.flatnonzero(sums.sum(axis=1) > 0)
    if len(used):  # a bucket without deleted tokens takes the weights of the next one
        at = np.searchsorted(used, np.arange(buckets)).clip(1, max(1, len(used) - 1))
        low, high = used[at - 1], used[np.minimum(at, len(used) - 1)]
        sums = sums[np.where(np.arange(buckets) - low <= high - np.arange(buckets), low, high)]
    out = (sums + 1.0) * usable
    return out / out.sum(axis=1, keepdims=True)


def learn(events: DataFrame, order: int, total: int, known: int) -> np.ndarray:
    """Mixture weights by expectation-maximisation on the deleted tokens."""
    weights = normalised(np.zeros((BUCKETS ** (order - 1), order + 1)), total)
    for _ in range(ROUNDS):
        found = events.mapInArrow(_expect(weights, 1 / (known + 1)), "bucket long, sums array<double>")
        added = found.groupBy("bucket").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(order + 1)]).collect()  # one row per bucket
        sums = np.zeros_like(weights)
        for r in added:
            sums[r[0]] = r[1:]
        after = normalised(sums, total)
        change = float(np.abs(after - weights).max())
        weights = after
        if change < SETTLED:
            break
    return weights


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, total: int, known: int, weights: np.ndarray):
    uniform = 1 / (known + 1)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches):
        for ids, docs, counts in _parts(batches, "counts"):
            seen, bucket, share = estimates(docs, counts, order, total)
            mixed = weights[bucket, 0] * uniform
            for k in range(order):
                mixed += weights[bucket, k + 1] * share[:, k]
            base = np.log10((seen + SMOOTHING) / (total + SMOOTHING * (known + 1)))
            sizes = np.array([len(d) - 1 for d in docs])  # the begin mark is no token
            starts = np.cumsum(sizes) - sizes
            columns = [np.array(sizes), np.add.reduceat((seen > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(mixed), starts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, (_, t) in zip(columns, fields[1:])]], [n for n, _ in fields])

    return run


def fold(id_col) -> F.Column:
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(F.when(rest == 0, HELD_OUT).when(rest == 1, DELETED), F.lit(KEPT))


def _by_part(rows: DataFrame, answers: DataFrame, counts: str) -> DataFrame:
    """Documents behind the answers to their part, in the order of the part's rows."""
    nothing = F.lit(None)
    docs = rows.select("part", "fold", F.col("row").alias("first"), F.lit(False).alias("answer"), nothing.cast("long").alias("range"), nothing.cast("long").alias("n"), "doc_id", "text", nothing.cast("binary").alias(counts))
    told = answers.select("part", "fold", "first", F.lit(True).alias("answer"), "range", "n", nothing.cast("long").alias("doc_id"), nothing.cast("string").alias("text"), counts)
    both = docs.unionByName(told).repartition("part", "fold")
    return both.sortWithinPartitions("part", "fold", "first", F.col("answer").desc(), "range")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, limit: int = TOKENS, part_bits: int = PART_BITS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 1 <= order <= 4:
        raise ValueError("orders 1 to 4 are told apart in the keys")
    small_batches(docs.sparkSession)
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(named.withColumn("part", F.shiftright("row", part_bits)).withColumn("fold", fold("doc_id").cast("int")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // RANGE_BYTES).bit_length())
    sent = rows.select("row", "part", "fold", "text").mapInArrow(_gather(order, limit, bits), f"{PART}, keys binary, counts binary")
    ranged = sent.repartition("range").sortWithinPartitions("range")
    answers = cut(ranged.mapInArrow(_add, ANSWER))
    total, known, kept_total, kept_known = [v or 0 for v in answers.agg(*[F.sum(c) for c in ("tokens", "known", "kept_tokens", "kept_known")]).first()]
    told = answers.filter("part is not null")
    deleted = _by_part(rows.filter(F.col("fold") == DELETED), told.filter(F.col("fold") == DELETED), "kept")
    events = cut(deleted.mapInArrow(_events(order, kept_total), "bucket binary, share binary"))
    weights = learn(events, order, kept_total, kept_known)
    if not total:
        weights = normalised(np.zeros_like(weights), 0)
    scored = _by_part(rows, told, "counts").mapInArrow(_score(order, total, known, weights), RESULT)
    held = (fold("doc_id") == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
