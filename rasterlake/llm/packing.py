"""Cost-balanced packing of token sequences.

Texts become token ids by a public tokenizer. Every task cuts its rows into cells of at most ``CELL_TOKENS`` ids (a
longer document forms a cell of its own) and packs each cell alone, so no shuffle is needed and memory is bounded by
one cell. In a cell, pieces are assigned in order of falling cost, ``tokens + tokens**2 / max_tokens`` (linear layers
plus attention), to the sequence with the lowest cost that still has room for the whole piece. A piece that fits
nowhere is cut, and its parts fill the sequences with most room. A cell opens only as many sequences as its ids need,
so at most one sequence of padding is lost per cell.

Defined cases: a null text is an empty one and has only the end id; repeated rows are packed once each; extra columns
are ignored by ``pack`` (only the id and the text are read). The cut into cells follows the input partitions, so the
same files and settings give the same sequences.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm.word_ids import word_ids
from rasterlake.session import small_batches

MAX_TOKENS = 4096
END_ID = 2
CELL_TOKENS = 1 << 20
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of every piece of one cell.

    Documents above the capacity are first cut into whole sequences and a rest.
    """
    pieces, out, full = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        for s in range(0, whole, capacity):
            out.append((d, s, capacity, full))
            full += 1
        if n > whole:
            pieces.append((n - whole, d, whole))
    bins = -(-sum(p[0] for p in pieces) // capacity)
    room = np.full(bins, capacity)
    cost = np.zeros(bins)
    left: list[tuple[int, int, int]] = []
    for n, d, s in sorted(pieces, key=lambda p: (-p[0], p[1])):
        fits = np.where(room >= n, cost, np.inf)  # a cell has few sequences: all are looked at
        b = int(fits.argmin())
        if fits[b] == np.inf:
            left.append((n, d, s))
            continue
        out.append((d, s, n, full + b))
        room[b] -= n
        cost[b] += n + n * n / capacity
    rest = sorted(((r, b) for b, r in enumerate(room.tolist()) if r), reverse=True)
    at = 0
    for n, d, s in left:
        while n:
            r, b = rest[at]
            take = min(n, r)
            out.append((d, s, take, full + b))
            n, s, r = n - take, s + take, r - take
            rest[at] = (r, b)
            at += r == 0
    return out


def _packer(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        words = word_ids(vocabulary)
        base, used = TaskContext.get().partitionId() << 33, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        total = 0

        def flush():
            nonlocal used
            placed = assign([len(x) for x in ids], capacity)
            fill: dict[int, int] = {}
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for d, start, n, seq in sorted(placed, key=lambda p: (p[3], p[0], p[1])):
                at = fill.get(seq, 0)
                fill[seq] = at + n
                row = (names[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), base + used + seq, at)
                for c, v in zip(cols, row):
                    c.append(v)
            used += len(fill)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        end = np.array([end_id], "<u4")
        def texts():
            for batch in batches:
                docs, column = batch.column(0), batch.column(1)
                for i in range(batch.num_rows):
                    pending.append(docs[i].as_py())
                    yield column[i].as_py() or ""

        pending: deque = deque()
        for found in words.stream(texts()):
            x = np.concatenate([found, end])
            if ids and total + len(x) > CELL_TOKENS:
                yield flush()
                ids, names, total = [], [], 0
            ids.append(x)
            names.append(pending.popleft())
            total += len(x)
        if ids:
            yield flush()

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(vocabulary, max_tokens, end_id), SCHEMA)
