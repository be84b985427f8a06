"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: the dense layers and the attention
within it.  A window of documents gets just as many sequences as its tokens fill.  Documents longer
than a sequence fill whole sequences first; then the rest go, in descending order, each to the
sequence of lowest cost that has room for it.  A document for which no sequence has room is cut:
the cheapest sequence with any room takes what fits and the rest goes on.  So every sequence of a
window is full.  Tokens beyond a whole number of sequences pass to the next window of the
partition; the last window closes with sequences of 1024, 512, ... tokens, whose lengths are powers
of two and need no padding.

Each partition of the input packs its own rows in windows of bounded size: no shuffle, no order
between tasks, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean
from .tokens import BLOCK, default_path, encoder

#: Cost of a token in the dense layers, and of a pair of tokens in attention, in units of 1/4096 of the former.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
WINDOW_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, size: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]], int]:
    """Packs documents of the given lengths.

    Returns pieces (document, start, length, sequence, offset), left-over (document, start) whose tokens
    go to the next window (none if ``last``), and the number of sequences.
    """
    pieces, seq = [], 0
    start = np.zeros(len(lengths), np.int64)
    for d in np.flatnonzero(lengths >= size):
        for s in range(0, int(lengths[d]) - size + 1, size):
            pieces.append((int(d), s, size, seq, 0))
            seq += 1
        start[d] = lengths[d] // size * size
    rest = lengths - start
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    total = int(rest.sum())
    room = [size] * (total // size)
    left: list[tuple[int, int]] = []
    tail = total % size
    if last:
        room += [1 << b for b in range(size.bit_length() - 1, -1, -1) if tail >> b & 1]
    room, load = np.array(room, np.int64), np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    for d in order:
        at, n = int(start[d]), int(rest[d])
        while n:
            fit = np.flatnonzero(room >= n) if len(room) else []
            if not len(fit):
                fit = np.flatnonzero(room > 0) if len(room) else []
                if not len(fit):
                    left.append((int(d), at))
                    break
            k = int(fit[load[fit].argmin()])
            take = min(n, int(room[k]))
            pieces.append((int(d), at, take, seq + k, int(used[k])))
            room[k] -= take
            used[k] += take
            load[k] += cost(take)
            at, n = at + take, n - take
    return pieces, left, seq + len(room)


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 1, window: int = WINDOW_TOKENS) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text).

    Null and empty texts are documents of the end id alone.  Rows that repeat a doc_id are packed one by
    one.  An empty table gives no rows.  ``size`` must be a power of two.
    """
    path = path or default_path()
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, made = encoder(path), TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # doc_id, ids, first of them in the document, tokens of the document
        tokens = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, made
            pieces, left, n = assign(np.array([len(h[1]) for h in held], np.int64), size, last)
            cols = [[], [], [], [], [], [], [], []]
            for d, s, k, q, o in pieces:
                doc_id, ids, first, whole = held[d]
                for c, v in zip(cols, (doc_id, first + s, k, zlib.crc32(ids[s : s + k]), whole, base + made + q, o, cost(k)), strict=True):
                    c.append(v)
            made += n
            held = [(held[d][0], held[d][1][s:].copy(), held[d][2] + s, held[d][3]) for d, s in left]
            tokens = sum(len(h[1]) for h in held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.float64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

        for b in blocks(batches, most=BLOCK, rows=4096):
            ids, bounds = enc.encode(b.column(1).to_pylist(), end_id)
            ids = ids.astype("<u4")
            for doc_id, i, j in zip(b.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                held.append((doc_id, ids[i:j], 0, int(j - i)))
                tokens += int(j - i)
            if tokens >= window:
                yield emit(False)
        if held:
            yield emit(True)
        enc.rest()

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
