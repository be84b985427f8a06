"""Exact top-k search with vector-approximation files.

Vectors become integers, floor(256 * x).  A data chunk keeps, beside its exact vectors, an
approximation: for each component one of ``CELLS`` equal cells between the chunk's extremes.  Cell
bounds give an upper bound of every inner product with a query; exact vectors are then read in the
order of falling bounds until k of them score above the next bound (equal ones are read, since ties
go to the smaller id).

The queries are written as one small table to the shared folder; every task over the data reads them
block by block.  So the data are scanned in place: nothing but each task's best k rows for a query is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean

CELLS, CHUNK, QUERIES = 64, 8192, 256
RESULT = "query_id long, vec_id long, score long"


def integers(x: Column) -> Column:
    """floor(256 * x) of every component, as array<bigint>."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))


def usable(x: Column) -> Column:
    """Neither null nor empty nor holding null or non-finite components."""
    return F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


class Approximation:
    """The cells of a chunk of integer vectors and their bounds."""

    def __init__(self, v: np.ndarray):
        self.low = v.min(0).astype(float)
        self.width = np.maximum(1.0, (v.max(0) - self.low + 1) / CELLS)
        self.cells = np.minimum(CELLS - 1, (v - self.low) // self.width).astype(np.uint8)

    def upper(self, q: np.ndarray) -> np.ndarray:
        """(queries, vectors): no inner product passes its bound."""
        lo = self.low + self.cells * self.width
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = up @ (lo + self.width).T + down @ lo.T
        return bound + 1e-9 * np.abs(bound) + 1e-6


def best(v: np.ndarray, ids: np.ndarray, approx: Approximation, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, scores): the k best of the chunk for each query, the query's own id apart."""
    exact = v.astype(float) if len(v) and np.abs(v).max() * float(max(1, np.abs(q).max(initial=0))) * v.shape[1] < 2**53 else v
    bound = approx.upper(q.astype(float))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        b = bound[i]
        b[ids == q_ids[i]] = -np.inf
        got_s, got_i, read, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while True:
            part = np.argpartition(-b, min(len(b) - 1, read + step))[: read + step] if read + step < len(b) else np.arange(len(b))
            order = part[np.argsort(-b[part], kind="stable")]
            new = order[np.isfinite(b[order])]
            got_s, got_i = (exact[new] @ q[i].astype(exact.dtype)).astype(np.int64), ids[new]
            top = np.lexsort((got_i, -got_s))[:k]
            got_s, got_i = got_s[top], got_i[top]
            read = len(order)
            if read == len(b) or (len(got_s) == k and b[order[-1]] < got_s[-1]):
                break
            step = read * 3
        out.append((np.full(len(got_s), q_ids[i]), got_i, got_s))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) for each dimension in the batch."""
    ids, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    dims = np.diff(col.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), ids[at], flat[starts[at][:, None] + np.arange(d)]


def search(vectors: DataFrame, is_query: Column, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` (vec_id, embedding) for each query row.

    Rows with a null id, and vectors that ``usable`` refuses, take no part; vectors of another dimension than a
    query's are no candidates.  A query id that repeats is one query (its smallest vector); candidates that
    repeat an id all count, except those with the query's.  No queries or candidates give no rows.
    """
    from .token_output import _fs

    v = lean(vectors).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    q = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    scratch.save(q, "queries")
    folder = scratch.path("queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, base = _fs(folder)
        from pyarrow import fs

        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))

        def answer(d: int, ids: np.ndarray, vs: np.ndarray) -> Iterator[pa.RecordBatch]:
            approx = Approximation(vs)
            for name in files:
                for b in pq.ParquetFile(store.open_input_file(name)).iter_batches(QUERIES, columns=["vec_id", "v"]):
                    for dim, q_ids, qs in _arrays(b):
                        if dim == d:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(vs, ids, approx, qs, q_ids, k)], ["query_id", "vec_id", "score"])

        held: dict[int, list] = {}
        for batch in batches:
            for d, ids, vs in _arrays(batch):
                own = held.setdefault(d, [])
                own.append((ids, vs))
                if sum(len(x[0]) for x in own) >= CHUNK:
                    yield from answer(d, np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]))
                    held[d] = []
        for d, own in held.items():
            if own:
                yield from answer(d, np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]))

    found = v.mapInArrow(run, RESULT)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
