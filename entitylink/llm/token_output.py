"""Token-ID binary output: flat unsigned integer shard files plus 64-bit document offsets.

Layout under one folder of the shared file system, for shard number S (a range of doc_id):

* ``S.u16`` or ``S.u32``: the ids of its documents one after another, little-endian unsigned, of 16 bits
  where the vocabulary and the end id fit, else of 32;
* ``S.off``: n + 1 little-endian signed 64-bit offsets, in ids from the shard's start.

Documents stand in ascending doc_id order within and across shards, so the corpus is the shards'
concatenation; a shard's base is the prefix sum of the ids of the shards before it.  A task writes
to a name of its own and renames it when whole, so a task that runs again replaces equal files.
Any file system that pyarrow knows by URI will do; shards of a local or mounted one are memory-mapped.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, lean
from .tokens import BLOCK, default_path, encoder

MANIFEST = "shard int, n_docs long, n_tokens long, bits int, doc_ids binary"


def _fs(folder: str):
    from pyarrow import fs

    url = urlparse(folder)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, chunks) -> None:
    store, base = _fs(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    store.move(own, f"{base}/{name}")


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped where the file system is local or mounted, read otherwise."""
    store, base = _fs(folder)
    if type(store).__name__ == "LocalFileSystem":
        import os

        path = f"{base}/{name}"
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Writes the shards of ``docs`` (doc_id, text; null text: no ids but the end id) and returns their manifest.

    Rows are range-partitioned by doc_id before they are tokenised, so each text is encoded once.  Rows
    that repeat a doc_id stand next to each other, ordered by text.  The manifest has a row for each
    shard: its number, documents, ids, and its doc_ids as 64-bit integers (nulls, first in order, are -2^63).
    """
    path = path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lens, names = TaskContext.get().partitionId(), [], []
        enc = encoder(path)
        bits = 16 if max(len(enc.n_bytes), (end_id or 0) + 1) <= 1 << 16 else 32

        def ids():
            for b in blocks(batches, most=BLOCK, rows=4096):
                got, bounds = enc.encode(b.column(1).to_pylist(), end_id)
                lens.append(np.diff(bounds))
                names.append(b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8"))
                yield got.astype(f"<u{bits // 8}").tobytes()

        _put(folder, f"{shard:06d}.u{bits}", ids())
        n = np.concatenate([np.zeros(1, np.int64), *lens])
        _put(folder, f"{shard:06d}.off", [np.cumsum(n).astype("<i8").tobytes()])
        row = {"shard": [shard], "n_docs": [len(n) - 1], "n_tokens": [int(n.sum())], "bits": [bits], "doc_ids": [np.concatenate([np.zeros(0, "<i8"), *names]).tobytes()]}
        enc.rest()
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.binary())]))

    text = lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    return text.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(write, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base``, the ids of all earlier shards; the window sees one slim row for each shard file."""
    slim = manifest.select("shard", "n_tokens")
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.join(slim.select("shard", base.cast("long").alias("base")), "shard")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document, from the mapped files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, off = _get(folder, f"{r['shard']:06d}.u{r['bits']}", f"<u{r['bits'] // 8}"), _get(folder, f"{r['shard']:06d}.off", "<i8")
                names = np.frombuffer(r["doc_ids"], "<i8")
                for at in range(0, len(names), 10_000):
                    o = np.asarray(off[at : at + 10_001])
                    k = len(o) - 1
                    crc = np.fromiter((zlib.crc32(ids[o[i] : o[i + 1]].astype("<u4")) for i in range(k)), np.int64, k)
                    name = names[at : at + k]
                    yield pa.RecordBatch.from_arrays([pa.array(name, mask=name == -(1 << 63)), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "bits", "doc_ids", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
