"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each of ``FILTERS``
filters of ``WIDTH`` bytes is a table of weights by place and byte, so its response at a position is
the sum of WIDTH look-ups; a chunk keeps each filter's largest response (max-pooling), squashed by
tanh.  The mean and the maximum over all chunks, and the logarithm of the length, go through one
logistic unit.  Training is Adam on the logistic loss; through max-pooling, a filter learns at the
place of its largest response.

Training reads about ``SAMPLE`` rows of each label; training and scoring alike read every chunk of a text.
The sample lies in the shared folder, in an order by hash, and the driver reads it in windows of about
``WINDOW`` bytes, so its memory is bounded whatever the texts' lengths.  Null and empty texts have no
chunk: their pooled values are 0 and the rest of the network scores them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, labelled_texts, lean, raw

FILTERS, WIDTH, CHUNK, OVERLAP = 8, 5, 512, 16
#: Rows of each label in the training sample, and bytes of it that are in memory at once (one text at least).
SAMPLE, WINDOW = 1500, 32 << 20
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.03, 11


def chunks(length: int) -> np.ndarray:
    """(start, end) of the chunks of a text; consecutive ones share OVERLAP bytes, so no filter window is missed."""
    starts = np.arange(0, max(1, length - OVERLAP), CHUNK - OVERLAP) if length else np.zeros(0, np.int64)
    return np.stack([starts, np.minimum(starts + CHUNK, length)], 1)


def responses(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Every filter at every position of ``b``; windows that pass its end read zeros there."""
    out = table[0][b]
    for j in range(1, WIDTH):
        out[: max(0, len(b) - j)] += table[j][b[j:]]
    return out


def pieces(b: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, responses) of a text by pieces of 256 whole chunks; windows read on past a piece's end."""
    at = 0
    while at < len(b):
        to = min(len(b), at + 256 * (CHUNK - OVERLAP) + OVERLAP)
        yield at, responses(b[at : to + WIDTH - 1], table)[: to - at]
        if to == len(b):
            return
        at = to - OVERLAP


class Net:
    def __init__(self, table: np.ndarray, out: np.ndarray):
        self.table, self.out = table, out  # (WIDTH, 256, FILTERS), (2 * FILTERS + 2)

    def pooled(self, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, max) over the chunks of each text of the buffer, one row a text."""
        n = len(ends) - 1
        mean, most = np.zeros((n, FILTERS)), np.zeros((n, FILTERS))
        for i in range(n):
            m, count = np.zeros(FILTERS), 0
            top = np.full(FILTERS, -1.0)
            for _, r in pieces(b[ends[i] : ends[i + 1]], self.table):
                starts = chunks(len(r))[:, 0]
                # chunk k is the run from its start to the next one's, and the first OVERLAP bytes of the next
                run = np.maximum.reduceat(r, starts, axis=0)
                for k, s in enumerate(starts[1:]):
                    run[k] = np.maximum(run[k], r[s : s + OVERLAP].max(0))
                z = np.tanh(run)
                m += z.sum(0)
                top = np.maximum(top, z.max(0))
                count += len(z)
            if count:
                mean[i], most[i] = m / count, top
        return mean, most

    def peaks(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(response, place) of each filter's largest response in each chunk of a text."""
        z, where = [], []
        for at, r in pieces(b, self.table):
            n = len(chunks(len(r)))
            whole = np.full(((n - 1) * (CHUNK - OVERLAP) + CHUNK, FILTERS), -np.inf, np.float32)
            whole[: len(r)] = r
            step = whole.strides[0]
            view = np.lib.stride_tricks.as_strided(whole, (n, CHUNK, FILTERS), ((CHUNK - OVERLAP) * step, step, whole.strides[1]))
            w = view.argmax(1)
            z.append(np.take_along_axis(view, w[:, None], 1)[:, 0])
            where.append(at + np.arange(n)[:, None] * (CHUNK - OVERLAP) + w)
        return (np.tanh(np.concatenate(z)), np.concatenate(where)) if z else (np.zeros((0, FILTERS)), np.zeros((0, FILTERS), int))

    def score(self, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        mean, most = self.pooled(b, ends)
        x = np.concatenate([mean, most, np.log1p(np.diff(ends))[:, None] / 10, np.ones((len(mean), 1))], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30)))


def train(windows: Callable[[], Iterator[tuple[list[bytes], np.ndarray]]]) -> Net:
    """Fits the network to (texts, labels), which every call of ``windows`` gives again; with one label only, it is near that label for all, without rows 0.5."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
    out = np.concatenate([rng.normal(0, 0.5, 2 * FILTERS), [0.0, 0.0]])
    net = Net(table, out)
    n = ones = 0
    for _, y in windows():
        n, ones = n + len(y), ones + int(y.sum())
    if ones in (0, n):
        return Net(np.zeros_like(table), np.concatenate([np.zeros(2 * FILTERS + 1), [(5.0 if ones else -5.0) if n else 0.0]]))
    weight = (0.5 * n / (n - ones), 0.5 * n / ones)
    mom = [np.zeros_like(table), np.zeros_like(table), np.zeros_like(out), np.zeros_like(out)]
    filters = np.arange(FILTERS)
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / EPOCHS))
        for texts, y in windows():
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                g_table, g_out = np.zeros_like(table), np.zeros_like(out)
                for d in order[at : at + BATCH]:
                    b = np.frombuffer(texts[d], np.uint8)
                    z, where = net.peaks(b)
                    if len(z):
                        mean, top = z.mean(0), z.argmax(0)
                        most = z[top, filters]
                    else:
                        mean = most = np.zeros(FILTERS)
                    x = np.concatenate([mean, most, [np.log1p(len(b)) / 10, 1.0]])
                    p = 1 / (1 + math.exp(-max(-30, min(30, float(x @ out)))))
                    e = weight[int(y[d])] * (p - y[d])
                    g_out += e * x
                    if len(z):
                        g = np.tile(e * out[:FILTERS] / len(z), (len(z), 1))
                        g[top, filters] += e * out[FILTERS : 2 * FILTERS]
                        g *= 1 - z * z
                        f = np.broadcast_to(filters, where.shape)
                        for j in range(WIDTH):
                            ok = where + j < len(b)
                            g_table[j] += np.bincount(b[(where + j)[ok]].astype(int) * FILTERS + f[ok], g[ok], 256 * FILTERS).reshape(256, FILTERS)
                step += 1
                for p, g, m, v in ((table, g_table / BATCH, mom[0], mom[1]), (out, g_out / BATCH + 1e-4 * out, mom[2], mom[3])):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    v += 0.01 * g * g
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def from_files(folder: str, most: int = WINDOW) -> Callable[[], Iterator[tuple[list[bytes], np.ndarray]]]:
    """Windows over the Parquet files of (text, y) in a shared folder; a sample that fits one window is read once."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    from .token_output import _fs

    store, base = _fs(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
    kept: list = []

    def read() -> Iterator[tuple[list[bytes], np.ndarray]]:
        texts, y, size = [], [], 0
        for name in names:
            with store.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(32, columns=["text", "y"]):
                    for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        texts.append(t.encode())
                        y.append(k)
                        size += len(texts[-1])
                    if size >= most:
                        yield texts, np.array(y, float)
                        texts, y, size = [], [], 0
        if texts:
            yield texts, np.array(y, float)

    def windows() -> Iterator[tuple[list[bytes], np.ndarray]]:
        if kept:
            yield from kept
            return
        first, count = None, 0
        for w in read():
            count += 1
            first = w if count == 1 else None
            yield w
        if count == 1:
            kept.append(first)

    return windows


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> Net:
    """Learns quality from the labelled rows of ``docs`` (doc_id, text) for which ``learn``, a condition on doc_id, holds.

    Labels but 0 and 1 and null ids are not learned from; a repeated label row counts once (the smallest label), a
    repeated document gives one text (the smallest).  Null texts are empty.  With one label only, the network is a
    constant near it; without rows, 0.5.  Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample = labelled_texts(lean(docs), labels, "quality", learn, per_class)
    mixed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(31))
    scratch.save(sample.orderBy(mixed, "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("int")), "sample")
    net = train(from_files(scratch.path("sample")))
    scratch.drop("sample")
    return net


def score(docs: DataFrame, net: Net, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``, the probability of label 1 for every whole text; no shuffle.

    Rows are scored one by one: equal texts get equal scores, null and empty ones that of no chunk; an empty
    table gives no rows.  Other columns are kept; one named ``into`` is replaced.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(into)
    at = docs.columns.index(text)
    table, out = net.table, net.out
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(table, out)
        for s in blocks(batches, text):
            b, ends = raw(s.column(at))
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(own.score(b, ends))], [*s.schema.names, into])

    return lean(docs).mapInArrow(run, schema)
