"""Shared plumbing: reading tables, scratch tables, hash splits and bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs without the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A whole input table; only ``cols`` are read, so clashing extra columns never matter."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them for as long as one of ``columns`` has that name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own if it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        spark.sparkContext.setCheckpointDir(_OWN[0])
    return _OWN[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    ``drop`` removes tables that nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_seen(self, df: DataFrame, name: str, *seen: Column) -> tuple[DataFrame, tuple]:
        """Also the values of aggregates over the rows, found as they are written."""
        o = Observation()
        out = self.save(df.observe(o, *[c.alias(f"s{k}") for k, c in enumerate(seen)]), name)
        return out, tuple(o.get[f"s{k}"] for k in range(len(seen)))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone when the driver ends
            pass


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the remainder is ``rest``; a null id has none, so it is false (and is never learned from)."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


def hot_keys(sizes: DataFrame, keys: list[str], least: int = 1000) -> list[Row]:
    """The keys that hold more than a thousandth of all rows, and more than ``least``: a thousand keys at most, whatever the input.

    ``sizes`` has a row for each key, with the number ``n`` of its rows.
    """
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    bound = max(least, (total or 0) // 1000)
    return sizes.where(F.col("n") > bound).select(*keys).collect() if most and most > bound else []


def meet(many: DataFrame, one: DataFrame, keys: list[str], hot: list[Row], by: list[str], on: list[str] | None = None, how: str = "inner", salts: int = 32) -> DataFrame:
    """``many.join(one, keys, how)``, where ``one`` has one row for each key and the rows of hot keys are dealt over ``salts`` tasks.

    A row's salt is the hash of its columns ``by``; the rows of ``one`` with a hot key are repeated for each salt.
    ``hot`` comes from ``hot_keys`` over the columns ``on`` (all keys, unless given), so it may be broadcast.
    """
    if not hot:
        return many.join(one, keys, how)
    on = on or keys
    mark, salt = free_names([*many.columns, *one.columns], "hot", "salt")
    known = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(*on).schema).withColumn(mark, F.lit(True)))
    a = many.join(known, on, "left").withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop(mark)
    b = one.join(known, on, "left").withColumn(salt, F.explode(F.when(F.col(mark), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(mark)
    return a.join(b, [*keys, salt], how).drop(salt)


def bounded_sample(rows: DataFrame, key: str, cls: str, per_class: int, seed: int = 7) -> DataFrame:
    """About ``per_class`` rows of each class, chosen by a hash of the key.

    ``rows`` holds distinct keys and few classes (labels, languages); only the class counts reach the driver.
    """
    n = {r[cls]: r["n"] for r in rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, count in n.items():
        keep = keep | ((F.col(cls) == F.lit(value)) & (unit < min(1.0, per_class / count)))
    return rows.where(keep)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y) for a bounded sample of labelled rows; ``learn`` is a condition on ``doc_id``.

    The sample holds about 2 * per_class ids whatever the input's size, so it is broadcast to the scan of texts.
    Repeated label rows count once (the smallest label); repeated documents give one text.
    """
    lab = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"))
    ids = bounded_sample(lab, "doc_id", "y", per_class)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def lean(df: DataFrame) -> DataFrame:
    """``df``, with the batches that its session passes to Python bounded: they hold whole texts or vectors, in both processes.

    The settings are read when the plan runs, so they stay; a session that asks for smaller batches keeps its own.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 4096), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        got = df.sparkSession.conf.get(key)
        if not (got and got.isdigit() and 0 < int(got) <= value):
            df.sparkSession.conf.set(key, str(value))
    return df


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its memory is not given back early
        return None


def trim() -> None:
    """Gives memory that this worker no longer uses back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and about ``most`` bytes of the column, one row at least: work space stays bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, at = len(col), 0
        if not n:
            continue
        # string offsets are 32 bit, large strings 64 bit
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        while at < n:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        trim()


def raw(col: pa.Array):
    """(bytes of all values as uint8, offsets as int64) of a string column without copying; nulls are empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return b, ends - ends[0]
