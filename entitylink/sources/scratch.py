"""Tables written to the shared folder: they cut plans, are read column by column and outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master only, one of our own where that is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="linkage-"))
    return _OWN[0]


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _file(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone when the driver ends
        pass


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once; what is left when the driver ends is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a table that ``kept`` wrote and that nothing reads any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, f)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    fs, p = _file(spark, path)
    return fs.getContentSummary(p).getLength()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark knows."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def join_parts(spark: SparkSession, folder: str, path: str, head: str) -> None:
    """The part files of a folder, in their order after a first line, as one file; bytes go through the file system's streams alone."""
    fs, p = _file(spark, folder)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = fs.create(_file(spark, path)[1], True)
    out.write(bytearray((head + "\n").encode("utf-8")))
    for part in sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")):
        data = fs.open(_file(spark, f"{folder}/{part}")[1])
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
        data.close()
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
