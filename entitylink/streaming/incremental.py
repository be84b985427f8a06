"""New S1 records matched as they arrive: an extension, the batch operators over each micro-batch.

The targets' postings and buckets are written once; every micro-batch joins those tables, and a stream that
starts again finds them.  Results are written under the batch's number, so a batch that runs again after a
failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import Rules, buckets, candidates, postings
from ..operators.normalize import normalize
from ..sources.scratch import exists


def build_index(targets: DataFrame, folder: str, cap: int = 500, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(postings, buckets) of the targets under ``folder``; what is there already is read."""
    spark = targets.sparkSession
    for name, make in (("postings", lambda: postings(normalize(targets), rules)), ("buckets", lambda: buckets(spark.read.parquet(f"{folder}/postings"), cap))):
        if not exists(spark, f"{folder}/{name}/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/buckets")


def match_stream(incoming: DataFrame, targets: DataFrame, path: str, checkpoint: str, cap: int = 500, rules: Rules = Rules(), then: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, index: str | None = None) -> StreamingQuery:
    """Candidates of streamed records (source, entity_id, business_name, business_address, country) to Parquet under ``path``.

    The index lies in the folder ``index``, beside ``path`` unless given.
    """
    built = build_index(targets, index or f"{path}-index", cap, rules)

    def batch(df: DataFrame, number: int) -> None:
        pairs = candidates(normalize(df), None, cap, rules, built)
        (then(pairs) if then else pairs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
