"""Profiles of sources and of the ground truth, each in one aggregate or two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_profile(records: DataFrame) -> DataFrame:
    """One row: rows, empty and missing fields, distinct ids, lengths and token counts (mean, population deviation, extremes; to 4 places)."""
    cols = ["entity_id", "business_name", "business_address", "country"]
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("distinct_ids")]
    for c in cols:
        aggs += [n(F.col(c).isNull()).alias(f"{c}_null"), n(F.trim(F.coalesce(c, F.lit(""))) == "").alias(f"{c}_missing")]
    for c in ("business_name", "business_address"):
        length, toks = F.length(F.coalesce(c, F.lit(""))), F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != ""))
        for name, v in (("length", length), ("tokens", toks)):
            for f, agg in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
                aggs.append(F.round(agg(v).cast("double"), 4).alias(f"{c}_{name}_{f}"))
    return records.agg(*aggs)


def file_profile(lines: DataFrame, columns: tuple[str, ...] = ("entity_id", "business_name", "business_address", "country")) -> dict:
    """The profile of a file from its lines (n, cells): blank and malformed ones are counted and left out."""
    odd = lines.agg(F.coalesce(F.sum((F.col("n") == 0).cast("long")), F.lit(0)).alias("empty_rows"), F.coalesce(F.sum(((F.col("n") != 0) & (F.col("n") != len(columns))).cast("long")), F.lit(0)).alias("malformed_rows")).first().asDict()
    rows = lines.where(F.col("n") == len(columns)).select(*[F.col("cells")[k].alias(c) for k, c in enumerate(columns)])
    return odd | source_profile(rows).first().asDict() | {"country_counts": {r["country"]: r["n"] for r in country_counts(rows).collect()}}


def country_counts(records: DataFrame) -> DataFrame:
    """(country, n) of the raw countries that are not blank."""
    return records.select(F.trim("country").alias("country")).where("country <> ''").groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(records: DataFrame, column: str, most: int = 15, longer_than: int = 2, every: int = 1) -> DataFrame:
    """The most frequent lower-case tokens; ties by token. The older profile looks at every tenth row by row_seq."""
    if every > 1:
        records = records.where(F.col("row_seq") % every == 0)
    t = records.select(F.explode(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+")).alias("token")).where(F.length("token") > longer_than)
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token").limit(most)


def truth_profile(lists: DataFrame) -> DataFrame:
    """One row: S1s without, with one, with any matches, links, targets of more than one S1, most S1s of a target."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    k = F.size("target_ids")
    s = lists.agg(F.count(F.lit(1)).alias("s1"), n(k == 0).alias("zero_match"), n(k == 1).alias("one_match"), n(k > 0).alias("matched"), n(k).alias("links"), F.coalesce(F.max(k), F.lit(0)).alias("most_matches"))
    t = lists.select("source1_id", F.explode("target_ids").alias("t")).groupBy("t").agg(F.countDistinct("source1_id").alias("k"))
    t = t.agg(F.count(F.lit(1)).alias("targets"), n(F.col("k") > 1).alias("shared_targets"), F.coalesce(F.max("k"), F.lit(0)).alias("most_s1"))
    return s.join(F.broadcast(t))  # one row each


def match_histogram(lists: DataFrame) -> DataFrame:
    return lists.groupBy(F.size("target_ids").alias("matches")).agg(F.count(F.lit(1)).alias("s1"))


def shared_targets(lists: DataFrame) -> DataFrame:
    """(target_id, s1): targets that more than one S1 claims."""
    t = lists.select("source1_id", F.explode("target_ids").alias("target_id")).groupBy("target_id").agg(F.countDistinct("source1_id").alias("s1"))
    return t.where("s1 > 1")


def source_histogram(lists: DataFrame) -> DataFrame:
    """(s2, s3, s1): how many S1s have so many matches in each source."""
    n = lambda s: F.size(F.filter("target_ids", lambda t: t.startswith(s)))
    return lists.groupBy(n("S2").alias("s2"), n("S3").alias("s3")).agg(F.count(F.lit(1)).alias("s1"))
