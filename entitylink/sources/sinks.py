"""Writers: submissions, reports, scores; and the check of a submission."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import join_parts, put_text, remove


def id_lists(s1: DataFrame, pairs: DataFrame, into: str) -> DataFrame:
    """A row for each S1 (source1_entity_id, row_seq) in its order, with the sorted ids of its pairs joined by commas."""
    got = pairs.groupBy(F.col("source1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(into))
    return s1.join(got, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(into, F.lit("")).alias(into), "row_seq")


def write_tsv(df: DataFrame, path: str, order: tuple[str, ...] = (), single: bool = False) -> None:
    """Sorted by ``order`` across files; ``single`` makes one file, for small results."""
    if order:
        df = df.orderBy(*order)
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_submission(s1: DataFrame, pairs: DataFrame, path: str, into: str = "matched_entity_ids") -> None:
    """One TSV file in the order of the S1 rows; its parts are sorted by executors and joined as streams."""
    df = id_lists(s1, pairs, into).orderBy("row_seq").drop("row_seq")
    parts = f"{path}.parts"
    df.write.mode("overwrite").csv(parts, sep="\t", header=False, quote="", emptyValue="")
    join_parts(df.sparkSession, parts, path, "\t".join(df.columns))
    remove(df.sparkSession, parts)


def scores(df: DataFrame, places: int = 10) -> DataFrame:
    """Scores as text of fixed places."""
    return df.withColumn("score", F.format_string(f"%.{places}f", F.col("score")))


def write_json(report: dict, path: str) -> None:
    put_text(SparkSession.active(), path, json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")


def write_text(report: dict, path: str, title: str) -> None:
    def lines(d: dict, depth: int = 0):
        for k, v in d.items():
            if isinstance(v, dict):
                yield "  " * depth + f"{k}:"
                yield from lines(v, depth + 1)
            else:
                yield "  " * depth + f"{k}: {v}"

    put_text(SparkSession.active(), path, "\n".join([title, "=" * len(title), *lines(report)]) + "\n")


def write_samples(df: DataFrame, path: str, most: int) -> None:
    """The first rows as JSON lines."""
    df.limit(most).coalesce(1).write.mode("overwrite").json(path)


def submission_faults(s1: DataFrame, matches: DataFrame, candidates: DataFrame, targets: DataFrame) -> dict[str, int]:
    """Rows that break a rule: S1s missing or unknown, repeated rows, matches that are no candidates, ids that are no targets.

    ``matches`` and ``candidates`` are (source1_entity_id, ids as array); ``targets`` has entity_id.
    """
    pair = lambda d: d.select("source1_entity_id", F.explode("ids").alias("target_id"))
    m, c = pair(matches), pair(candidates)
    return {
        "s1_missing": s1.join(matches, "source1_entity_id", "left_anti").count(),
        "s1_unknown": matches.join(s1, "source1_entity_id", "left_anti").count(),
        "s1_repeated": matches.groupBy("source1_entity_id").count().where("count > 1").count(),
        "match_not_candidate": m.join(c, ["source1_entity_id", "target_id"], "left_anti").count(),
        "unknown_target": m.unionByName(c).join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").count(),
    }
