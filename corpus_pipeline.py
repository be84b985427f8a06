"""A training-corpus pipeline over ``documents``: each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of documents; other columns of docs are left out,
whatever their names.  An empty table gives no rows in any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylink.llm import minhash, mixing, packing, pii, quality
from entitylink.llm.common import Scratch, remainder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Percent of shared shingles from which documents count as near copies.
NEAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, accepts: a score of 0.5 or more.

    Without a labelled document, all are accepted.  Null and empty texts are scored like others.  Repeated rows,
    and rows without an id, are scored one by one and stay or go together.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    net = quality.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return quality.score(docs.select(*COLUMNS), net, into="_score").where(F.col("_score") >= 0.5).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Texts that are null or without words are near copies of nothing; rows without an id stay.  Of rows that repeat
    an id, those whose set of shingles is kept count, and of these the first by all columns stays.
    """
    scratch = Scratch(spark, "near")
    sets = minhash.near_duplicates(docs, scratch, percent=NEAR, fingerprints=True).where("kept AND doc_id IS NOT NULL")
    kept = sets.select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    rest = docs.where("doc_id IS NULL")
    # rows that repeat a kept id: of those whose set is kept, the first by text stays
    one = docs.join(kept, "doc_id", "left_semi")
    twice = scratch.save(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    if not twice.isEmpty():
        single = one.join(twice, "doc_id", "left_anti")
        again = minhash.fingerprinted(one.join(twice, "doc_id", "left_semi").select(*COLUMNS))
        again = again.join(sets.join(twice, "doc_id", "left_semi").select("doc_id", "fp_a", "fp_b").distinct(), ["doc_id", "fp_a", "fp_b"], "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
        one = single.unionByName(again)
    return one.unionByName(rest).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms, row by row; n_chars counts the new text, and stays where the text is null."""
    out = pii.pseudonymise(docs.select(*COLUMNS)).drop("pii_replaced")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of training.

    Documents without words (null or blank texts) are in no source's demand and go; a null source is a source of its
    own.  Repeated rows are documents of their own.  A source's last copy may be cut to its first words.
    """
    return mixing.curriculum(docs.select(*COLUMNS), Scratch(spark, "mix")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; a null text is the end id alone, repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", good_quality), ("near_dedup", one_of_each), ("pii", private), ("mixing", mixed), ("packing", packed)]
#: Trained and tokenising stages have no SQL; tests/llm/test_pipeline.py compares each stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
