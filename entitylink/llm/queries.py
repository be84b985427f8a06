"""The queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, language, minhash, mixing, packing, pii, quality, token_output, topk, toxicity
from .common import Scratch, held_out, remainder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    return language.predict(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model).drop("text")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), Scratch(spark, "op3"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark, "op4"), percent=85)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5, Scratch(spark, "op6"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    out = toxicity.score(docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model)
    return out.drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    folder = scratch.path("shards")
    manifest = scratch.save(token_output.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder), "manifest")
    return token_output.read_tokens(token_output.with_bases(manifest), folder)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.taken(docs, Scratch(spark, "op9"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    net = quality.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    out = quality.score(docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text"), net)
    return out.drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_language, op3_embedding_dedup, op4_minhash_dedup, op5_pii, op6_exact_topk, op7_toxicity, op8_token_output, op9_mixing, op10_quality)}
SQL: dict[str, str] = {"op6_exact_topk": topk.SQL, "op9_mixing": mixing.SQL}
