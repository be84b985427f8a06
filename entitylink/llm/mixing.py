"""Mixing sources to target weights with a time-varying curriculum; DataFrame functions only.

Targets: sources, ordered by code point with null last, get weights from a repeating list and share
``SHARE`` of all words by weight; a target stops at ``CAP`` times its source's words and what is too
much is shared again by weight.  The fixed point of that is max-min filling: target = min(cap, weight
* level), where the level is the largest of (total - caps of the k sources with the smallest cap per
weight) / (weight of the others).

Demand: within a source, documents stand in the order of the md5 of their ids, pass after pass, until
the target is met; the last pass ends within one document, of which the first words are taken.  So each
source's words are its target rounded down.

Positions: source weights change over training time t in [0, 1] as weight * (1 + tilt * (2t - 1)).
The integral of that is the source's cumulative demand, so the copy whose middle word is at share u of
the source's demand gets the t with (1 - tilt) * t + tilt * t^2 = u.  Copies are range-sorted by t.

Prefix sums run on two levels: hash buckets of about sqrt(n) rows within a source, and the buckets'
sums, so no task sees a source whole; those over sources run over ranges of them, and the ranges' sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: One for each weight: heavy sources come earlier, light ones later.
TILTS = (-0.5, 0.0, 0.5)


def words(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sorted(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` range-sorted and saved, with ``part``, its place among the ranges, and ``at``, the place in it; so no task sorts all rows."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    i = F.monotonically_increasing_id()
    return scratch.save(df.withColumn("part", F.shiftright(i, 33)).withColumn("at", i.bitwiseAND((1 << 33) - 1)), name)


def _before(df: DataFrame, **sums: str) -> DataFrame:
    """Adds the sum of each column over all rows before a row of a sorted table; the ranges' sums are one row for each range."""
    per = df.groupBy("part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()}).join(per, "part")
    return df.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("part", "at", *[f"_{k}" for k in sums])


def targets(sources: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n) -> the same with kind (index of the weight) and target; one slim row for each source, however many."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = _sorted(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_first()], scratch, "by-name")
    # a null source is the last: it stands first here, and all others move up by one
    nulls = F.max(F.col("source").isNull().cast("long"))
    some = sources.agg(F.count(F.lit(1)).alias("all"), F.sum("source_size").alias("total"), F.coalesce(nulls, F.lit(0)).alias("nulls"))
    t = _before(t, rank="one").join(F.broadcast(some))  # one row
    rank = F.when(F.col("source").isNull(), F.col("all") - 1).otherwise(F.col("rank") - F.col("nulls"))
    t = t.withColumn("kind", (rank % len(weights)).cast("int")).withColumn("weight", F.get(ws, F.col("kind"))).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    t = t.select("source", "source_size", "n", "kind", "weight", "cap", "total")
    t = _before(_sorted(t, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], scratch, "by-fill"), full="cap", closed="weight")
    t = scratch.save(t, "fill")
    level = (share * F.col("total") - F.col("full")) / (F.col("weights") - F.col("closed"))
    t = t.join(F.broadcast(t.agg(F.sum("weight").alias("weights"))))  # one row each
    most = t.agg(F.max(level).alias("level"))
    t = t.join(F.broadcast(most))
    return t.select("source", "source_size", "n", "kind", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def plan(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, and
    the number of whole passes, the words of the last one, the words of the source before it, and kind; with
    ``carry``, the whole row too, as ``_row``.

    Null text: size 0.  Null source: a source of its own.  Null and repeated ids are kept, in the order of
    their md5 (null: of the empty string), then of size.  A source without words has target 0.  An empty table
    gives no rows.  Other columns are not looked at, whatever their names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []))
    if not carry:
        slim = scratch.save(slim, "sizes")
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = scratch.save(targets(scratch.save(per, "sources"), scratch, weights, share, cap), "targets")
    most = per.agg(F.max("n")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1.0, math.sqrt(most)), 16)))
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = slim.withColumn("_key", _key(F.col("source"))).withColumn("_h", md5).withColumn("_b", F.substring("_h", 1, digits))
    sums = slim.groupBy("_key", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    sums = sums.join(per.select(_key(F.col("source")).alias("_key"), "source_size", "target", "kind"), "_key")
    within = Window.partitionBy("_key", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("_c", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["_key", "_b"])
    at = F.col("_o") + F.col("_c")
    passes = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("passes", passes).withColumn("at", at)
    rest = F.floor("target").cast("long") - F.col("passes") * F.col("source_size")
    out = out.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("at"))))
    return out.withColumn("taken", F.col("passes") * F.col("size") + F.col("part")).select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "part", "at", "kind", *(["_row"] if carry else []))


def position(u: Column, kind: Column, tilts=TILTS) -> Column:
    """Training time of the share u of a source's demand: the inverse of the integrated weight schedule."""
    a = F.get(F.array(*[F.lit(float(t)) for t in tilts]), kind)
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * u)
    return F.when(a == 0, u).otherwise((root - (1 - a)) / (2 * a))


def copies(p: DataFrame, tilts=TILTS) -> DataFrame:
    """A row for each copy that ``plan`` takes: its columns, with words (of the copy) and mix_position."""
    p = p.where(F.col("taken") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    p = p.withColumn("words", F.when(F.col("_copy") < F.col("passes"), F.col("size")).otherwise(F.col("part"))).where(F.col("words") > 0)
    u = F.least(F.lit(1.0), (F.col("_copy") * F.col("source_size") + F.col("at") + F.col("words") / 2) / F.col("target"))
    return p.withColumn("mix_position", position(u, F.col("kind"), tilts)).drop("_copy")


def _by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position."""
    return mixed.repartitionByRange("mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


def curriculum(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, tilts=TILTS) -> DataFrame:
    """The mixed corpus: a row for each copy that is taken, with all columns of ``docs`` and ``mix_position``, range-sorted by it.

    A copy that is taken in part holds the first words of its text, joined by single spaces.
    Documents without words are in no source's demand: they are left out.  A column ``mix_position`` is replaced.
    """
    p = copies(plan(docs, scratch, weights, share, cap, carry=True), tilts)
    row = F.col("_row")
    cut = F.array_join(F.slice(F.regexp_extract_all(row["text"], F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(row["text"])
    keep = [c for c in docs.columns if c != "mix_position"]
    return _by_position(p.select(*[(text if c == "text" else row[c]).alias(c) for c in keep], "mix_position"))


def taken(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``; taken sums the row's copies in the curriculum.

    The order of training, slim copies without text, stays in the scratch table ``order``.
    """
    p = scratch.save(plan(docs, scratch), "plan")
    # rows with words differ in the words before them within a source, so these name the row
    row = ("doc_id", "source", "at", "size", "source_size", "target")
    order = scratch.save(_by_position(copies(p).select(*row, "words", "mix_position")), "order")
    some = order.groupBy(*row).agg(F.sum("words").alias("taken"))
    none = p.where(F.col("taken") == 0).select(*row, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).drop("source", "at")


#: For DuckDB; the same arithmetic without buckets.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior,
        CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - passes * source_size - prior)) AS BIGINT) AS taken
FROM a
"""
