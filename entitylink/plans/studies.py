"""Studies over a run's tables: blocking ablation, candidate audit, errors, policies, sampled recall, older profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import decision as D
from ..operators import evaluate as V
from ..operators import misses as M


def blocking_ablation(s1: DataFrame, targets: DataFrame, truth: DataFrame, cap: int = 500, names: tuple[str, ...] = tuple(B.ABLATION)) -> dict:
    """Recall of each preset, what it recovers beyond B0, candidates per S1, and the interaction of B5 with its parts."""
    n, ids = targets.count(), s1.select(F.col("entity_id").alias("source1_id"))
    base = B.candidates(s1, targets, cap, B.ABLATION["B0"]).select(*V.PAIR).persist()
    out = {}
    for name in names:
        c = B.candidates(s1, targets, cap, B.ABLATION[name])
        r = V.blocking_recall(c, truth, ids, n).first().asDict()
        r["recovered"] = V.recovered(base, c, truth).count()
        r["per_s1"] = {x["q"]: x["value"] for x in V.percentiles(V.candidate_counts(ids, c), "n").collect()}
        out[name] = r
    base.unpersist()
    parts = {k: out[k]["recovered"] for k in ("B1", "B2", "B3", "B4", "B5") if k in out}
    if len(parts) == 5:
        out["interaction"] = V.interaction(parts, "B5")
    return out


def candidate_audit(s1: DataFrame, targets: DataFrame, base: DataFrame, full: DataFrame, cap: int = 500) -> dict:
    """What the full candidate set adds to the base: pairs by strategy and channel, counts per S1, bucket sizes."""
    new = full.join(base.select(*V.PAIR), V.PAIR, "left_anti")
    by = new.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).withColumn("channel", B.channel(F.col("strategy")))
    totals, largest = B.bucket_report(B.buckets(B.postings(targets), cap))
    counts = V.candidate_counts(s1.select(F.col("entity_id").alias("source1_id")), full, with_zero=False)
    return {
        "base": base.count(), "full": full.count(), "shared": base.select(*V.PAIR).intersect(full.select(*V.PAIR)).count(),
        "new_by_strategy": {r["strategy"]: r["n"] for r in by.collect()}, "new_by_channel": {r["channel"]: r["n"] for r in by.groupBy("channel").agg(F.sum("n").alias("n")).collect()},
        "per_s1": {r["q"]: r["value"] for r in V.percentiles(counts, "n").collect()}, "buckets": totals.first().asDict(), "largest": [r.asDict() for r in largest.collect()],
    }


def error_analysis(scored: DataFrame, truth: DataFrame, threshold: float, most: int = 100) -> dict:
    """Counts of causes and kinds of errors, score bands, the rescue simulation, and the worst examples of both sides."""
    missed = truth.join(scored, ["source1_id", "target_id"], "left").where(F.col("calibrated_score").isNull() | (F.col("calibrated_score") < threshold))
    fp = scored.where((F.col("calibrated_score") >= threshold) & (F.col("label") == 0))
    fn = scored.where((F.col("calibrated_score") < threshold) & (F.col("label") == 1))
    count = lambda d, c, k: {r[k]: r["n"] for r in d.groupBy(c.alias(k)).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        "causes": count(missed, V.fn_cause(), "cause"), "fp": count(fp, V.fp_kind(), "kind"), "fn": count(fn, V.fn_kind(), "kind"),
        "bands": count(scored, V.score_band(F.col("calibrated_score")), "band"),
        "strong": {r["label"]: r.asDict() for r in V.strong_scores(scored).collect()},
        "rescue": [r.asDict() for r in V.rescue(scored, threshold).collect()],
        "worst_fp": [r.asDict() for r in fp.orderBy(F.col("calibrated_score").desc(), *V.PAIR).select(*V.PAIR, "calibrated_score").limit(most).collect()],
        "worst_fn": [r.asDict() for r in fn.orderBy("calibrated_score", *V.PAIR).select(*V.PAIR, "calibrated_score").limit(most).collect()],
    }


def policy_ablation(scored: DataFrame, s1: DataFrame, truth: DataFrame) -> dict:
    """Metrics of each policy over the S1s, and whether it would be promoted over P0."""
    keep = {k: scored.where(c) for k, c in D.policy_columns().items()} | {"P3": D.competitive(scored)}
    out = {k: V.ablation_scores(V.s1_scores(s1, d, truth)).first().asDict() for k, d in keep.items()}
    for k in out:
        out[k]["promoted"] = k != "P0" and D.promoted(out["P0"], out[k])
    return out


def sampled_recall(s1: DataFrame, targets: DataFrame, truth: DataFrame, first: int, distractors: int, cap: int = 500) -> dict:
    """The older evaluation: the first S1s, the targets they need, and the first distractors of each source.

    A sample is what this study is about; ``blocking_recall`` is the whole-table measure.
    """
    own = s1.orderBy("entity_id").limit(first)
    t = truth.join(own.select(F.col("entity_id").alias("source1_id")), "source1_id", "left_semi")
    need = targets.join(t.select(F.col("target_id").alias("entity_id")), "entity_id", "left_semi")
    rest = targets.join(t.select(F.col("target_id").alias("entity_id")), "entity_id", "left_anti")
    some = need
    for s in ("S2", "S3"):
        some = some.unionByName(rest.where(F.col("source") == s).orderBy("entity_id").limit(distractors // 2))
    own_keys = B.emit(own, "source1_id").select("source1_id", "key")
    hits = B.probe_by_key(own_keys, B.postings(some), cap)
    found = t.join(hits, ["source1_id", "target_id"], "left").na.fill({"hits": 0})
    r = found.agg(F.count(F.lit(1)).alias("pairs"), *[F.avg((F.col("hits") >= k).cast("double")).alias(f"recall_{k}_hits") for k in (1, 2, 3)]).first().asDict()
    r["by_strategy"] = {x["s"]: x["n"] for x in found.select(F.explode("strategies").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    return r


def miss_report(truth: DataFrame, base: DataFrame, full: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Missed pairs by how their names and countries relate."""
    m = M.misses(truth, base, full, s1, targets)
    return m.groupBy(M.name_kind(F.col("source1_name"), F.col("target_name")).alias("name_kind"), M.country_kind(F.col("source1_country"), F.col("target_country")).alias("country_kind")).agg(F.count(F.lit(1)).alias("n"))
