"""Metrics, splits, threshold sweeps, audits and error taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_unit

PAIR = ["source1_id", "target_id"]


# -- populations and splits -------------------------------------------------------------------


def roles(s1: DataFrame, seed: int = 42, holdout: float = 0.15, folds: int = 5) -> DataFrame:
    """Adds role (holdout or train) and fold (-1 for the hold-out) from a seeded hash of source1_id."""
    u = s1.withColumn("_u", seeded_unit(F.col("source1_id"), seed))
    fold = F.least(F.lit(folds - 1), F.floor((F.col("_u") - holdout) / (1 - holdout) * folds)).cast("int")
    return u.withColumns({"role": F.when(F.col("_u") < holdout, "holdout").otherwise("train"), "fold": F.when(F.col("_u") < holdout, F.lit(-1)).otherwise(fold)}).drop("_u")


def population(truth_lists: DataFrame, features: DataFrame) -> DataFrame:
    """(source1_id, singleton, has_features) of every S1 of the ground truth."""
    has = features.select("source1_id").distinct().withColumn("has_features", F.lit(True))
    return truth_lists.select("source1_id", (F.size("target_ids") == 0).alias("singleton")).join(has, "source1_id", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))


def check_population(p: DataFrame) -> None:
    """Every S1 that has matches must have features; singletons may have none."""
    if n := p.where("NOT singleton AND NOT has_features").count():
        raise ValueError(f"{n} S1 with matches have no features")


def leakage(parts: DataFrame, pairs: DataFrame, threshold_role: str = "train") -> DataFrame:
    """(check, violations, fatal): S1s with two roles or folds, S1s of pairs without a role, a threshold chosen on the hold-out, targets on both sides (a warning)."""
    twice = parts.groupBy("source1_id").agg(F.countDistinct("role", "fold").alias("n")).where("n > 1")
    lost = pairs.join(parts, "source1_id", "left_anti").select("source1_id").distinct()
    both = pairs.join(parts.select("source1_id", "role"), "source1_id").groupBy("target_id").agg(F.countDistinct("role").alias("n")).where("n > 1")
    one = lambda d, name, fatal: d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations", F.lit(fatal).alias("fatal"))
    chosen = parts.sparkSession.range(1).select(F.lit("threshold_on_holdout").alias("check"), F.lit(int(threshold_role == "holdout")).cast("long").alias("violations"), F.lit(True).alias("fatal"))
    return one(twice, "s1_overlap", True).unionByName(one(lost, "missing_population", True)).unionByName(chosen).unionByName(one(both, "shared_targets", False))


# -- metrics of S1s ---------------------------------------------------------------------------


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * p * r, b * p + r), F.lit(0.0))


def s1_scores(s1: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """(source1_id, tp, n_pred, n_true, precision, recall, f) for every row of ``s1``, with or without pairs.

    No truth and nothing predicted is 1, 1, 1; no truth but predictions 0, 1, 0; truth but no predictions 0, 0, 0.
    """
    p = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1))
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    per = p.join(t, PAIR, "full").groupBy("source1_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.expr("p * t")).alias("tp"))
    m = s1.select("source1_id").distinct().join(per, "source1_id", "left").na.fill(0)
    prec = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("n_pred") == 0, 0.0).otherwise(F.try_divide("tp", "n_pred"))
    rec = F.when(F.col("n_true") == 0, 1.0).otherwise(F.try_divide("tp", "n_true"))
    m = m.withColumns({"precision": prec, "recall": rec})
    return m.withColumn("f", F.when((F.col("n_true") == 0) & (F.col("n_pred") > 0), 0.0).otherwise(f_beta(F.col("precision"), F.col("recall"), beta)))


def cohort(scores: DataFrame) -> DataFrame:
    """One row: macro means over all S1s, counts of singletons, pair counts and pair precision (1 if nothing is predicted)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    m = scores.agg(
        F.count(F.lit(1)).alias("s1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f").alias("macro_f05"),
        n(F.col("n_true") == 0).alias("singletons"), n((F.col("n_true") == 0) & (F.col("n_pred") > 0)).alias("singleton_false_positives"),
        n(F.col("tp")).alias("pair_tp"), n(F.col("n_pred") - F.col("tp")).alias("pair_fp"), n(F.col("n_true") - F.col("tp")).alias("pair_fn"),
    )
    return m.withColumns({"pair_precision": F.coalesce(F.try_divide("pair_tp", F.col("pair_tp") + F.col("pair_fp")), F.lit(1.0)), "pair_recall": F.coalesce(F.try_divide("pair_tp", F.col("pair_tp") + F.col("pair_fn")), F.lit(0.0))})


def ablation_scores(scores: DataFrame) -> DataFrame:
    """The cohort's row with F of the macro means instead of the mean of F."""
    return cohort(scores).withColumn("macro_f05", f_beta(F.col("macro_precision"), F.col("macro_recall")))


# -- thresholds -------------------------------------------------------------------------------


def sweep(scored: DataFrame, s1: DataFrame, truth: DataFrame, steps: int = 401) -> DataFrame:
    """Cohort metrics at every threshold i / (steps - 1), in one pass over the scores.

    A scored row (source1_id, target_id, score) counts from its highest threshold downwards.  Per S1 the metrics are
    a step function of the threshold; its differences at the steps are summed over all S1s, and running sums over
    the grid give every row.  Scores are rounded to 10 places first.
    """
    top = steps - 1
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    n_true = s1.select("source1_id").distinct().join(truth.groupBy("source1_id").agg(F.countDistinct("target_id").alias("n_true")), "source1_id", "left").na.fill(0)
    s = F.round("score", 10)
    i = F.floor(s * top).cast("int")
    i = F.when((i + 1) / F.lit(float(top)) <= s, i + 1).when(i / F.lit(float(top)) > s, i - 1).otherwise(i)
    rows = scored.join(n_true, "source1_id").join(t, PAIR, "left").withColumn("i", F.least(F.lit(top), i)).where("i >= 0")
    per = rows.groupBy("source1_id", "n_true", "i").agg(F.count(F.lit(1)).alias("pred"), F.count("t").alias("hit"))
    down = Window.partitionBy("source1_id").orderBy(F.col("i").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"cp": F.sum("pred").over(upto), "ct": F.sum("hit").over(upto)})
    none = F.col("n_true") == 0
    prec = F.when(none, 0.0).otherwise(F.col("ct") / F.col("cp"))
    rec = F.when(none, 1.0).otherwise(F.col("ct") / F.col("n_true"))
    per = per.withColumns({"P": prec, "R": rec}).withColumn("F", F.when(none, 0.0).otherwise(f_beta(F.col("P"), F.col("R"))))
    start = F.when(none, 1.0).otherwise(0.0)
    diff = {f"d{c}": F.col(c) - F.coalesce(F.lag(c).over(down), start) for c in "PRF"}
    per = per.withColumns(diff | {"dS": (none & (F.lag("i").over(down).isNull())).cast("long")})
    by = per.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("dP", "dR", "dF", "pred", "hit", "dS")])
    grid = scored.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"))
    base = n_true.agg(F.count(F.lit(1)).alias("s1"), F.coalesce(F.sum((F.col("n_true") == 0).cast("long")), F.lit(0)).alias("singletons"), F.coalesce(F.sum("n_true"), F.lit(0)).alias("true_pairs"))
    run = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over the grid: ``steps`` rows
    g = grid.join(by, "i", "left").na.fill(0).join(F.broadcast(base))  # base is one row
    total = lambda c: F.sum(c).over(run)
    return g.select((F.col("i") / float(top)).alias("threshold"), ((F.col("singletons") + total("dP")) / F.col("s1")).alias("macro_precision"), ((F.col("singletons") + total("dR")) / F.col("s1")).alias("macro_recall"), ((F.col("singletons") + total("dF")) / F.col("s1")).alias("macro_f05"), total("hit").alias("pair_tp"), (total("pred") - total("hit")).alias("pair_fp"), (F.col("true_pairs") - total("hit")).alias("pair_fn"), total("dS").alias("singleton_false_positives"))


def choose(swept: DataFrame, least_precision: float) -> DataFrame:
    """The best row: macro F, then precision, then the lower threshold, among those precise enough, or among all."""
    ok = F.col("macro_precision") >= least_precision
    return swept.orderBy(ok.desc(), F.col("macro_f05").desc(), F.col("macro_precision").desc(), "threshold").limit(1)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, fn, tn, precision and recall (0 where undefined) of (score, label) rows."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    m = scored.agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    return m.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})


def _by_score(scored: DataFrame) -> DataFrame:
    """(score, n, pos) of distinct scores with running counts from the top.

    Scores are dealt by range; a window runs within each of the ranges' numbers and their totals come before them.
    """
    d = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    d = d.withColumn("_b", F.floor(F.col("score") * 512))
    b = d.groupBy("_b").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    before = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 513 rows for scores in [0, 1]
    b = b.select("_b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("bp"))
    own = Window.partitionBy("_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"cn": F.sum("n").over(own), "cp": F.sum("pos").over(own)}).join(F.broadcast(b), "_b").select("score", "n", "pos", (F.col("cn") + F.col("bn")).alias("cn"), (F.col("cp") + F.col("bp")).alias("cp"))


def ranking(scored: DataFrame) -> DataFrame:
    """One row: step-wise average precision, area under the ROC curve, Brier score; ties count together."""
    r = _by_score(scored)
    total = scored.agg(F.sum(F.col("label").cast("long")).alias("P"), F.sum(1 - F.col("label").cast("long")).alias("N"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"))
    m = r.agg(F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("ap"), F.sum((F.col("n") - F.col("pos")) * (F.col("cp") - F.col("pos") / 2)).alias("u"))
    return m.join(F.broadcast(total)).select(F.try_divide("ap", "P").alias("average_precision"), F.try_divide("u", F.col("P") * F.col("N")).alias("roc_auc"), "brier")


#: Upper ends of the score bands and their names (fixed values: reports name them).
BANDS = ((0.90, "<0.90"), (0.95, "0.90-0.95"), (0.99, "0.95-0.99"), (0.995, "0.99-0.995"), (0.999, "0.995-0.999"))


def score_band(score: Column) -> Column:
    """The band of a score; a null score counts as 0."""
    score = F.coalesce(score, F.lit(0.0))
    out = F.when(score < BANDS[0][0], BANDS[0][1])
    for high, name in BANDS[1:]:
        out = out.when(score < high, name)
    return out.otherwise("0.999-1.0")


def fold_spread(metrics: DataFrame, columns: tuple[str, ...] = ("macro_precision", "macro_recall", "macro_f05")) -> DataFrame:
    """Mean, population deviation, minimum and maximum over folds."""
    return metrics.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


# -- errors -----------------------------------------------------------------------------------


def fp_kind() -> Column:
    """Why a false positive looked like a match; the first that holds."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    name, address = c("name_jaro_winkler"), c("address_token_jaccard")
    return (
        F.when(c("country_conflict") != 0, "country_conflict")
        .when((c("domain_exact") != 0) | (c("alias_exact") != 0), "alias_or_domain_collision")
        .when((name >= 0.95) & (c("name_token_jaccard") >= 0.8) & (address < 0.5), "name_collision")
        .when((address >= 0.8) & (name < 0.8), "address_collision")
        .when(c("strong_evidence_count") <= 0, "weak_evidence")
        .otherwise("generic_pairwise_false_positive")
    )


def fn_kind() -> Column:
    """Why a scored match stayed below the threshold; the first that holds."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    return (
        F.when(c("blocking_hit_count") <= 0, "blocking_miss")
        .when(c("country_conflict") != 0, "country_conflict")
        .when((c("domain_exact") != 0) | (c("alias_exact") != 0), "strong_identity_below_threshold")
        .when(c("strong_evidence_count") <= 0, "weak_evidence")
        .otherwise("generic_pairwise_false_negative")
    )


def fn_cause() -> Column:
    """Root causes of missed pairs; a pair that was never a candidate has no features (all null) and is a blocking miss."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    name, words, address, strong = c("name_jaro_winkler"), c("name_token_jaccard"), c("address_token_jaccard"), c("strong_evidence_count")
    return (
        F.when(c("blocking_hit_count") == 0, "1_BLOCKING_MISS")
        .when(c("country_conflict") == 1, "6_COUNTRY_CONFLICT")
        .when((strong >= 1) | (words >= 0.85) | ((name >= 0.95) & (address >= 0.20)), F.when((address == 0) & (words >= 0.90), "5_ADDRESS_CONFLICT").otherwise("2_STRONG_EVIDENCE_BELOW_THRESHOLD"))
        .when((address == 0) & (name >= 0.80), "5_ADDRESS_CONFLICT")
        .when((strong == 0) & (name < 0.80) & (words < 0.50), "3_WEAK_EVIDENCE")
        .otherwise("7_OTHER")
    )


RESCUE_LEVELS = (0.50, 0.60, 0.70, 0.75, 0.80, 0.825, 0.85)


def rescue(rows: DataFrame, threshold: float, levels: tuple[float, ...] = RESCUE_LEVELS) -> DataFrame:
    """What lowering the threshold for rows with strong evidence would do, for each level and the threshold itself.

    ``safe`` looks at all negatives from the level on, ``introduced_fp`` at those below the threshold; the precision
    of nothing is 1.
    """
    strong, score = F.col("strong_evidence_count") >= 1, F.col("calibrated_score")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = []
    for r in sorted({*levels, round(threshold, 4)}):
        low = strong & (score >= r) & (score < threshold)
        tp, fp = n(low & (F.col("label") == 1)), n(low & (F.col("label") == 0))
        precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))
        out.append(F.struct(F.lit(r).alias("rescue_threshold"), tp.alias("additional_tp_recovered"), fp.alias("introduced_fp"), F.round(precision, 4).alias("rescue_precision"), (n(strong & (score >= r) & (F.col("label") == 0)) == 0).alias("safe")))
    return rows.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def strong_scores(rows: DataFrame) -> DataFrame:
    """(label, count, mean, min, p25, median, p75, p95, max) of the scores of rows with strong evidence, to 6 places."""
    q = F.expr("percentile(calibrated_score, array(0.25, 0.5, 0.75, 0.95))")
    per = rows.where("strong_evidence_count >= 1").groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.avg("calibrated_score").alias("mean"), F.min("calibrated_score").alias("min"), q.alias("q"), F.max("calibrated_score").alias("max"))
    return per.select("label", "count", *[F.round(c, 6).alias(n) for n, c in (("mean", F.col("mean")), ("min", F.col("min")), *((n, F.col("q")[k]) for k, n in enumerate(("p25", "median", "p75", "p95"))), ("max", F.col("max")))])


def evaluated_s1(features: DataFrame, s1: DataFrame, source: str = "feature", other: DataFrame | None = None) -> DataFrame:
    """(source1_id) of the S1s that an evaluation is about.

    ``feature``: those that have features, or all of the S1 file if none has; ``file``: those of ``other``, or of the
    S1 file.  Both files hold entity_id; blank ids do not count.
    """
    ids = lambda d, c: d.select(F.trim(F.col(c)).alias("source1_id")).where("source1_id <> ''").distinct()
    if source == "feature" and not (got := ids(features, "source1_id")).isEmpty():
        return got
    return ids(other if source == "file" and other is not None else s1, "entity_id")


# -- blocking ---------------------------------------------------------------------------------


def blocking_recall(cands: DataFrame, truth: DataFrame, s1: DataFrame, n_targets: int | None = None) -> DataFrame:
    """One row: covered and missed pairs, S1s without matches, fully covered ones, positives among candidates, reduction."""
    c = cands.select(*PAIR).distinct().withColumn("c", F.lit(1))
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    per = c.join(t, PAIR, "full").groupBy("source1_id").agg(F.count("c").alias("cand"), F.count("t").alias("true"), F.count(F.expr("c * t")).alias("hit"))
    m = s1.select("source1_id").distinct().join(per, "source1_id", "left").na.fill(0)
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    r = m.agg(n(F.col("true")).alias("true_pairs"), n(F.col("hit")).alias("covered"), n(F.col("cand")).alias("candidates"), F.count(F.lit(1)).alias("s1"), n(F.col("true") == 0).alias("zero_match_s1"), n((F.col("true") > 0) & (F.col("true") == F.col("hit"))).alias("fully_covered_s1"))
    r = r.withColumns({"missed": F.col("true_pairs") - F.col("covered"), "recall": F.coalesce(F.try_divide("covered", "true_pairs"), F.lit(0.0)), "positive_rate": F.coalesce(F.try_divide("covered", "candidates"), F.lit(0.0)), "mean_candidates": F.coalesce(F.try_divide("candidates", "s1"), F.lit(0.0))})
    if n_targets is not None:
        r = r.withColumn("reduction", F.when(F.col("s1") * n_targets > 0, 1 - F.col("candidates") / (F.col("s1") * n_targets)).otherwise(0.0))
    return r


def strategy_recall(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Covered pairs of each first strategy and their share of all true pairs in percent."""
    n = truth.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n"))
    hit = cands.join(truth.select(*PAIR).distinct(), PAIR).groupBy("strategy").agg(F.count(F.lit(1)).alias("covered"))
    return hit.join(F.broadcast(n)).select("strategy", "covered", F.round(100 * F.col("covered") / F.col("n"), 2).alias("recall_percent"))


def candidate_counts(s1: DataFrame, cands: DataFrame, with_zero: bool = True, n: Column | None = None) -> DataFrame:
    """(source1_id, n); S1s without candidates are there with 0, or not at all.  A row of ``cands`` stands for ``n`` pairs, one unless given."""
    n = cands.groupBy("source1_id").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))
    return s1.select("source1_id").distinct().join(n, "source1_id", "left" if with_zero else "inner").na.fill(0)


def percentiles(df: DataFrame, column: str, qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), kind: str = "linear") -> DataFrame:
    """(q, value). Kinds: linear; nearest (rank round-half-even of q * (n - 1)); floor (rank of int(q * n), at most n - 1); ceil (rank of ceil(q * n) - 1).

    The exact ranks come from the counts of distinct values, which map-side aggregation makes small.
    """
    if kind == "linear":
        arr = ", ".join(str(q) for q in qs)
        return df.agg(F.expr(f"percentile({column}, array({arr}))").alias("v")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v").alias("value"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.value").alias("value"))
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "q double, value double")
    ranks = {q: {"nearest": round(q * (n - 1)), "floor": min(int(q * n), n - 1), "ceil": max(0, -int(-q * n // 1) - 1)}[kind] for q in qs}
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))  # distinct sizes, not rows
    per = per.withColumn("upto", below)
    return per.agg(*[F.min(F.when(F.col("upto") > r, F.col("value"))).alias(f"q{k}") for k, r in enumerate(ranks.values())]).select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{k}").alias("value")) for k, q in enumerate(ranks)])).alias("x")).select("x.*")


def recovered(base: DataFrame, variant: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that the variant finds and the base does not."""
    t = truth.select(*PAIR).distinct()
    return t.join(variant.select(*PAIR), PAIR, "left_semi").join(base.select(*PAIR), PAIR, "left_anti")


def interaction(deltas: dict[str, int], combined: str) -> int:
    """What the combination recovers beyond the sum of its parts."""
    return deltas[combined] - sum(v for k, v in deltas.items() if k != combined)
