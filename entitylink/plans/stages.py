"""The stages of a run: each reads what the ones before wrote and writes Parquet, so any can run again alone."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import consolidate as C
from ..operators import decision as D
from ..operators import evaluate as V
from ..operators import features as P
from ..operators import model as L
from ..operators import profile as R
from ..operators.normalize import normalize
from ..sources import sinks, tsv
from ..sources.scratch import get_text, size
from . import studies
from .config import Config, overfit_faults


class Run:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.c = spark, config

    # -- reading and writing --------------------------------------------------------------------

    def save(self, df: DataFrame, split: str, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.c.at(split, name))
        return self.load(split, name)

    def load(self, split: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.c.at(split, name))

    def records(self, split: str) -> DataFrame:
        """All three sources with their number; of a repeated id the last row stays."""
        out = None
        for n in (1, 2, 3):
            df = tsv.scan(tsv.read_quoted(self.spark, self.c.source(split, n)), self.c.country, self.c.max_rows)
            df = df.withColumns({"source": F.lit(f"S{n}"), "row_seq": F.monotonically_increasing_id()})
            out = df if out is None else out.unionByName(df)
        return tsv.latest(out, ("source", "entity_id"), "row_seq")

    def truth(self) -> DataFrame:
        return tsv.truth_pairs(tsv.read_quoted(self.spark, self.c.truth(), tsv.TRUTH))

    def model_path(self) -> str:
        return f"{self.c.output}/model" + (".json" if self.c.model == "logistic" else "")

    def load_model(self, path: str | None = None) -> L.Linear | L.Boosted:
        path = path or self.model_path()
        return (L.Linear if path.endswith(".json") else L.Boosted).load(path)

    def fit(self, rows: DataFrame, columns: tuple[str, ...] = P.ALL) -> L.Linear | L.Boosted:
        c = self.c
        return L.fit_logistic(rows, columns) if c.model == "logistic" else L.fit_boosted(rows, columns, c.trees, c.tree_rate, c.tree_depth, c.tree_least_rows)

    # -- stages ---------------------------------------------------------------------------------

    def verify(self, split: str, truth: bool = True) -> None:
        paths = {f"{split} source{n}": self.c.source(split, n) for n in (1, 2, 3)}
        if bad := tsv.check_headers(self.spark, paths, self.c.truth() if split == "train" and truth else None):
            raise ValueError("; ".join(bad))

    def profile(self, split: str) -> dict:
        report = {}
        for n in (1, 2, 3):
            path = self.c.source(split, n)
            report[f"S{n}"] = R.file_profile(tsv.lines(self.spark, path)) | {"bytes": size(self.spark, path)}
            if not self.c.exact_ids:
                report[f"S{n}"].pop("distinct_ids")
        if split == "train":
            lists = tsv.truth_lists(tsv.read_quoted(self.spark, self.c.truth(), tsv.TRUTH))
            report["truth"] = R.truth_profile(lists).first().asDict() | {"histogram": {r["matches"]: r["s1"] for r in R.match_histogram(lists).collect()}}
        sinks.write_json(report, self.c.at(split, "profile.json"))
        sinks.write_text(report, self.c.at(split, "profile.txt"), f"Profile of {split}")
        return report

    def normalize(self, split: str) -> DataFrame:
        return self.save(normalize(self.records(split)), split, "normalized")

    def sample(self, split: str) -> None:
        """The first normalised records of each source as JSON lines, to look at."""
        n = self.load(split, "normalized")
        for k in (1, 2, 3):
            sinks.write_samples(n.where(F.col("source") == f"S{k}").orderBy("row_seq"), self.c.at(split, f"sample_source{k}"), self.c.sample_size)

    def sides(self, split: str) -> tuple[DataFrame, DataFrame]:
        n = self.load(split, "normalized")
        return n.where("source = 'S1'"), n.where("source <> 'S1'")

    def rules(self) -> B.Rules:
        c = self.c
        return B.Rules(c.alias_blocking, c.transliteration, c.country_fallback, c.smart_capping, c.identity)

    def block(self, split: str, mode: str = "engine") -> DataFrame:
        s1, t = self.sides(split)
        pairs = B.candidates(s1, t, self.c.cap, self.rules()) if mode == "engine" else B.fast_candidates(s1, t, self.c.fast_cap)
        pairs = self.save(pairs, split, "candidates")
        if self.c.export_candidates:
            named = pairs.select(F.col("source1_id").alias("source1_entity_id"), "target_source", F.col("target_id").alias("target_entity_id"))
            sinks.write_tsv(named, self.c.at(split, "candidates_tsv"), tuple(named.columns))
        return pairs

    def evaluate_blocking(self, split: str) -> dict:
        s1, t = self.sides(split)
        r = V.blocking_recall(self.load(split, "candidates"), self.truth(), s1.select(F.col("entity_id").alias("source1_id")), t.count()).first().asDict()
        sinks.write_json(r, self.c.at(split, "blocking.json"))
        return r

    def features(self, split: str) -> DataFrame:
        s1, t = self.sides(split)
        return self.save(P.pair_features(self.load(split, "candidates"), s1, t, self.truth() if split == "train" and self.c.labels else None), split, "features")

    def train(self) -> L.Linear | L.Boosted:
        f = L.split(self.load("train", "features"), self.c.validation)
        mine = f.where("part = 'train'").drop("part")
        hard = min(self.c.hard_negatives, self.c.hard_ratio * min(self.c.positives, mine.where("label = 1").count()))
        model = self.fit(L.training_sample(mine, self.c.positives, max(1, hard), self.c.seed))
        model.save(self.model_path())
        rest = model.score(f.where("part = 'validation'")).select(F.col("raw_score").alias("score"), "label")
        report = L.validation_metrics(rest, tuple(float(t) for t in self.c.thresholds.split(",")))
        if isinstance(model, L.Linear):
            report["weights"] = {c: w for c, w, _ in model.report()}
        sinks.write_json(report, self.c.at("train", "model.json"))
        return model

    def calibrate(self) -> L.Linear | L.Boosted:
        f = L.split(self.load("train", "features"), self.c.validation).where("part = 'validation'")
        model = L.calibrate(self.load_model(), f, self.c.least_precision, self.c.seed, self.c.threshold_steps, self.c.calibration, self.c.calibration_share, self.c.least_recall)
        model.save(self.model_path())
        return model

    def decide(self, split: str, model: str | None = None) -> DataFrame:
        scored = self.load_model(model).score(self.load(split, "features"))
        d = D.decide(scored, self.c.threshold, self.c.country_veto)
        if self.c.policy == "P1-A":
            ok = D.p1a(F.col("calibrated_score"), F.col("strong_evidence_count"))
            if self.c.country_veto:
                ok = ok & (F.col("country_conflict") == 0)
            d = d.withColumn("decision", F.when(ok, "MATCH").otherwise("NON_MATCH"))
        return self.save(d, split, "decisions")

    def clusters(self, decisions: DataFrame) -> DataFrame:
        return C.clusters(decisions, self.c.least_edge, self.c.negative if self.c.negative_veto else 2.0, self.c.edge_country_veto)

    def consolidate(self, split: str) -> dict:
        decisions = self.load(split, "decisions")
        nodes = self.save(self.clusters(decisions), split, "nodes")
        self.save(C.assignments(nodes, self.c.most_cluster), split, "assignments")
        self.save(C.s1_resolution(nodes), split, "s1_resolution")
        edges = C.edge_reasons(decisions, self.c.least_edge, self.c.edge_country_veto).where("edge_reason = 'accepted'")
        ids = nodes.where("source = 'S1'").select(F.col("entity_id").alias("source1_id"), "cluster_id")
        self.save(edges.join(ids, "source1_id").select("source1_id", "target_source", "target_id", "calibrated_score", "decision_reason", "cluster_id"), split, "accepted_edges")
        r = C.cluster_report(nodes, self.c.most_cluster).first().asDict()
        if split == "train":
            r["direct"] = C.pair_metrics(decisions.where("decision = 'MATCH'"), self.truth()).first().asDict()
            r["closure"] = C.pair_metrics(C.closure(nodes), self.truth()).first().asDict()
        sinks.write_json(r, self.c.at(split, "clusters.json"))
        return r

    def final_evaluation(self) -> dict:
        """Out-of-fold scores, the threshold chosen on the training S1s, metrics on both sides, errors, clusters, and the check for overfitting."""
        c = self.c
        lists = tsv.truth_lists(tsv.read_quoted(self.spark, c.truth(), tsv.TRUTH))
        f = self.load("train", "features")
        other = tsv.read_quoted(self.spark, c.evaluated_file, ("entity_id",)) if c.evaluated_file else None
        s1_file = tsv.read_quoted(self.spark, c.source("train", 1))
        about = V.evaluated_s1(f, s1_file, c.evaluated, other)
        V.check_population(V.population(lists.join(about, "source1_id", "left_semi"), f))
        parts = self.save(V.roles(about, c.seed, c.holdout, c.folds), "train", "roles")
        audit = {r["check"]: r for r in V.leakage(parts, f).collect()}
        if bad := [k for k, r in audit.items() if r["fatal"] and r["violations"] and k != "missing_population"]:
            raise ValueError(f"leakage: {bad}")
        scored, model = L.out_of_fold(f, parts, c.folds, c.seed, P.ALL, c.final_calibration, c.final_share, self.fit)
        scored = self.save(scored.withColumn("score", F.col("calibrated_score")), "train", "oof")
        model.save(f"{c.output}/final_model" + (".json" if isinstance(model, L.Linear) else ""))
        truth, out = self.truth(), {}
        role = lambda r: parts.where(F.col("role") == r)
        mine = truth.join(role("train"), "source1_id", "left_semi")
        free = scored.where("country_conflict = 0") if c.country_veto else scored
        swept = V.sweep(free.where("role = 'train'").select("source1_id", "target_id", "score"), role("train"), mine, c.final_steps).where(F.col("macro_recall") >= c.final_recall)
        best = V.choose(swept, c.final_precision).first()
        threshold = best["threshold"] if best else c.threshold
        for name in ("train", "holdout"):
            s1 = role(name)
            true = truth.join(s1, "source1_id", "left_semi")
            own = scored.join(s1.select("source1_id"), "source1_id", "left_semi")
            got = free.where(F.col("score") >= threshold).join(s1, "source1_id", "left_semi")
            out[name] = V.cohort(V.s1_scores(s1, got, true)).first().asDict() | {"threshold": threshold}
            per = parts.where(F.col("role") == name)
            if name == "train":
                fold = [V.cohort(V.s1_scores(per.where(F.col("fold") == k), got, true)).withColumn("fold", F.lit(k)) for k in range(c.folds)]
                out["folds"] = V.fold_spread(reduce(DataFrame.unionByName, fold)).first().asDict()
            out[f"{name}_errors"] = studies.error_analysis(own, true, threshold, c.top_errors)
            decided = D.decide(own, threshold, c.country_veto)
            nodes = self.clusters(decided)
            out[f"{name}_clusters"] = C.cluster_report(nodes, c.most_cluster).first().asDict() | {"closure": C.pair_metrics(C.closure(nodes), true).first().asDict()}
            self.save(decided.select("source1_id", "target_source", "target_id", "raw_score", "calibrated_score", "decision", "decision_reason", "label", "country_conflict", "strong_evidence_count"), "train", f"{name}_decisions")
            self.save(lists.join(s1, "source1_id", "left_semi").select("source1_id", F.array_join(F.array_sort("target_ids"), ",").alias("matched_entity_ids")), "train", f"{name}_truth")
        out["ranking"] = V.ranking(scored.select("score", "label")).first().asDict()
        facts = {"uses_test": False, "model": c.model, "calibration": c.final_calibration}
        out["faults"] = overfit_faults(out["train"] | facts, out["holdout"] | facts)
        out["contract"] = facts | {"no_s1_cross_partition": not audit["s1_overlap"]["violations"], "settings": c.__dict__}
        sinks.write_json(out, c.at("train", "final.json"))
        return out

    def check_final(self) -> list[str]:
        """Signs of overfitting in a final evaluation that was written before; raises if there is one."""
        out = json.loads(get_text(self.spark, self.c.at("train", "final.json")))
        facts = out["contract"]
        bad = overfit_faults(out["train"] | facts, out["holdout"] | facts) + ([] if facts["no_s1_cross_partition"] else ["an S1 on both sides"])
        sinks.write_json({"status": "INVESTIGATE" if bad else "PASS", "faults": bad, "gap": abs(out["train"]["macro_f05"] - out["holdout"]["macro_f05"])}, self.c.at("train", "overfit.json"))
        if bad:
            raise ValueError(f"final evaluation: {bad}")
        return bad

    def score(self, split: str, model: str, mode: str = "fast") -> dict:
        """From raw files to both submission files with a stored model and its policy, nothing else needed."""
        self.verify(split, False)
        self.normalize(split)
        self.block(split, mode)
        s1, t = self.sides(split)
        self.save(P.pair_features(self.load(split, "candidates"), s1, t), split, "features")
        matched = self.decide(split, model).where("decision = 'MATCH'")
        bad = self.submit(split)
        r = {"s1": s1.count(), "candidates": self.load(split, "candidates").count(), "accepted": matched.count(), "matched_s1": matched.select("source1_id").distinct().count()} | bad
        sinks.write_json(r, self.c.at(split, "score.json"))
        return r

    def submit(self, split: str = "test") -> dict:
        """Both submission files in the order of the S1 file, and what is wrong with them (nothing, or an error)."""
        s1 = tsv.read_quoted(self.spark, self.c.source(split, 1)).select(F.col("entity_id").alias("source1_entity_id"), F.monotonically_increasing_id().alias("row_seq"))
        matched = self.load(split, "decisions").where("decision = 'MATCH'")
        sinks.write_submission(s1, matched, self.c.at(split, "matching_results.tsv"))
        sinks.write_submission(s1, self.load(split, "candidates"), self.c.at(split, "candidate_pairs.tsv"), "candidate_entity_ids")
        ids = lambda d: d.groupBy(F.col("source1_id").alias("source1_entity_id")).agg(F.collect_set("target_id").alias("ids"))
        every = lambda d: s1.select("source1_entity_id").join(ids(d), "source1_entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
        bad = sinks.submission_faults(s1, every(matched), every(self.load(split, "candidates")), self.sides(split)[1])
        if any(bad.values()):
            raise ValueError(f"submission: {bad}")
        return bad
