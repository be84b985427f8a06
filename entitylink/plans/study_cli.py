"""Command line of the studies over a run's tables: ``python -m entitylink.plans.study_cli --study NAME --output DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import evaluate as V
from ..operators import profile as R
from ..session import session
from ..sources import sinks, tsv
from . import studies
from .config import Config, log
from .stages import Run


def _scored(run: Run) -> DataFrame:
    return run.load("train", "decisions").withColumn("score", F.col("calibrated_score"))


def blocking_ablation(run: Run) -> dict:
    return studies.blocking_ablation(*run.sides("train"), run.truth(), run.c.cap)


def candidate_audit(run: Run) -> dict:
    s1, t = run.sides("train")
    return studies.candidate_audit(s1, t, B.candidates(s1, t, run.c.cap, B.ABLATION["B0"]), B.candidates(s1, t, run.c.cap), run.c.cap)


def error_analysis(run: Run) -> dict:
    return studies.error_analysis(_scored(run), run.truth(), run.c.threshold, run.c.top_errors)


def policy_ablation(run: Run) -> dict:
    s1 = run.sides("train")[0].select(F.col("entity_id").alias("source1_id"))
    return studies.policy_ablation(_scored(run), s1, run.truth())


def sampled_recall(run: Run) -> dict:
    return studies.sampled_recall(*run.sides("train"), run.truth(), run.c.sample_size, 20 * run.c.sample_size, run.c.cap)


def misses(run: Run) -> dict:
    s1, t = run.sides("train")
    m = studies.miss_report(run.truth(), B.candidates(s1, t, run.c.cap, B.ABLATION["B0"]), B.candidates(s1, t, run.c.cap), s1, t)
    return {f"{r['name_kind']}/{r['country_kind']}": r["n"] for r in m.collect()}


def older_profile(run: Run) -> dict:
    out = {}
    for n in (1, 2, 3):
        path = run.c.source("train", n)
        df = tsv.read_quoted(run.spark, path).withColumn("row_seq", F.monotonically_increasing_id())
        out[f"S{n}"] = R.file_profile(tsv.lines(run.spark, path)) | {c: {r["token"]: r["n"] for r in R.top_tokens(df, c, every=10).collect()} for c in ("business_name", "business_address")}
    return out


def index_report(run: Run) -> dict:
    posts = B.postings(run.sides("train")[1])
    size = B.buckets(posts, run.c.cap)
    return B.key_report(posts).first().asDict() | {"buckets": B.bucket_report(size)[0].first().asDict(), "sizes": {str(r["q"]): r["value"] for r in V.percentiles(size, "bucket_size", kind="floor").collect()}}


STUDIES = {f.__name__.replace("_", "-"): f for f in (blocking_ablation, candidate_audit, error_analysis, policy_ablation, sampled_recall, misses, older_profile, index_report)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Studies over the tables of a run")
    p.add_argument("--study", choices=sorted(STUDIES), required=True)
    p.add_argument("--config", help="JSON of settings")
    p.add_argument("--dataset")
    p.add_argument("--output")
    args = p.parse_args(argv)
    run = Run(session(), Config.load(args.config, dataset=args.dataset, output=args.output))
    report = STUDIES[args.study](run)
    sinks.write_json(report, f"{run.c.output}/studies/{args.study}.json")
    sinks.write_text(report, f"{run.c.output}/studies/{args.study}.txt", args.study)
    log().info("%s", report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
