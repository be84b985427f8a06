"""Command line: ``python -m entitylink.plans.cli --stage all --dataset DIR --output DIR``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from ..session import session
from .config import Config, Contract, log
from .stages import Run

#: What each stage name runs, in order: (method, split or None).
STAGES: dict[str, list[tuple[str, str | None]]] = {
    "verify": [("verify", "train"), ("verify", "test")],
    "profile": [("profile", "train"), ("profile", "test")],
    "normalize": [("normalize", "train"), ("normalize", "test")],
    "block": [("block", "train"), ("block", "test")],
    "evaluate-blocking": [("evaluate_blocking", "train")],
    "features": [("features", "train"), ("features", "test")],
    "train-model": [("train", None)],
    "calibrate": [("calibrate", None)],
    "predict": [("decide", "test")],
    "validate": [("submit", "test")],
    "consolidate": [("consolidate", "test")],
    "sample": [("sample", "train"), ("sample", "test")],
    "score": [("score", "test")],
    "final-evaluation": [("final_evaluation", None)],
    "check-final": [("check_final", None)],
    "finalize-test": [("decide", "test"), ("consolidate", "test"), ("submit", "test")],
}
STAGES["blocking"] = STAGES["block"] + STAGES["evaluate-blocking"]
STAGES["decision"] = STAGES["calibrate"] + [("decide", "test")]
_BOTH = [("decide", "train"), ("decide", "test"), ("consolidate", "train"), ("consolidate", "test")]
STAGES["entity-resolution"] = STAGES["calibrate"] + _BOTH
STAGES["model"] = STAGES["train-model"] + STAGES["entity-resolution"]
STAGES["evaluate-final"] = STAGES["final-evaluation"]
STAGES["m9-test"] = STAGES["finalize-test"]
STAGES["all"] = [s for n in ("verify", "profile", "normalize", "blocking", "features", "model", "final-evaluation", "validate") for s in STAGES[n]]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Record linkage over TSV sources")
    p.add_argument("--stage", choices=sorted(STAGES), default="all")
    p.add_argument("--config", help="JSON of settings; flags override it")
    p.add_argument("--mode", choices=("engine", "fast"), help="how candidates are found: engine, but fast for the stage score")
    p.add_argument("--stored-model", help="stage score: the model to use, instead of the output's own")
    p.add_argument("--verbose", action="store_true")
    kinds = {"int": int, "float": float, "int | None": int}
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(flag, type=kinds.get(f.type, str))
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    stage, path, mode, stored, verbose = (args.pop(k) for k in ("stage", "config", "mode", "stored_model", "verbose"))
    config, out = Config.load(path, **args), log(logging.DEBUG if verbose else logging.INFO)
    run = Run(session(), config)
    Contract(stage, config.__dict__ | {"mode": mode}).save(f"{config.output}/contract.json")
    for method, split in STAGES[stage]:
        out.info("%s %s", method, split or "")
        extra = {"mode": mode} if method in ("block", "score") and mode else {}
        if method == "score":
            extra["model"] = stored or run.model_path()
        got = getattr(run, method)(*([split] if split else []), **extra)
        if isinstance(got, dict):
            out.info("%s", got)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
