"""Settings of a run, and contracts of experiments."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from ..functions.hashing import config_hash

SOURCES = ("source1", "source2", "source3")


#: Where the files of a split may lie under the dataset's folder, first found first.
LAYOUTS = ("", "{split}", "dataset/{split}", "student_resource/dataset/{split}")


@dataclass
class Config:
    """``dataset`` holds {split}_source{1,2,3}.tsv and train_ground_truth.tsv, or folders with them (``LAYOUTS``); results go under ``output``."""

    dataset: str = "dataset"
    output: str = "output"
    country: str | None = None
    max_rows: int | None = None
    seed: int = 42
    exact_ids: bool = False
    sample_size: int = 100
    # blocking
    cap: int = 500
    fast_cap: int = 50
    alias_blocking: bool = True
    transliteration: bool = True
    country_fallback: bool = True
    smart_capping: bool = True
    identity: bool = False
    export_candidates: bool = False
    # features and training
    labels: bool = True
    validation: float = 0.20
    positives: int = 200_000
    hard_negatives: int = 400_000
    hard_ratio: int = 4
    thresholds: str = "0.5,0.7,0.8,0.9,0.95,0.97,0.98,0.99"
    model: str = "logistic"
    trees: int = 50
    tree_rate: float = 0.05
    tree_depth: int = 5
    tree_least_rows: int = 20
    # calibration and decisions
    calibration: str = "platt"
    calibration_share: float = 0.50
    least_precision: float = 0.99
    least_recall: float = 0.0
    threshold_steps: int = 1001
    threshold: float = 0.8625
    policy: str = "P0"
    country_veto: bool = True
    # clusters
    least_edge: float = 0.0
    most_cluster: int = 1000
    negative_veto: bool = True
    negative: float = 0.99
    edge_country_veto: bool = True
    # final evaluation
    folds: int = 5
    holdout: float = 0.15
    final_share: float = 0.25
    final_calibration: str = "platt"
    final_steps: int = 401
    final_precision: float = 0.99
    final_recall: float = 0.0
    top_errors: int = 100
    evaluated: str = "feature"
    evaluated_file: str | None = None

    def __post_init__(self):
        if self.cap < 1 or self.fast_cap < 1 or self.sample_size < 1:
            raise ValueError("caps and sample sizes must be positive")
        for name in ("threshold", "least_recall", "final_recall", "validation", "calibration_share", "final_share", "negative"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if not 0 < self.least_precision <= 1 or not 0 < self.final_precision <= 1 or not 0 <= self.holdout < 1:
            raise ValueError("precisions and the hold-out share must lie in [0, 1]")
        if self.folds < 2:
            raise ValueError("there must be two folds at least")
        for name, known in (("policy", ("P0", "P1-A")), ("calibration", ("platt", "isotonic", "none")), ("final_calibration", ("platt", "isotonic", "none")), ("model", ("logistic", "boosted")), ("evaluated", ("feature", "file"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")

    @staticmethod
    def load(path: str | None = None, **over) -> "Config":
        base = json.loads(Path(path).read_text()) if path else {}
        if env := os.environ.get("ENTITYLINK_DATASET_DIR"):
            base["dataset"] = env
        return Config(**base | {k: v for k, v in over.items() if v is not None})

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))

    def find(self, split: str, name: str) -> str:
        """The first place of the file among the layouts; without one, beside the dataset's other files."""
        from pyspark.sql import SparkSession

        from ..sources.scratch import exists

        places = ["/".join(x for x in (self.dataset, layout.format(split=split), name) if x) for layout in LAYOUTS]
        spark = SparkSession.getActiveSession()
        return next((p for p in places if spark and exists(spark, p)), places[0])

    def source(self, split: str, n: int) -> str:
        return self.find(split, f"{split}_source{n}.tsv")

    def truth(self) -> str:
        return self.find("train", "train_ground_truth.tsv")

    def at(self, split: str, name: str) -> str:
        return f"{self.output}/{split}/{name}"


@dataclass
class Contract:
    """What an experiment ran with, under a hash of its settings."""

    name: str
    settings: dict
    made: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        from ..sources.scratch import put_text

        put_text(SparkSession.active(), path, json.dumps(asdict(self) | {"hash": config_hash(self.settings)}, indent=2, sort_keys=True))


def check_stage(name: str, **counts: tuple[int, int]) -> None:
    """Each count must equal what is expected of it."""
    bad = {k: v for k, v in counts.items() if v[0] != v[1]}
    if bad:
        raise ValueError(f"{name}: {bad}")


def overfit_faults(train: dict, holdout: dict, most_gap: float = 0.005) -> list[str]:
    """Signs that a frozen policy was fitted to its evaluation."""
    bad = []
    if abs(train["macro_f05"] - holdout["macro_f05"]) > most_gap:
        bad.append("gap between training and hold-out")
    if train["threshold"] != holdout["threshold"]:
        bad.append("different thresholds")
    if train.get("uses_test") or holdout.get("uses_test"):
        bad.append("test data were used")
    if train.get("model", "logistic") != "logistic" or train.get("calibration", "platt") != "platt":
        bad.append("not the frozen model")
    return bad


def log(level: int = logging.INFO) -> logging.Logger:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    return logging.getLogger("entitylink")
