import json

import pytest

from entitylink.plans import cli, study_cli
from entitylink.plans.config import Config, Contract, check_stage, overfit_faults
from entitylink.plans.stages import Run

NAMES = ["Acme", "Blue River", "Cedar Works", "Delta Foods", "Elm Trading", "Falcon Air", "Green Leaf", "Harbor Inn", "Iris Labs", "Juniper Co", "Kite Media", "Lotus Art", "Maple Soft", "North Star", "Oak Bank", "Pine Tools", "Quartz Gems", "Red Barn", "Silver Line", "Tulip Farm"]


def write(folder, split):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for n in (1, 2, 3):
        rows = []
        for i, name in enumerate(NAMES * 6):
            j = i // len(NAMES)
            if n > 1 and i % 5 == 0:
                continue
            rows.append(f"S{n}-{i}\t{name} {'One Two Six Ten Hub Zed'.split()[j]} {'Inc' if n == 1 else 'Incorporated'}\t{i + 3} Main {'Street' if n == 1 else 'St'} {10000 + 37 * i}\tUS")
        (folder / f"{split}_source{n}.tsv").write_text(head + "\n".join(rows) + "\n")
    truth = [f"S1-{i}\t" + ("" if i % 5 == 0 else f"S2-{i},S3-{i}") for i in range(len(NAMES) * 6)]
    (folder / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(truth) + "\n")


def test_stages_from_files_to_submission(spark, tmp_path):
    write(tmp_path, "train")
    write(tmp_path, "test")
    run = Run(spark, Config(dataset=str(tmp_path), output=str(tmp_path / "out"), threshold=0.6, least_precision=0.9, folds=2))
    for method, split in cli.STAGES["all"]:
        getattr(run, method)(*([split] if split else []))
    r = json.loads((tmp_path / "out/train/blocking.json").read_text())
    assert r["recall"] == 1.0 and r["true_pairs"] == 192
    c = json.loads((tmp_path / "out/train/clusters.json").read_text())
    assert c["direct"]["recall"] > 0.95 and c["direct"]["precision"] > 0.95
    lines = (tmp_path / "out/test/matching_results.tsv").read_text().splitlines()
    assert len(lines) == 121 and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i in range(120)]
    final = json.loads((tmp_path / "out/train/final.json").read_text())
    assert final["train"]["macro_f05"] > 0.9 and final["holdout"]["threshold"] == final["train"]["threshold"] and final["contract"]["no_s1_cross_partition"]
    assert json.loads((tmp_path / "out/train/profile.json").read_text())["S1"]["country_counts"] == {"US": 120}
    # a stored model scores raw files in one go
    again = Run(spark, Config(dataset=str(tmp_path), output=str(tmp_path / "again"), threshold=0.6))
    r = again.score("test", str(tmp_path / "out/model.json"))
    assert r["s1"] == 120 and r["matched_s1"] > 85 and r["match_not_candidate"] == 0
    run.sample("test")
    assert spark.read.json(str(tmp_path / "out/test/sample_source1")).count() == 100
    assert study_cli.STUDIES["index-report"](run)["entities"] == 192 and study_cli.STUDIES["older-profile"](run)["S1"]["rows"] == 120
    if not final["faults"]:
        assert run.check_final() == []


def test_config_and_contracts(tmp_path):
    with pytest.raises(ValueError):
        Config(cap=0)
    with pytest.raises(ValueError):
        Config(policy="P9")
    Config(cap=7).save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json"), fast_cap=9) == Config(cap=7, fast_cap=9)
    Contract("x", {"a": 1}).save(str(tmp_path / "k.json"))
    assert len(json.loads((tmp_path / "k.json").read_text())["hash"]) == 16
    check_stage("s", rows=(1, 1))
    with pytest.raises(ValueError):
        check_stage("s", rows=(1, 2))
    ok = {"macro_f05": 0.8, "threshold": 0.5}
    assert overfit_faults(ok, ok) == [] and len(overfit_faults(ok, {"macro_f05": 0.9, "threshold": 0.6, "uses_test": True})) == 3


def test_every_stage_names_methods():
    assert len(cli.STAGES) == 23
    assert all(hasattr(Run, m) for steps in cli.STAGES.values() for m, _ in steps)
    args = cli.parser().parse_args(["--stage", "all", "--cap", "9", "--no-country-veto", "--calibration", "isotonic", "--final-share", "0.3"])
    assert (args.cap, args.country_veto, args.calibration, args.final_share, args.identity) == (9, False, "isotonic", 0.3, None)


def test_files_are_found_in_their_layouts(spark, tmp_path):
    (tmp_path / "student_resource/dataset/train").mkdir(parents=True)
    f = tmp_path / "student_resource/dataset/train/train_source1.tsv"
    f.write_text("x")
    c = Config(dataset=str(tmp_path))
    assert c.source("train", 1) == str(f) and c.source("train", 2) == str(tmp_path / "train_source2.tsv")
