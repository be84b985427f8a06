from pyspark.sql import functions as F

from entitylink.operators import blocking as B
from entitylink.plans import queries as Q
from entitylink.plans import studies
from entitylink.sources.adapters import truth


def test_studies(spark, sf):
    n = Q._normal(spark, sf)
    s1, t = Q._sides(n)
    gt = truth(n)
    a = studies.blocking_ablation(s1, t, gt, 5, ("B0", "B5"))
    assert a["B5"]["candidates"] >= a["B0"]["candidates"] and a["B0"]["recovered"] == 0
    base, full = B.candidates(s1, t, 5, B.ABLATION["B0"]), B.candidates(s1, t, 5)
    audit = studies.candidate_audit(s1, t, base, full, 5)
    assert audit["full"] == audit["shared"] + sum(audit["new_by_strategy"].values()) and len(audit["largest"]) == 20
    scored = Q._scored(spark, sf, *Q.EVIDENCE)
    e = studies.error_analysis(scored, gt, 0.6, 5)
    assert len(e["rescue"]) == 8 and len(e["worst_fp"]) <= 5
    p = studies.policy_ablation(scored, s1.select(F.col("entity_id").alias("source1_id")), gt)
    assert set(p) == {"P0", "P1-A", "P1-B", "P2", "P3"} and not p["P0"]["promoted"]
    r = studies.sampled_recall(s1, t, gt, 40, 60, 50)
    assert r["recall_1_hits"] >= r["recall_3_hits"]
    kinds = studies.miss_report(gt, base, full, s1, t).collect()
    assert sum(r.n for r in kinds) > 0 and all(r.name_kind.startswith("NAME_") and r.country_kind.startswith("COUNTRY_") for r in kinds)
