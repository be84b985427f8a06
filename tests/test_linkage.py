import pytest
from pyspark.sql import functions as F

from entitylink.operators import blocking as B
from entitylink.operators import consolidate as C
from entitylink.operators import decision as D
from entitylink.operators import evaluate as V
from entitylink.operators import features as P
from entitylink.operators import model as L
from entitylink.operators.components import components
from entitylink.operators.normalize import normalize
from entitylink.sources import sinks, tsv

REC = "source string, entity_id string, business_name string, business_address string, country string"


def recs(spark, rows):
    return normalize(spark.createDataFrame([(i[:2], i, *r) for i, *r in rows], REC))


def sides(n):
    return n.where("source = 'S1'"), n.where("source <> 'S1'")


def pairs(df):
    return {(r.source1_id, r.target_id): r for r in df.collect()}


BASIC = [("S1_1", "Acme Corporation", "12 Main Street 411001", "India"), ("S1_2", "No Match LLC", "99 Unknown Road 411999", "India"), ("S2_1", "ACME Corp", "12 Main St 411001", "IN"), ("S2_2", "Other Company", "77 Other Rd 411002", "IN"), ("S3_1", "Acme Corporation", "12 Main Street 411001", "India")]


def test_basic_blocking(spark):
    s1, t = sides(recs(spark, BASIC))
    truth = spark.createDataFrame([("S1_1", "S2_1"), ("S1_1", "S3_1")], "source1_id string, target_id string")
    r = V.blocking_recall(B.candidates(s1, t, 50), truth, s1.select(F.col("entity_id").alias("source1_id"))).first()
    assert r.recall == 1.0 and r.true_pairs == 2 and r.zero_match_s1 == 1 and r.fully_covered_s1 == 1


def test_cap(spark):
    s1, t = sides(recs(spark, [("S1_1", "Same Name", "1 A Street", "India"), *[(f"S2_{i}", "Same Name", f"{i} A Street", "India") for i in range(1, 6)]]))
    size = B.buckets(B.postings(t), 2)
    assert size.where("capped").count() > 0
    assert B.candidates(s1, t, 2).count() <= 1


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (("Beloavi d/b/a Novent Owl PLLC", "100 Broadway", "US"), ("Novent Owl PLLC", "100 Broadway", "US")),
        (("Lotus Media Private Limited", "MG Road Bangalore", "India"), ("लोटस मीडिया प्राइवेट लिमिटेड", "Park Street Kolkata", "India")),
        (("Acme Shop", "1 A Road", ""), ("Acme Shop", "1 A Road", "")),
    ],
)
def test_pairs_are_found(spark, a, b):
    s1, t = sides(recs(spark, [("S1_1", *a), ("S2_1", *b)]))
    got = pairs(B.candidates(s1, t, 50))
    assert ("S1_1", "S2_1") in got
    if "लोटस" in b[0]:
        assert got["S1_1", "S2_1"].strategy.startswith("translit")


def test_full_buckets_are_searched_by_specific_keys(spark):
    rows = [("S1_1", "American Logistics LLC", "500 Main Street 90210", "US"), ("S2_1", "American Logistic Group", "500 Main Ave 90210", "US"), *[(f"S2_{i}", f"American Thing {i}", f"{i} Elm Road 1000{i}", "US") for i in range(2, 5)]]
    s1, t = sides(recs(spark, rows))
    assert ("S1_1", "S2_1") in pairs(B.candidates(s1, t, 2))
    assert pairs(B.fast_candidates(s1, t, 2)).keys() >= {("S1_1", "S2_1")}


def test_hits_and_first_strategy(spark):
    s1, t = sides(recs(spark, BASIC))
    got = pairs(B.candidates(s1, t, 50))
    assert got["S1_1", "S3_1"].strategy == "name_exact_country" and got["S1_1", "S3_1"].hits > 5


def test_features(spark):
    s1, t = sides(recs(spark, BASIC[:1] + BASIC[2:4]))
    c = spark.createDataFrame([("S1_1", "S2", "S2_1"), ("S1_1", "S2", "S2_2"), ("S1_9", "S2", "S2_1")], "source1_id string, target_source string, target_id string")
    truth = spark.createDataFrame([("S1_1", "S2_1")], "source1_id string, target_id string")
    f = pairs(P.pair_features(c, s1, t, truth))
    assert len(f) == 2
    good, bad = f["S1_1", "S2_1"], f["S1_1", "S2_2"]
    assert good.label == 1 and good.country_match == 1 and good.address_exact == 1 and good.name_jaro_winkler > 0.7 and good.postal_exact == 1 and good.house_exact == 1
    assert bad.label == 0 and bad.address_exact == 0 and bad.strong_evidence_count < good.strong_evidence_count
    assert good.name_exact == 0 or good.strong_evidence_count >= 3
    cols = P.pair_features(c, s1, t).columns
    assert cols == [*P.IDS, *P.ALL] and len(P.ALL) == 38


def test_augment_variants(spark):
    f = spark.createDataFrame([("S1_1", "S2", "S2_1")], "source1_id string, target_source string, target_id string")
    names = spark.createDataFrame([("S1_1", "Acme acme.com"), ("S2_1", "Acme Ltd")], "entity_id string, business_name string")
    assert all(P.augment(f, names, "e0").first()[c] == 0 for c in P.S.EXTRA)
    e1, e2 = P.augment(f, names, "e1").first(), P.augment(f, names, "e2").first()
    assert e1.soft_token_similarity > 0 and e1.embedded_domain_present == 0 and e2.soft_token_similarity == 0 and e2.embedded_domain_present == 1
    with pytest.raises(ValueError):
        P.augment(f, names, "e9")


SCORED = "source1_id string, target_source string, target_id string, raw_score double, calibrated_score double, country_conflict int, strong_evidence_count int, combined_evidence_count int, address_token_jaccard double, label int"


def scored(spark, rows):
    return spark.createDataFrame([(s, t[:2], t, x, x, c, g, k, 0.5, 0) for s, t, x, c, g, k in rows], SCORED)


def test_decisions(spark):
    rows = scored(spark, [("a", "S2_1", 0.9, 0, 1, 1), ("a", "S2_2", 0.9, 1, 1, 1), ("a", "S2_3", 0.2, 1, 0, 0), ("a", "S2_4", 0.9, 0, 0, 1)])
    got = {r.target_id: (r.decision, r.decision_reason) for r in D.decide(rows, 0.86, need_strong=True).collect()}
    assert got == {"S2_1": ("MATCH", "threshold_pass"), "S2_2": ("NON_MATCH", "country_conflict_veto"), "S2_3": ("NON_MATCH", "below_threshold"), "S2_4": ("NON_MATCH", "missing_strong_evidence_veto")}


RESCUE = D.S1Policy(argmax_rescue=True)
STRONG = D.S1Policy(argmax_rescue=True, need_strong=True)


@pytest.mark.parametrize(
    ("policy", "candidates", "want"),
    [
        (D.S1Policy(), [("S2-1", 0.95, 0, 0, 1), ("S2-2", 0.80, 0, 0, 1)], [("S2-1", "MATCH", "global_threshold", 0.95, 0.15, False)]),
        (D.S1Policy(), [("S2-1", 0.85, 0, 0, 1), ("S2-2", 0.60, 0, 0, 1)], [(None, "NO_MATCH", "below_global_threshold", 0.85, 0.25, False)]),
        (D.S1Policy(), [("S2-1", 0.95, 0, 0, 1), ("S2-2", 0.90, 0, 0, 1)], [("S2-1", "MATCH", "global_threshold", 0.95, 0.05, False), ("S2-2", "MATCH", "global_threshold", 0.90, 0.05, False)]),
        (RESCUE, [("S2-1", 0.85, 0, 0, 1), ("S2-2", 0.70, 0, 0, 1)], [("S2-1", "MATCH", "s1_argmax_rescue", 0.85, 0.15, True)]),
        (RESCUE, [("S2-1", 0.80, 0, 0, 1), ("S2-2", 0.78, 0, 0, 1)], [(None, "NO_MATCH", "rescue_margin_too_small", 0.80, 0.02, False)]),
        (RESCUE, [("S2-1", 0.90, 1, 0, 1)], [(None, "NO_MATCH", "rescue_country_conflict", 0.90, 0.90, False)]),
        (RESCUE, [("S2-1", 0.69, 0, 0, 1)], [(None, "NO_MATCH", "rescue_score_below_floor", 0.69, 0.69, False)]),
        (RESCUE, [("S2-1", 0.80, 0, 0, 0)], [(None, "NO_MATCH", "rescue_insufficient_evidence", 0.80, 0.80, False)]),
        (STRONG, [("S2-1", 0.82, 0, 2, 1), ("S2-2", 0.70, 0, 0, 1)], [("S2-1", "MATCH", "s1_argmax_rescue", 0.82, 0.12, True)]),
        (STRONG, [("S2-1", 0.82, 0, 0, 1), ("S2-2", 0.70, 0, 0, 1)], [(None, "NO_MATCH", "rescue_missing_strong_evidence", 0.82, 0.12, False)]),
        (D.S1Policy(), [], [(None, "NO_MATCH", "no_candidates", None, None, False)]),
    ],
)
def test_s1_policy(spark, policy, candidates, want):
    rows = scored(spark, [("S1-1", *c) for c in candidates]) if candidates else spark.createDataFrame([], SCORED)
    s1 = spark.createDataFrame([("S1-1",)], "source1_id string")
    got = D.s1_policy(rows, policy, s1).orderBy(F.col("calibrated_score").desc()).collect()
    assert [(r.target_id, r.decision, r.reason, r.calibrated_score, None if r.margin is None else round(r.margin, 6), r.rescue_used) for r in got] == want


def test_margins(spark):
    rows = scored(spark, [("b", "S2_1", 0.8, 0, 1, 2), ("b", "S2_2", 0.6, 0, 1, 2), ("d", "S2_1", 0.6, 0, 1, 2)])
    m = {(r.source1_id, r.target_id): r.margin for r in D.margins(rows).collect()}
    assert m["b", "S2_2"] == pytest.approx(0.2) and m["d", "S2_1"] == pytest.approx(0.6)


ERROR = "country_conflict int, strong_evidence_count int, name_jaro_winkler double, name_token_jaccard double, address_token_jaccard double, blocking_hit_count int, domain_exact int, alias_exact int"


def kinds(spark, column, rows):
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {ERROR}")
    return [r[1] for r in sorted(d.select("k", column).collect())]


def test_error_kinds(spark):
    none = (None,) * 8
    causes = [none, (1, 1, 1.0, 1.0, 1.0, 1, 0, 0), (0, 1, 0.95, 0.9, 0.5, 1, 0, 0), (0, 0, 0.95, 0.95, 0.0, 1, 0, 0), (0, 0, 0.40, 0.20, 0.10, 1, 0, 0), (0, 0, 0.85, 0.2, 0.0, 1, 0, 0), (0, 0, 0.85, 0.6, 0.1, 1, 0, 0), (0, 0, 0.96, 0.1, 0.2, 1, 0, 0), (0, 1, 0.5, 0.95, 0.0, 1, 0, 0)]
    assert kinds(spark, V.fn_cause(), causes) == ["1_BLOCKING_MISS", "6_COUNTRY_CONFLICT", "2_STRONG_EVIDENCE_BELOW_THRESHOLD", "5_ADDRESS_CONFLICT", "3_WEAK_EVIDENCE", "5_ADDRESS_CONFLICT", "7_OTHER", "2_STRONG_EVIDENCE_BELOW_THRESHOLD", "5_ADDRESS_CONFLICT"]
    fp = [(1, 1, 1.0, 1.0, 1.0, 1, 1, 1), (0, 1, 1.0, 1.0, 0.1, 1, 1, 0), (0, 1, 1.0, 1.0, 0.1, 1, 0, 1), (0, 1, 0.96, 0.8, 0.4, 1, 0, 0), (0, 1, 0.7, 0.1, 0.8, 1, 0, 0), (0, 0, 0.9, 0.5, 0.6, 1, 0, 0), (0, 1, 0.96, 0.8, 0.5, 1, 0, 0)]
    assert kinds(spark, V.fp_kind(), fp) == ["country_conflict", "alias_or_domain_collision", "alias_or_domain_collision", "name_collision", "address_collision", "weak_evidence", "generic_pairwise_false_positive"]
    fn = [(0, 0, 0.0, 0.0, 0.0, 0, 0, 0), (1, 1, 1.0, 1.0, 1.0, 1, 1, 0), (0, 1, 0.0, 0.0, 0.0, 1, 0, 1), (0, 0, 1.0, 1.0, 1.0, 1, 0, 0), (0, 1, 1.0, 1.0, 1.0, 1, 0, 0)]
    assert kinds(spark, V.fn_kind(), fn) == ["blocking_miss", "country_conflict", "strong_identity_below_threshold", "weak_evidence", "generic_pairwise_false_negative"]


def test_rescue_simulation(spark):
    rows = spark.createDataFrame([(0.99, 1, 1), (0.85, 1, 1), (0.75, 1, 1), (0.10, 0, 1), (0.40, 0, 1), (0.95, 0, 0)], "calibrated_score double, label int, strong_evidence_count int")
    got = {r.rescue_threshold: r for r in V.rescue(rows, 0.875).collect()}
    assert sorted(got) == [0.5, 0.6, 0.7, 0.75, 0.8, 0.825, 0.85, 0.875]
    assert (got[0.7].additional_tp_recovered, got[0.7].introduced_fp, got[0.7].rescue_precision, got[0.7].safe) == (2, 0, 1.0, True)
    assert (got[0.875].additional_tp_recovered, got[0.875].rescue_precision) == (0, 1.0)
    s = {r.label: r for r in V.strong_scores(rows).collect()}
    assert s[1]["count"] == 3 and s[0]["count"] == 2 and s[0]["max"] == 0.40 and s[1]["median"] == 0.85


def test_score_bands(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.8999, 0.9, 0.95, 0.99, 0.995, 0.999, 1.0, None)], "s double")
    assert [r[0] for r in d.select(V.score_band(F.col("s"))).collect()] == ["<0.90", "<0.90", "0.90-0.95", "0.95-0.99", "0.99-0.995", "0.995-0.999", "0.999-1.0", "0.999-1.0", "<0.90"]


def test_evaluated_s1(spark):
    f = spark.createDataFrame([("S1-2",), ("S1-2",), (" ",)], "source1_id string")
    s1, other = (spark.createDataFrame([(x,) for x in ids], "entity_id string") for ids in (["S1-1", "S1-2", ""], ["S1-9"]))
    ids = lambda d: sorted(r.source1_id for r in d.collect())
    assert ids(V.evaluated_s1(f, s1)) == ["S1-2"] and ids(V.evaluated_s1(f.limit(0), s1)) == ["S1-1", "S1-2"]
    assert ids(V.evaluated_s1(f, s1, "file")) == ["S1-1", "S1-2"] and ids(V.evaluated_s1(f, s1, "file", other)) == ["S1-9"]


def test_channels_and_hardness(spark):
    names = ["alias_exact_country", "translit_prefix_country", "house_postal_countryless", "name_exact_country", "street_prefix_country_smart_overflow", "name_char4_country", "domain_country"]
    d = spark.createDataFrame(list(enumerate(names)), "k int, s string")
    assert [r[1] for r in sorted(d.select("k", B.channel(F.col("s"))).collect())] == ["alias_channel", "transliteration_channel", "country_fallback_channel", "smart_capping_subkeys", "smart_capping_subkeys", "smart_capping_subkeys", "other"]
    row = spark.createDataFrame([(0.9, 0.5, 0.4, 0.3, 0.2, 1.0, 0.0, 3)], "name_jaro_winkler double, name_token_jaccard double, name_char4_jaccard double, address_token_jaccard double, address_char4_jaccard double, domain_jaccard double, alias_jaccard double, combined_evidence_count int")
    assert row.select(P.hardness()).first()[0] == pytest.approx(0.65 + 0.25 * 3.3 / 7 + 0.1 * 3 / 9)


def by_strategy(spark, column, rec):
    out = {}
    for r in recs(spark, [rec]).select(F.explode(column).alias("k")).select("k.*").collect():
        out.setdefault(r.strategy, []).append(r.key)
    return out


def test_older_keys(spark):
    k = by_strategy(spark, B.old_keys(), ("S1-505333132", "Clemons Silver Eastern Inc aka Halodelta", "1619 Julia Park Drive, Spring, TX 77386", "US"))
    assert set(k) == {"exact_name", "exact_addr", "exact_name_addr", "name_prefix", "street_prefix", "name_4grams", "addr_4grams", "hn_postal", "dba_alias"}
    assert k["hn_postal"] == ["us_hnpc_1619_77386"] and k["name_prefix"] == ["us_np_clemon"] and k["street_prefix"] == ["us_sp_1619juli"]
    k = by_strategy(spark, B.old_keys(), ("S2-001", "Alpha Omega Enterprises", "100 Main Street, Dallas, TX 75201", "US"))
    assert k["exact_name"] == ["us_en_alpha omega enterprises"] and k["exact_addr"] == ["us_ea_100 main st dallas tx 75201"]
    assert k["exact_name_addr"] == ["us_ena_alpha omega enterprises_100 main st dallas tx 75201"]
    k = by_strategy(spark, B.old_keys(), ("S3-101", "Pharmacie Lafayette", "12 Boulevard Haussmann, Paris 75009", "France"))
    assert "fr_n4g_phar" in k["name_4grams"] and "fr_a4g_haus" in k["addr_4grams"]
    rec = ("S1-999", "Acme Corp aka Acme Logistics (www.acme-corp.com)", "59/101 MG Road, Bangalore 560001", "India")
    k = by_strategy(spark, B.old_keys(), rec)
    assert "in_hnpc_59/101_560001" in k["hn_postal"] and k["domain"] == ["in_dom_acme-corp"] and any("acme logistics" in x for x in k["dba_alias"])
    k = by_strategy(spark, B.classic_keys(), rec)
    assert k["postal_name"] == ["in_p_560001", "in_p_560001_acm"] and k["name_prefix"] == ["in_np_acmeco"]
    assert {"in_hn_59/101", "in_h_59_59 1"} <= set(k["address_core"]) and "in_hn_59" not in k["address_core"]
    assert k["name_token"] == ["in_n_acme", "in_n_aka"] and k["address_token"] == ["in_at_bangalore"]
    assert k["domain_alias"][0] == "in_dom_acme-corp" and "in_alias_logistics" in k["domain_alias"]


def test_aliases_come_one_by_one(spark):
    got = recs(spark, [("S2_1", "Alpha Beta dba Gamma Delta", "1 A Road", "US")]).select(F.explode(B.keys()).alias("k")).select("k.*").collect()
    alias = [(r.strategy, r.key) for r in got if r.strategy.startswith("alias")]
    assert alias == [("alias_exact_country", "us|alpha beta"), ("alias_prefix_country", "us|alph"), ("alias_token_country", "us|alpha"), ("alias_token_country", "us|beta"), ("alias_exact_country", "us|gamma delta"), ("alias_prefix_country", "us|gamm"), ("alias_token_country", "us|gamma"), ("alias_token_country", "us|delta")]


def test_last_rows_win(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-2"], 5), ("S1-9", ["S2-1"], 2), ("S1-3", ["S2-2"], 7)], "source1_id string, target_ids array<string>, row_seq long")
    assert {r.target_id: r.source1_id for r in tsv.truth_inverse(lists).collect()} == {"S2-1": "S1-1", "S2-2": "S1-3"}
    f = spark.createDataFrame([("S1_1", "S2", "S2_1")], "source1_id string, target_source string, target_id string")
    names = spark.createDataFrame([("S1_1", "Zebra", 1), ("S1_1", "Acme", 2), ("S2_1", "Acme", 1), (" ", "x", 1)], "entity_id string, business_name string, seq int")
    assert P.augment(f, names, "e3", "seq").first().soft_token_coverage == 1.0 and P.augment(f, names).first().soft_token_coverage == 0.0


def test_competitive_and_promotion(spark):
    rows = scored(spark, [("a", "S2_1", 0.7, 0, 1, 2), ("a", "S2_2", 0.5, 0, 1, 2), ("b", "S2_1", 0.7, 0, 1, 2), ("b", "S2_2", 0.65, 0, 1, 2)])
    assert {(r.source1_id, r.target_id) for r in D.competitive(rows).collect()} == {("a", "S2_1")}
    assert D.promoted({"macro_f05": 0.8}, {"macro_f05": 0.81, "singleton_false_positives": 0})
    assert not D.promoted({"macro_f05": 0.8}, {"macro_f05": 0.81, "singleton_false_positives": 1})


EDGES = "source1_id string, target_source string, target_id string, calibrated_score double, decision string, country_conflict int"


def test_clusters_and_explicit_negatives(spark):
    chain = [("1", "S2", "10", 0.99, "MATCH", 0), ("2", "S2", "10", 0.98, "MATCH", 0), ("2", "S3", "20", 0.97, "MATCH", 0)]
    whole = C.clusters(spark.createDataFrame(chain, EDGES))
    assert whole.select("cluster_id").distinct().count() == 1 and whole.count() == 4
    cut = C.clusters(spark.createDataFrame([*chain, ("1", "S3", "20", 0.995, "NON_MATCH", 0)], EDGES))
    assert cut.select("cluster_id").distinct().count() == 2 and cut.count() == 4
    assert C.assignments(whole, 3).first().oversized == 1
    r = {x.source1_id: (x.s2_ids, x.s3_ids) for x in C.s1_resolution(whole).collect()}
    assert r == {"1": ("10", "20"), "2": ("10", "20")}
    assert C.closure(whole).count() == 4
    why = {x.edge_reason for x in C.edge_reasons(spark.createDataFrame([*chain, ("", "S2", "1", 1.0, "MATCH", 0), ("3", "S2", "1", 1.0, "MATCH", 1)], EDGES)).collect()}
    assert why == {"accepted", "missing_id", "country_conflict"}


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in components(e).collect()}
    assert len(got) == 63 and {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x"


def test_s1_scores(spark):
    s1 = spark.createDataFrame([(x,) for x in "abcd"], "source1_id string")
    p = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "9")], "source1_id string, target_id string")
    t = spark.createDataFrame([("a", "1"), ("b", "5")], "source1_id string, target_id string")
    got = {r.source1_id: (r.precision, r.recall, round(r.f, 6)) for r in V.s1_scores(s1, p, t).collect()}
    assert got == {"a": (0.5, 1.0, 0.555556), "b": (0.0, 0.0, 0.0), "c": (0.0, 1.0, 0.0), "d": (1.0, 1.0, 1.0)}
    c = V.cohort(V.s1_scores(s1, p, t)).first()
    assert (c.pair_tp, c.pair_fp, c.pair_fn, c.singletons, c.singleton_false_positives) == (1, 2, 1, 2, 1)


def test_sweep_equals_metrics_at_each_threshold(spark):
    s1 = spark.createDataFrame([(f"s{i}",) for i in range(8)], "source1_id string")
    rows = [(f"s{i % 6}", f"t{j}", round(((i * 7 + j * 3) % 21) / 20, 3)) for i in range(6) for j in range(4)]
    sc = spark.createDataFrame(rows, "source1_id string, target_id string, score double")
    truth = spark.createDataFrame([("s0", "t0"), ("s1", "t1"), ("s1", "t2"), ("s7", "t9")], "source1_id string, target_id string")
    got = {round(r.threshold, 6): r for r in V.sweep(sc, s1, truth, 11).collect()}
    for i in (0, 3, 5, 9, 10):
        c = V.cohort(V.s1_scores(s1, sc.where(F.col("score") >= i / 10), truth)).first()
        r = got[i / 10]
        assert (r.macro_precision, r.macro_recall, r.macro_f05) == pytest.approx((c.macro_precision, c.macro_recall, c.macro_f05))
        assert (r.pair_tp, r.pair_fp, r.pair_fn, r.singleton_false_positives) == (c.pair_tp, c.pair_fp, c.pair_fn, c.singleton_false_positives)


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 10)], "v int")
    val = lambda kind: [r.value for r in V.percentiles(df, "v", (0.5, 0.9), kind).orderBy("q").collect()]
    assert val("linear") == pytest.approx([2.0, 7.2]) and val("nearest") == [2.0, 10.0] and val("floor") == [2.0, 10.0] and val("ceil") == [2.0, 10.0]


def test_leakage_and_population(spark):
    parts = spark.createDataFrame([("a", "train", 0), ("a", "holdout", -1), ("b", "train", 1)], "source1_id string, role string, fold int")
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", "2")], "source1_id string, target_id string")
    got = {r.check: r.violations for r in V.leakage(parts, p).collect()}
    assert got == {"s1_overlap": 1, "missing_population": 1, "threshold_on_holdout": 0, "shared_targets": 1}
    lists = spark.createDataFrame([("a", ["1"]), ("b", [])], "source1_id string, target_ids array<string>")
    with pytest.raises(ValueError):
        V.check_population(V.population(lists, p.where("source1_id = 'z'")))
    V.check_population(V.population(lists, p))


def test_roles_are_disjoint_and_stable(spark):
    s = spark.range(1000).select(F.concat(F.lit("S1-"), "id").alias("source1_id"))
    r = V.roles(s)
    assert r.count() == 1000 and 100 < r.where("role = 'holdout'").count() < 200
    assert r.where("(role = 'holdout') <> (fold = -1)").count() == 0 and {x.fold for x in r.select("fold").distinct().collect()} == {-1, 0, 1, 2, 3, 4}


def test_train_calibrate_and_store(spark, tmp_path):
    rows = [(f"s{i}", "S2", f"t{i}", int(i % 3 == 0), 0.5 + 0.5 * (i % 3 == 0) - 0.01 * (i % 7), float(i % 5)) for i in range(300)]
    f = spark.createDataFrame(rows, "source1_id string, target_source string, target_id string, label int, x double, y double")
    m = L.fit_logistic(f, ("x", "y"))
    assert m.weights[0] > 0
    m = L.calibrate(m, f, 0.99, steps=101)
    m.save(str(tmp_path / "m.json"))
    again = L.Linear.load(str(tmp_path / "m.json"))
    got = again.score(f).select(F.col("calibrated_score").alias("score"), "label")
    c = V.confusion(got, again.threshold).first()
    assert c.precision == 1.0 and c.recall == 1.0
    r = V.ranking(got).first()
    assert r.average_precision == pytest.approx(1.0) and r.roc_auc == pytest.approx(1.0)


def test_tsv_dialects(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""x""\tB"\t1 Road\tUS\nS1-2\tC\t\t\n', encoding="utf-8")
    got = [tuple(r) for r in tsv.read_quoted(spark, str(p)).collect()]
    assert got == [("S1-1", 'A "x"\tB', "1 Road", "US"), ("S1-2", "C", "", "")]
    q = tmp_path / "b.tsv"
    q.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t A \t1 Road\tUS\r\n\nS2-2\tB\n")
    plain = tsv.read_plain(spark, str(q))
    assert [tuple(r) for r in plain.collect()] == [("S1-1", "A", "1 Road", "US"), ("S2-2", "B", "", "")]
    assert [len(c) for c in tsv.chunks(tsv.scan(spark.range(5).select(F.lit("US").alias("country")), "US", 5), 2)] == [2, 2, 1]
    assert tsv.check_headers(spark, {"S1": str(q)}) == [] and tsv.check_headers(spark, {"S1": str(tmp_path / "none")})


def test_truth_and_candidates(spark):
    t = spark.createDataFrame([("S1-1", "S2-1, S3-2,S2-1"), ("S1-2", ""), ("S1-3", "S2-1;X-9")], "source1_entity_id string, matched_entity_ids string")
    assert {(r.source1_id, r.target_id) for r in tsv.truth_pairs(t, ",;|", "drop").collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-3", "S2-1")}
    assert {r.target_source for r in tsv.truth_pairs(t, ",;", "S3").where("target_id = 'X-9'").collect()} == {"S3"}
    wide = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    assert tsv.read_candidates(wide).count() == 2
    with pytest.raises(ValueError):
        tsv.read_candidates(t)


def test_submission(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "source1_entity_id string, row_seq long")
    p = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "source1_id string, target_id string")
    sinks.write_submission(s1, p, str(tmp_path / "out"))
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).na.fill("").collect()]
    assert sorted(rows) == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    m = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-9", ["S2-7"])], "source1_entity_id string, ids array<string>")
    c = spark.createDataFrame([("S1-1", ["S2-1"])], "source1_entity_id string, ids array<string>")
    t = spark.createDataFrame([("S2-1",)], "entity_id string")
    assert sinks.submission_faults(s1, m, c, t) == {"s1_missing": 1, "s1_unknown": 1, "s1_repeated": 0, "match_not_candidate": 1, "unknown_target": 1}


def test_calibrations(spark):
    rows = spark.createDataFrame([(x / 10, int(x > 4) if x not in (3, 6) else int(x == 3)) for x in range(11)] * 5, "raw_score double, label int")
    none, platt, iso = (L.fit_calibration(rows, m) for m in ("none", "platt", "isotonic"))
    at = spark.createDataFrame([(x,) for x in (-0.5, 0.0, 0.25, 0.5, 0.55, 1.0, 1.5)], "raw_score double")
    value = lambda c: [r[0] for r in at.select(c.of(F.col("raw_score"))).collect()]
    assert value(none) == [-0.5, 0.0, 0.25, 0.5, 0.55, 1.0, 1.5]
    got = value(iso)
    assert got == sorted(got) and got[0] == got[1] == 0.0 and got[-1] == got[-2] == 1.0
    xs, ys = [k[0] for k in iso.knots], [k[1] for k in iso.knots]
    k = max(i for i, x in enumerate(xs) if x <= 0.55)
    assert got[4] == pytest.approx(ys[k] + (ys[k + 1] - ys[k]) * (0.55 - xs[k]) / (xs[k + 1] - xs[k]))
    assert value(platt) == sorted(value(platt)) and 0 < value(platt)[0] < value(platt)[-1] < 1
    with pytest.raises(ValueError):
        L.fit_calibration(rows.where("label = 1"), "isotonic")
    with pytest.raises(ValueError):
        L.fit_calibration(rows, "other")


def test_isotonic_and_boosted_models_are_stored(spark, tmp_path):
    rows = [(f"s{i}", "S2", f"t{i}", int(i % 3 == 0), 0.5 + 0.5 * (i % 3 == 0) - 0.01 * (i % 7), float(i % 5)) for i in range(300)]
    f = spark.createDataFrame(rows, "source1_id string, target_source string, target_id string, label int, x double, y double")
    for model, load, name in ((L.fit_logistic(f, ("x", "y")), L.Linear.load, "a.json"), (L.fit_boosted(f, ("x", "y"), trees=3), L.Boosted.load, "b")):
        model = L.calibrate(model, f, 0.9, steps=101, method="isotonic")
        path = str(tmp_path / name)
        model.save(path)
        again = load(path)
        assert again.threshold == model.threshold and again.calibration == model.calibration
        a, b = ([tuple(r) for r in m.score(f).select("target_id", "raw_score", "calibrated_score").orderBy("target_id").collect()] for m in (model, again))
        assert a == b
        c = V.confusion(again.score(f).select(F.col("calibrated_score").alias("score"), "label"), again.threshold).first()
        assert c.precision >= 0.9 and c.recall > 0.9


def test_hot_nodes_of_components(spark, monkeypatch):
    from entitylink.operators import components as cc

    monkeypatch.setattr(cc, "MANY", 20)
    e = spark.createDataFrame([("hub", f"n{i:03d}") for i in range(200)] + [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(30)], "a string, b string")
    got = {r.node: r.component for r in cc.components(e).collect()}
    assert {got[f"n{i:03d}"] for i in range(200)} == {"hub"} and {got[f"x{i:03d}"] for i in range(31)} == {"x000"}


def test_profiles_count_blank_and_malformed_lines(spark, tmp_path):
    from entitylink.operators import profile as R

    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A\tB"\t1 Road\tUS\n\n \t \nS1-2\tC\nS1-3\tD\t\tUS\textra\nS1-4\tE e\t2 Road\tIN\n', encoding="utf-8")
    got = R.file_profile(tsv.lines(spark, str(p)))
    assert (got["rows"], got["empty_rows"], got["malformed_rows"], got["distinct_ids"]) == (2, 2, 2, 2)
    assert got["country_counts"] == {"US": 1, "IN": 1} and got["business_name_tokens_max"] == 2.0


def test_quoted_files_are_split_unless_cells_hold_line_ends(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for name, body, want in (("a", 'S1-1\t"A ""x"" B"\t1\tUS\n', [("S1-1", 'A "x" B', "1", "US")]), ("b", 'S1-1\t"A\nB"\t1\tUS\n', [("S1-1", "A\nB", "1", "US")])):
        (tmp_path / name).write_text(head + body)
        assert [tuple(r) for r in tsv.read_quoted(spark, str(tmp_path / name)).collect()] == want


def test_submissions_are_one_file(spark, tmp_path):
    s1 = spark.range(500).select(F.concat(F.lit("S1-"), 500 - F.col("id")).alias("source1_entity_id"), F.col("id").alias("row_seq")).repartition(7)
    p = spark.createDataFrame([("S1-7", "S2-1"), ("S1-7", "S3-2")], "source1_id string, target_id string")
    sinks.write_submission(s1, p, str(tmp_path / "out.tsv"))
    lines = (tmp_path / "out.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{500 - i}" for i in range(500)] and "S1-7\tS2-1,S3-2" in lines


def test_scratch_folders_must_be_shared(spark, monkeypatch):
    from entitylink.sources import scratch

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
    t = scratch.kept(spark.range(3).toDF("k"), "t")
    assert t.count() == 3 and scratch.exists(spark, t.inputFiles()[0].rsplit("/", 1)[0])
    scratch.drop(t)
    assert scratch.size(spark, __file__) > 100


def test_net_new_pairs_and_index_report(spark):
    s1, t = sides(recs(spark, BASIC))
    base, full = B.candidates(s1, t, 50, B.ABLATION["B0"]).where("target_id <> 'S3_1'"), B.candidates(s1, t, 50)
    got = {r.strategy: (r.channel, r.n) for r in B.net_new(full, base).collect()}
    assert got["name_exact_country"] == ("smart_capping_subkeys", 1)
    r = B.key_report(B.postings(t)).first()
    assert r.entities == 3 and r.entries > r.keys > 10
    found = pairs(B.candidates(s1, None, 50, index=(B.postings(t), B.buckets(B.postings(t), 50))))
    assert found.keys() == pairs(full).keys()


def test_closure_metrics_without_pairs(spark):
    """Equal to the metrics of the pairs themselves, where a target's id is in two sources and clusters, and where nothing is."""
    nodes = [("c1", "S1", "a"), ("c1", "S1", "b"), ("c1", "S2", "x"), ("c1", "S3", "x"), ("c1", "S3", "y"), ("c2", "S1", "c"), ("c2", "S2", "y"), ("c2", "S2", "z")]
    gt = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "z"), ("c", "y"), ("d", "x")], "source1_id string, target_id string")
    for rows in (nodes, []):
        n = spark.createDataFrame(rows, "cluster_id string, source string, entity_id string")
        assert C.closure_metrics(n, gt).collect() == C.pair_metrics(C.closure(n), gt).collect()


def test_edits_equal_levenshtein(spark):
    import random

    from entitylink.functions.similarity import edits

    r = random.Random(1)
    word = lambda: "".join(r.choice("abéß 😀") for _ in range(r.randrange(90)))
    rows = [(word(), word()) for _ in range(300)] + [(w, w[:9] + "x" + w[11:]) for w in (word() for _ in range(100))] + [("", ""), ("a", ""), ("", "ab")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("n")).collect()
    assert [edits(x.a, x.b) for x in got] == [x.n for x in got]
