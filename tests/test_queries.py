"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from entitylink.plans import oracle, queries

ALL = sorted(queries.QUERIES)


def rows(cols, data):
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    return sorted((tuple(0.0 if v == 0 else v for v in (r[i] for i in at)) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n in ALL if n in oracle.SQL])
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cur = duck.execute(oracle.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(cols, cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6))


def test_channels_find_names_of_other_scripts(spark, tmp_path):
    """Names are folded as Unicode and transliterated, in the code and in the SQL: Cyrillic meets Latin, Hangul and full-width letters their like."""
    import duckdb

    said = ["Ромашка", "romashka", "लोटस मीडिया", "lottas miiddiyaa", "서울 상회", "서울", "ＡＢＣ Ｗａｒｅ", "abc ware", "Žižkov Łódź", "zizkov łodz", "Московская 'щука' ЁЛКА", "moskovskaya", "ﬁne İstanbul ½", "fine i̇stanbul 1 2"]
    made = [(21 * k + 2, f"{name}. {'улица ' + name if k > 5 else ''}. x", "印度" if k % 4 > 1 else "ИНДИЯ", f"src{k % 2}") for k, name in enumerate(said)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.channel: r.n for r in queries.QUERIES["channel_counts"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(oracle.SQL["channel_counts"]).fetchall())
    assert got["transliteration_channel"] > 0 and got["smart_capping_subkeys"] > 0


#: Rows that a query without SQL gives at least, and what must hold of each.
OTHERS = {
    "augmented_evidence": lambda r: 0 <= r.combined_name_domain_evidence <= 1,
    "boosted_scores": lambda r: 0 <= r.raw_score <= 1 and 0 <= r.calibrated_score <= 1,
    "cluster_assignments": lambda r: r.cluster_id.startswith("ENT-") and r.node_count == r.s1_count + r.target_count,
    "fn_causes": lambda r: r.cause[0] in "123567" and r.n > 0,
    "fn_taxonomy": lambda r: r.n > 0,
    "fp_taxonomy": lambda r: r.n > 0,
    "hard_negatives": lambda r: 0 <= r.hardness <= 1,
    "hash_split": lambda r: (r.role == "holdout") == (r.fold == -1),
    "logistic_scores": lambda r: 0 <= r.raw_score <= 1 and 0 <= r.calibrated_score <= 1,
    "normalize_older": lambda r: r.n_char3 >= 0,
    "out_of_fold_scores": lambda r: 0 <= r.calibrated_score <= 1 and (r.role == "holdout") == (r.fold == -1),
    "pair_features_fast": lambda r: 0 <= r.name_jaro_winkler <= 1,
    "pair_features_jaro": lambda r: 0 <= r.name_jaro_winkler <= 1,
    "secondary_evidence": lambda r: all(0 <= r[c] <= 1 for c in queries.S.SECONDARY),
    "training_sample": lambda r: r.label in (0, 1),
    "transliterate": lambda r: r.latin.startswith("lottas middiyaa Media ") or r.latin.isascii(),
}


def test_every_query_is_tested():
    assert set(OTHERS) == set(ALL) - set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_query_holds(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).collect()
    assert got and all(OTHERS[name](r) for r in got)


def test_jaro_and_taxonomies_equal_plain_python(spark, sf):
    f = queries.QUERIES["pair_features_jaro"](spark, sf).collect()
    name = {r.entity_id: r.name_core for r in queries._normal(spark, sf).collect()}
    for r in f[::7]:
        assert r.name_jaro_winkler == round(queries.S.jaro_winkler(name[r.source1_id], name[r.target_id]), 8)
    score = lambda r: math.floor((r.name_edit_similarity + r.address_token_jaccard) / 2 * 1e6 + 0.5) / 1e6

    def kind(r):
        if r.country_conflict:
            return "country_conflict"
        if r.domain_exact or r.alias_exact:
            return "alias_or_domain_collision"
        if r.name_jaro_winkler >= 0.95 and r.name_token_jaccard >= 0.8 and r.address_token_jaccard < 0.5:
            return "name_collision"
        if r.address_token_jaccard >= 0.8 and r.name_jaro_winkler < 0.8:
            return "address_collision"
        return "weak_evidence" if r.strong_evidence_count <= 0 else "generic_pairwise_false_positive"

    assert {r.kind: r.n for r in queries.QUERIES["fp_taxonomy"](spark, sf).collect()} == Counter(kind(r) for r in f if r.label == 0 and score(r) >= 0.5)
    found = {(r.source1_id, r.target_id): score(r) for r in f}
    missed = [p for p in ((r.source1_id, r.target_id) for r in queries.truth(queries.records(spark, sf)).collect()) if found.get(p, 0) < 0.6]
    causes = {r.cause: r.n for r in queries.QUERIES["fn_causes"](spark, sf).collect()}
    assert sum(causes.values()) == len(missed) and causes.get("1_BLOCKING_MISS", 0) == sum(p not in found for p in missed) > 0
    assert sum(r.n for r in queries.QUERIES["fn_taxonomy"](spark, sf).collect()) == sum(p in found for p in missed) > 0


def test_queries_run_with_the_production_settings(spark, sf, monkeypatch):
    assert (queries.CAP, queries.FAST) == (500, 50)
    seen = {}
    sweep, candidates = queries.V.sweep, queries.B.candidates
    monkeypatch.setattr(queries.V, "sweep", lambda scored, s1, gt, steps=401: sweep(scored, s1, gt, seen.setdefault("steps", steps)))
    monkeypatch.setattr(queries.B, "candidates", lambda s1, t, cap, *rules: candidates(s1, t, seen.setdefault("cap", cap), *rules))
    monkeypatch.setattr(queries.L, "out_of_fold", lambda f, parts, folds=5: seen.update(folds=folds, last=parts.agg({"fold": "max"}).first()[0]) or [f.crossJoin(parts.drop("source1_id").limit(1)).selectExpr("*", "0.0 AS raw_score", "0.0 AS calibrated_score")])
    assert queries.QUERIES["threshold_choice"](spark, sf).columns == ["threshold", "macro_precision", "macro_f05"]
    queries.QUERIES["out_of_fold_scores"](spark, sf)
    assert seen == {"steps": 401, "cap": 500, "folds": 5, "last": 4}


@pytest.mark.parametrize("cap", [2, 7])
def test_small_caps_equal_sql(spark, sf, duck, cap):
    """Capping and overflow searches, which the sample tables are too small for at the production cap."""
    s1, t = queries._sides(queries._normal(spark, sf))
    got = {tuple(r) for r in queries.B.candidates(s1, t, cap).select(*queries.PAIR, "strategy", "hits").collect()}
    want = duck.execute("WITH RECURSIVE " + oracle._engine(cap) + f" SELECT {', '.join(queries.PAIR)}, strategy, hits FROM cand").fetchall()
    assert got == set(want)


@pytest.mark.parametrize("size", [100, 1 << 17])
def test_candidates_shuffle_no_pairs(spark, sf, duck, size, monkeypatch):
    """Pairs, counts and lists come from the tasks that hold the index, range by range of targets; no exchange holds pairs."""
    monkeypatch.setattr("entitylink.operators.probe.RANGE", size)
    s1, t = queries._sides(queries._normal(spark, sf))
    p = queries.B.probe(s1, t, 7)
    pairs = p.pairs()
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    got = {tuple(r) for r in pairs.select(*queries.PAIR, "strategy", "hits").collect()}
    want = duck.execute("WITH RECURSIVE " + oracle._engine(7) + f" SELECT {', '.join(queries.PAIR)}, strategy, hits FROM cand").fetchall()
    assert got == set(want)
    assert sum(r.n for r in p.counts().collect()) == len(want)
    lists = {r.source1_id: r.ids for r in p.lists_of_ids(s1.selectExpr("entity_id AS source1_id", "0 AS row_seq")).collect()}
    assert len(lists) == s1.count()
    assert lists == {i: ",".join(sorted(r[2] for r in want if r[0] == i)) for i in lists}
    wanted = queries.truth(queries.records(spark, sf))
    assert {tuple(r) for r in p.pairs(queries.PAIR, wanted).collect()} == {tuple(r) for r in wanted.collect()} & {r[:3] for r in got}


@pytest.mark.parametrize("least, size", [(0.3, 1 << 17), (0.5, 100), (0.55, 1 << 17), (0.6, 1 << 17)])
def test_bounds_of_scores_lose_no_pair(spark, sf, least, size, monkeypatch):
    """The pairs above a score are those of all candidates, with the same scores, and most others never get features."""
    monkeypatch.setattr("entitylink.operators.probe.RANGE", size)
    key = ("source1_id", "target_source", "target_id", "label", "score", "country_conflict", "name_jaro_winkler")
    got = queries._scored(spark, sf, *key[-2:], least=least)
    want = queries._scored(spark, sf, *key[-2:])
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.where(f"score >= {least}").select(*key).collect()))
    s1, t = queries._sides(queries._normal(spark, sf))
    held = queries.B.probe(s1, t, queries.CAP).pairs([*queries.PAIR, "edits"], like=(s1, t, least)).count()
    assert got.count() <= held < want.count() / 4


@pytest.mark.parametrize("base, rescue, margin, size", [(0.7, 0.4, 0.10, 1 << 17), (0.7, 0.4, 0.10, 60), (0.9, 0.3, 0.02, 60), (0.6, 0.35, 0.2, 1 << 17)])
def test_best_pairs_decide_as_all_do(spark, sf, base, rescue, margin, size, monkeypatch):
    """The competitive policy takes the same pairs from those that its index keeps as from all candidates, and some of them are rescued."""
    monkeypatch.setattr("entitylink.operators.probe.RANGE", size)
    key = ("country_conflict", "strong_evidence_count")
    every, some = queries._scored(spark, sf, *key), queries._scored(spark, sf, *key, least=base, best=(rescue, margin))
    for free in (False, True):  # with strong evidence for all pairs, more of them can be rescued
        take = lambda d: sorted(map(tuple, queries.D.competitive(d.withColumn("strong_evidence_count", queries.F.lit(1)) if free else d, base, rescue, margin).select(*queries.PAIR, "score").collect()))  # noqa: E731, B023
        got, want = take(some), take(every)
        assert got == want
    assert any(r[-1] < base for r in want) and some.count() < every.count() / 2


@pytest.mark.parametrize("size", [1 << 17, 40])
def test_a_best_pair_just_above_the_rescue_score_meets_those_below_it(tmp_path, size):
    """Of random names the best pair and whether another one is within the margin are those of all pairs, in one range and in several."""
    import random

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from entitylink.functions.similarity import edits
    from entitylink.operators.probe import _Looks

    rnd = random.Random(5)
    made = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 14)))
    names, words = [made() for _ in range(120)], [rnd.sample(range(12), 3) for _ in range(120)]
    pq.write_table(pa.table({"no": pa.array(range(120), pa.int32()), "name": names, "words": pa.array(words, pa.list_(pa.int64()))}), tmp_path / "looks.parquet")
    start, margin, least, rescued, near = 0.4, 0.10, 0.7, 0, 0

    def clear(scores) -> bool:
        scores = sorted(scores, reverse=True)
        return start <= scores[0] < least and (len(scores) == 1 or scores[0] - scores[1] >= margin)

    for _ in range(300):
        name, own = made(), rnd.sample(range(12), 3)
        score = lambda k: (len({*words[k]} & {*own}) / len({*words[k]} | {*own}) + 1 - edits(name, names[k]) / max(len(name), len(names[k]))) / 2  # noqa: B023, E731
        among = sorted(rnd.sample(range(120), 20))
        every = [score(k) for k in among]
        found = []
        for low in range(0, 120, size):
            got = np.array([k - low for k in among if low <= k < low + size], np.int64)
            looks = _Looks(str(tmp_path), low, min(size, 120 - low))
            t, _ = looks.top(got, name, np.array(own, np.int64), least, margin, start - margin * (size < 120), size >= 120)
            found += [score(k + low) for k in t.tolist()]
        assert clear(found or [0.0]) == clear(every)
        rescued += clear(every)
        near += start <= max(every) < start + margin and not clear(every)
    assert rescued > 10 and near > 10


def test_repeated_ids_keep_all_their_pairs(spark, sf, tmp_path):
    """A doc_id of two rows has two names; each scores for itself."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    d.unionByName(d.where("doc_id % 5 = 0").selectExpr("doc_id", "concat('x', text) AS text", *[c for c in d.columns if c not in ("doc_id", "text")])).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda d: Counter(map(tuple, d.select(*queries.PAIR, "score").collect()))
    want = queries._scored(spark, str(tmp_path))
    assert rows(queries._scored(spark, str(tmp_path), least=0.5)) == rows(want.where("score >= 0.5"))
    assert sum(r.n for r in queries.QUERIES["edge_reasons"](spark, str(tmp_path)).collect()) == want.count()


def test_evidence_of_many_names_equals_that_of_pairs():
    """Words of all lengths, copies of parts, characters that no other name has, domains with and without words."""
    import random

    import numpy as np

    from entitylink.functions.evidence import Evidence

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30, 31, 32, 40, 199, 210])))
    names = [" ".join(word() for _ in range(r.randrange(5))) + r.choice(["", " www.ab-ca.com", " abc.de x", "www.a.org"]) for _ in range(40)]
    e = Evidence(names)
    for left in [*names, "", "zz ß ǅ ab", "aaaa bbbb"]:
        assert np.array(e.of(left, np.arange(len(names)))).T.tolist() == [queries.S.pair_evidence(left, x) for x in names]


@pytest.mark.parametrize("size", [100, 1 << 17])
def test_augmented_evidence_is_that_of_all_pairs(spark, sf, tmp_path, monkeypatch, size):
    """In several ranges of targets, and where ids repeat: of those the largest name counts, for each of their rows."""
    monkeypatch.setattr("entitylink.operators.probe.RANGE", size)
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    d.unionByName(d.where("doc_id % 5 = 0").selectExpr("doc_id", "concat('x', text) AS text", *[c for c in d.columns if c not in ("doc_id", "text")])).write.parquet(f"{tmp_path}/documents.parquet")
    want = queries.P.augment(queries._features(spark, str(tmp_path), jaro=False).select(*queries.PAIR), queries.records(spark, str(tmp_path)).select("entity_id", "business_name"))
    got = queries.QUERIES["augmented_evidence"](spark, str(tmp_path))
    assert got.dtypes == want.dtypes and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    # no row of a pair is shuffled or sent to Python once more
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 0


def test_postal_codes_of_many_suppliers_equal_sql(spark, tmp_path):
    """Keys of five digits and more, as in larger tables, are not read as postal codes."""
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE supplier AS SELECT unnest([1, 999, 1000, 9999, 10000, 12345, 60000, 99999, 100000, 123456, 1234567, 12345678]::BIGINT[]) AS s_suppkey")
    c.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    got = queries.QUERIES["postal_codes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(oracle.SQL["postal_codes"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_task_holds_one_range(spark, sf, monkeypatch):
    """With several ranges, each task meets targets of one range only."""
    monkeypatch.setattr("entitylink.operators.probe.RANGE", 60)
    s1, t = queries._sides(queries._normal(spark, sf))
    p = queries.B.probe(s1, t, queries.CAP)
    d = p.pairs().join(queries.F.broadcast(p._numbers()), ["target_source", "target_id"]).select(queries.F.spark_partition_id().alias("task"), queries.F.expr("no div 60").alias("range"))
    got = d.distinct().collect()
    assert len({r.range for r in got}) == -(-p.n // 60) and len({r.task for r in got}) == len(got)
