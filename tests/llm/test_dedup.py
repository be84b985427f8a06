import numpy as np
import pytest

from entitylink.llm import hnsw, minhash, queries
from entitylink.llm.components import components


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark, scratch):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long"), scratch).collect()}
    want = union(pairs, {n for p in pairs for n in p})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "u long, v long"), scratch, "none").count() == 0


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    s = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(s) for b, y in s[k + 1 :] if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y)]
    comp = union(pairs, {i for i, _ in s if i is not None})
    return sorted((i if i is not None else -1, len(x), comp.get(i, -1)) for i, x in s)


def test_minhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op4_minhash_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [256, 4])
def test_minhash_groups_of_near_copies(spark, scratch, block, monkeypatch):
    """Star-shaped and chained groups, of which many members are not linked with the smallest one."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = [(100, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 6)):
            w[k] = f"n{rng.integers(0, 9)}"
        rows.append((int(i), " ".join(w)))
    rows += [(i, r[1].upper() + "\n") for i, r in enumerate(rows[:5], 500)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 85)


def test_minhash_odd_rows(spark, odd, empty, scratch):
    got = minhash.near_duplicates(odd, scratch).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows, 85)
    assert minhash.near_duplicates(empty, scratch).count() == 0


def test_long_texts_by_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000)).encode()
    b = np.frombuffer(text, np.uint8)
    ends = np.array([0, len(b)])
    whole = list(minhash.sets(b, ends))[0]
    monkeypatch.setattr(minhash, "PIECE", 999)
    assert (list(minhash.sets(b, ends))[0] == whole).all() and len(whole) == len(shingles(text.decode()))


def brute_vectors(rows, threshold):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label) for i, v, label in rows if ok(v, label)]
    pairs = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[k + 1 :] if p == q and len(x) == len(y) and x @ y >= threshold]
    n = {i: 0 for i, *_ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    comp = union(pairs, {i for i, *_ in rows})
    return {i: (n[i], comp[i]) for i, *_ in rows}


@pytest.mark.parametrize("shard", [4096, 60])
def test_vectors_against_brute_force(spark, scratch, shard):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(250):
        rows.append((i, rng.normal(size=16).tolist(), i % 2))
    for i in range(250, 330):  # a group of near copies, and exact and scaled ones
        rows.append((i, (np.array(rows[3][1]) + 0.05 * rng.normal(size=16)).tolist(), 1))
    rows += [(400, rows[3][1], 1), (401, [2 * x for x in rows[3][1]], 1), (402, rows[3][1], None), (403, None, 1), (404, [0.0] * 16, 1), (405, [None] + [1.0] * 15, 1), (406, [float("nan")] * 16, 1), (407, [1.0, 2.0], 1), (408, [], 1), (409, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, scratch, 0.98, shard).collect()}
    want = brute_vectors(rows, 0.98)
    assert set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_vectors_query_and_empty(spark, sf, scratch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op3_embedding_dedup(spark, sf).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), scratch).count() == 0


def test_audit_widens_to_the_exact_search():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x, 0.98)
    assert g.audit() >= hnsw.RECALL
    g.layers[0][:] = -1  # without links only the exhaustive search passes
    assert g.audit() >= hnsw.RECALL and g.beam >= 600


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """The plain join and the salted one give the same rows, for each way of joining."""
    from pyspark.sql import functions as F

    from entitylink.llm.common import hot_keys, meet

    many = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("hot"))
    one = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("salt"))
    sizes = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, ["k"])
    assert [r.k for r in hot] == [7] and hot_keys(sizes, ["k"], 10**6) == []
    for how in ("inner", "left"):
        got = meet(many, one, ["k"], hot, ["hot"], how=how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k", how).collect()))
    # the hot rows are spread: no partition of the exchange holds them all
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spread = meet(many, one.hint("merge"), ["k"], hot, ["hot"]).groupBy(F.spark_partition_id()).count()
    most = spread.agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 2000


def test_minhash_hot_groups_take_the_salted_way(spark, scratch, monkeypatch):
    from entitylink.llm import common

    monkeypatch.setattr(common.hot_keys, "__defaults__", (5,))
    from entitylink.llm import components as cc

    monkeypatch.setattr(cc, "HOT", 5)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 60)]
    rows = [(int(i), " ".join(base)) for i in range(30)] + [(40 + i, " ".join([*base, f"x{i}"])) for i in range(30)] + [(90 + i, "") for i in range(20)] + [(200 + i, f"one two three four five {i}") for i in range(9)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 85)


def test_vectors_of_hot_groups_and_odd_rows(spark, scratch, monkeypatch):
    from entitylink.llm import common

    monkeypatch.setattr(common.hot_keys, "__defaults__", (5,))
    rng = np.random.default_rng(8)
    v = rng.normal(size=8)
    rows = [(i, v.tolist(), 1) for i in range(40)] + [(50 + i, (v + 0.03 * rng.normal(size=8)).tolist(), 1) for i in range(40)] + [(100 + i, rng.normal(size=8).tolist(), 2) for i in range(20)] + [(5, v.tolist(), 1), (None, v.tolist(), 1), (None, None, 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, grp int")
    got = hnsw.near_duplicates(df, scratch, 0.98, 16).collect()
    assert len(got) == len(rows)
    want = brute_vectors([(k, x, y) for k, (_, x, y) in enumerate(rows)], 0.98)
    by = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in got)
    assert by == sorted((-1 if rows[k][0] is None else rows[k][0], n) for k, (n, _) in want.items())
    assert all(r.shard_recall is None or r.shard_recall >= hnsw.RECALL for r in got)
    assert {r.component_id for r in got if r.n_links} == {0}


def test_links_found_from_either_end_count_for_both():
    rng = np.random.default_rng(2)
    a, b = rng.random((300, 77)) < 0.1, rng.random((77, 300)) < 0.1
    got = np.zeros((300, 77), bool)
    for at, r, c in hnsw.either(np.packbits(a, axis=1), np.packbits(b, axis=1), 300, 77):
        got[r + at, c] = True
    assert (got == (a | b.T)).all()


def test_graphs_come_back_from_their_files():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x, 0.9)
    one = np.zeros(500, np.int64)
    h, z = hnsw.Graph.load(g.save(uids=np.arange(500), cnts=one, links=one, roots=one))
    assert (z["uids"] == np.arange(500)).all() and (h.bits(x) == g.bits(x)).all()
