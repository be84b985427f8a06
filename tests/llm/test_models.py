import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylink.llm import language, quality, queries, toxicity
from entitylink.llm.common import remainder


def rest(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def test_language_query(spark, sf01):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = queries.op2_language(spark, sf01).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    apart = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in apart]) > 0.97


def test_language_odd_rows(spark, odd, empty):
    m = language.fit(odd, remainder(F.col("doc_id"), 5) >= 0)
    got = language.predict(odd, m).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    m = language.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, m).collect()} == {"und"}
    assert language.predict(empty, m).count() == 0


def test_families_hold_listed_and_unknown_codes():
    assert language.family("de") == language.family("en-GB") == "germanic"
    assert language.family("xx") == "alone-xx"


@pytest.mark.parametrize(("query", "label", "mod", "apart", "least"), [("op7_toxicity", "toxic", 5, 0, 0.85), ("op10_quality", "quality", 3, 1, 0.95)])
def test_scores_rank_held_out_labels(spark, sf01, query, label, mod, apart, least):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = queries.QUERIES[query](spark, sf01).collect()
    assert len(got) == spark.read.parquet(f"{sf01}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (rest(r.doc_id, mod) == apart) for r in got)
    a, b = ([r.score for r in got if r.held_out and y.get(r.doc_id) == k] for k in (1, 0))
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in a for q in b])
    assert auc > least


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, None, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd
    for mod in (quality, toxicity):
        m = mod.fit(docs, labels, F.lit(True))
        got = mod.score(docs, m).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        m = mod.fit(empty, labels, F.lit(True))
        assert all(0 <= r.score <= 1 for r in mod.score(docs, m).collect()) and mod.score(empty, m).count() == 0


def test_chunks_cover_every_window_of_a_text():
    for n in (1, 17, 511, 512, 513, 1500, 5000):
        c = quality.chunks(n)
        windows = {w for s, e in c for w in range(s, max(s + 1, e - quality.WIDTH + 1))}
        assert windows >= set(range(max(1, n - quality.WIDTH + 1))) and c[-1, 1] == n


def test_pooling_by_pieces_equals_pooling_at_once():
    rng = np.random.default_rng(1)
    net = quality.Net(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.ones(2 * quality.FILTERS + 2))
    b = rng.integers(0, 256, 400_000).astype(np.uint8)
    mean, most = net.pooled(b, np.array([0, len(b)]))
    r = quality.responses(b, net.table)
    # pieces begin at every 256th chunk, so the chunks are those of the whole text
    z = np.tanh(np.stack([r[s:e].max(0) for s, e in quality.chunks(len(b))]))
    assert np.allclose(most[0], z.max(0), atol=1e-6) and np.allclose(mean[0], z.mean(0), atol=1e-6)
    got, where = net.peaks(b)
    assert np.allclose(got, z, atol=1e-6) and np.allclose(np.tanh(r[where, np.arange(quality.FILTERS)]), z, atol=1e-6)


def test_isotonic_is_monotone_and_pools():
    x, y = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and y[0] < 0.5 < y[-1]


def test_hidden_words():
    assert toxicity._hidden("you are an id1ot and an i.d.i.o.t", toxicity.INSULTS) == (2, 2)
    assert toxicity._hidden("plain words only.", toxicity.INSULTS) == (0, 0)


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def plain_language(text, m):
    """Counting, family and votes once more, one by one."""
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    kept = ""
    for c in text.lower():
        letter = unicodedata.category(c)[0] == "L"
        if letter or not kept.endswith(" "):
            kept += c if letter else " "
    b = (" " + kept + " ").encode()
    total = np.zeros(language.DIM)
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            h = (int.from_bytes(b[i : i + n], "big") + (n << 28)) * 2654435761 % 2**32
            total[h >> (32 - language.DIM.bit_length() + 1)] += 1
    total[0] = 0
    x = np.append(np.sqrt(total) / np.sqrt(total.sum()), 1.0)
    z = x @ m.w_family
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    fam = m.families[int(p.argmax())]
    own = [c for c in m.langs if language.family(c) == fam]
    votes, margin, sure = ({c: v for c in own} for v in (0, 0.0, 1.0))
    for i, a in enumerate(own):
        for c in own[i + 1 :]:
            d = float(x @ m.pairs[a, c])
            votes[a if d > 0 else c] += 1
            margin[a] += d
            margin[c] -= d
            sure[a] *= 1 / (1 + np.exp(-2 * d))
            sure[c] *= 1 - 1 / (1 + np.exp(-2 * d))
    best = max(own, key=lambda c: (votes[c], margin[c], -own.index(c)))
    return best, float(p.max() * sure[best])


def test_language_query_equals_plain_python(spark, sf):
    docs, _ = docs_of(spark, sf)
    m = language.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_language(spark, sf).collect():
        lang, score = plain_language(texts[r.doc_id], m)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_numbers_and_marks_are_no_letters(spark):
    m = language.train(np.eye(2, language.DIM, dtype=np.float32), ["fr", "en"])
    texts = ["½ ² ① 12", "Ⅷ ⅓", "+-*", "\u0301", "½ a", "ª", "中"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.lang_pred for r in sorted(language.predict(df, m).collect(), key=lambda r: r.doc_id)]
    assert [g == "und" for g in got] == [True, True, True, True, False, False, False]


def plain_lexicon(rows):
    """(text, y) rows -> learned words, by counters."""
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    count = {1: Counter(), 0: Counter()}
    for t, y in rows:
        ws = set(toxicity._WORD.findall(t.lower()))
        count[y].update(ws | {w[:n] + "*" for w in ws for n in toxicity.STEMS if len(w) > n})
    got = []
    for w, a in count[1].items():
        if a >= 5 and len(w) > 1:
            b = count[0][w]
            cells = (a + 0.5, n1 - a + 0.5, b + 0.5, n0 - b + 0.5)
            low = math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3]) - 2 * math.sqrt(sum(1 / c for c in cells))
            if low > toxicity.LEAST_ODDS:
                got.append((-round(low, 9), w))
    return {w for _, w in sorted(got)[: toxicity.LEARNED]}


def test_toxicity_query_equals_plain_python(spark, sf01):
    docs, labels = docs_of(spark, sf01)
    texts = {r.doc_id: r.text for r in docs.collect()}
    m = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    rows = [(texts[r.doc_id] or "", r.toxic) for r in labels.collect() if r.toxic in (0, 1) and rest(r.doc_id, 5) and r.doc_id in texts]
    assert m.learned == plain_lexicon(rows)
    for r in queries.op7_toxicity(spark, sf01).collect()[:300]:
        x = toxicity.features(texts[r.doc_id] or "", m.learned)
        s = m.base
        for f, t, v in m.trees:
            k = 0
            while k < 2**toxicity.DEPTH - 1:
                k = 2 * k + 1 + (x[f[k]] > t[k])
            s += v[k - (2**toxicity.DEPTH - 1)]
        xs, ys = m.knots
        k = sum(1 for u in xs if u <= s)
        want = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (s - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert r.score == pytest.approx(want, abs=1e-9)


def plain_quality(text, net):
    b = (text or "").encode()
    z = []
    for s, e in quality.chunks(len(b)):
        best = np.full(quality.FILTERS, -np.inf)
        for i in range(s, e):
            best = np.maximum(best, sum(net.table[j][b[i + j]].astype(float) for j in range(quality.WIDTH) if i + j < len(b)))
        z.append(np.tanh(best))
    pooled = [np.mean(z, 0), np.max(z, 0)] if z else [np.zeros(quality.FILTERS)] * 2
    return 1 / (1 + math.exp(-float(np.concatenate([*pooled, [math.log1p(len(b)) / 10, 1.0]]) @ net.out)))


def test_quality_query_equals_plain_python(spark, sf):
    docs, labels = docs_of(spark, sf)
    net = quality.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sorted(queries.op10_quality(spark, sf).collect())[::5]:
        if len(texts[r.doc_id] or "") < 6000:
            assert r.score == pytest.approx(plain_quality(texts[r.doc_id], net), abs=1e-5)


def long_text(words, at, n=200_000):
    """A text of over a million bytes with a few words in its middle."""
    return " ".join(["plain", "words", "here"] * (n // 3)) + f" {words} " + " ".join(["more", "of", "them"] * at)


def test_whole_texts_are_learned_from(spark):
    """What sets the labels apart stands in the middle of very long texts alone."""
    rows = [(i, long_text("zzqx vvkw" if i % 2 else "soft mild", 50, 30_000), i % 2) for i in range(24)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    assert {"zzqx", "vvkw"} <= m.learned
    net = quality.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)


def test_training_windows_bound_memory(spark, scratch):
    df = spark.createDataFrame([("x" * 50_000, k % 2) for k in range(200)], "text string, y int")
    scratch.save(df, "sample")
    windows = quality.from_files(scratch.path("sample"), most=1_000_000)
    for _ in range(2):
        got = list(windows())
        assert sum(len(y) for _, y in got) == 200 and max(sum(map(len, t)) for t, _ in got) < 1_000_000 + 33 * 50_000
    whole = quality.from_files(scratch.path("sample"))
    assert len(list(whole())) == 1 and next(iter(whole())) is next(iter(whole()))


def test_very_long_texts_are_scored(spark):
    docs = spark.createDataFrame([(0, long_text("you idiot", 10)), (1, "x" * 2_000_000), (2, "a " * 500_000)], "doc_id long, text string")
    y = [0.0, 1.0] * 30
    m = toxicity.train(np.random.default_rng(0).random((60, toxicity.FOLDS + 1, len(toxicity.NAMES))), np.array(y), np.arange(60) % toxicity.FOLDS, [frozenset()] * (toxicity.FOLDS + 1))
    net = quality.train(lambda: iter([([b"good text", b"bad"] * 30, np.array(y))]))
    lang = language.train(np.eye(2, language.DIM, dtype=np.float32), ["fr", "en"])
    for out in (toxicity.score(docs, m), quality.score(docs, net), language.predict(docs, lang)):
        assert all(0 <= r.score <= 1 for r in out.collect())


def test_clashing_columns_are_replaced_and_others_kept(spark, odd):
    y = np.array([0.0, 1.0] * 30)
    m = toxicity.train(np.zeros((60, toxicity.FOLDS + 1, len(toxicity.NAMES))), y, np.arange(60) % toxicity.FOLDS, [frozenset()] * (toxicity.FOLDS + 1))
    for out in (toxicity.score(odd, m), quality.score(odd, quality.train(lambda: iter([]))), language.predict(odd.withColumn("lang_pred", F.lit("old")), language.train(np.zeros((0, language.DIM)), []))):
        assert out.columns.count("score") == 1 and out.schema["score"].dataType.simpleString() == "double" and {"_c", "lang", "source", "n_chars"} <= set(out.columns)
        assert out.count() == odd.count()
