import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from entitylink.llm import mixing, packing, quality
from entitylink.llm.common import remainder
from entitylink.llm.tokens import default_path, encoder
from tests.llm import plain_pii
from tests.llm.test_dedup import brute
from tests.llm.test_models import plain_quality


def plain_mix(rows):
    """(doc_id, text, source) rows -> the (doc_id, text) that the mix takes, in training order."""
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, len(words(t)), t))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    size = {s: sum(x[2] for x in by[s]) for s in names}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        target |= {s: weight[s] * level for s in open_}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    out = []
    for k, s in enumerate(names):
        n, tilt = int(target[s]), mixing.TILTS[k % 3]
        done = 0
        while done < n:
            for _, i, w, t in sorted(by[s], key=lambda x: x[:3]):
                take = min(w, n - done)
                if take:
                    u = min(1.0, (done + take / 2) / target[s])
                    at = u if not tilt else (math.sqrt((1 - tilt) ** 2 + 4 * tilt * u) - (1 - tilt)) / (2 * tilt)
                    out.append((at, i, t if take == w else " ".join(words(t)[:take])))
                    done += take
    return [x[1:] for x in sorted(out)]


def check_packing(before, after):
    """Every id of every document in one piece, sequences without gaps, of 2048 or a power of two."""
    enc = encoder(default_path()).tok
    ids = {}
    for r in before:
        ids.setdefault(r.doc_id, []).append(np.array([*enc.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, seqs = Counter(), defaultdict(list)
    for r in after:
        whole = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
        assert whole
        pieces[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_stages_equal_plain_python(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(P.STAGES):
        net = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), remainder(F.col("doc_id"), 3) != 1) if name == "quality" else None
        docs = scratch.save(stage(spark, docs, sf), f"s{k}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
        if name == "quality":
            score = {r.doc_id: plain_quality(r.text, net) for r in before if len(r.text or "") < 3000}
            kept = {r.doc_id for r in after}
            assert set(after) <= set(before) and 0.5 * len(before) < len(after) < len(before)
            assert all((s >= 0.5) == (i in kept) for i, s in score.items() if abs(s - 0.5) > 1e-4) and any(s < 0.5 for s in score.values())
        if name == "near_dedup":
            keep = {i for i, _, c in brute([(r.doc_id, r.text) for r in before], P.NEAR) if i == c}
            assert set(after) == {r for r in before if r.doc_id in keep} and len(after) == len(keep)
        if name == "pii":
            want = {r.doc_id: plain_pii.pseudonymise(r.text)[0] for r in before}
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {i: (t, len(t)) for i, t in want.items()} and after != before
        if name == "mixing":
            assert Counter((r.doc_id, r.text) for r in after) == Counter(plain_mix([(r.doc_id, r.text, r.source) for r in before]))
        if name == "packing":
            check_packing(before, after)
        before = after


def test_stages_take_odd_and_empty_tables(spark, sf, scratch, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (7, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    folder = scratch.path("tables")
    labels.write.parquet(f"{folder}/labels.parquet")
    n = odd.count()
    for name, stage in P.STAGES:
        got = stage(spark, odd, folder)
        assert stage(spark, empty, folder).count() == 0
        if name == "packing":
            assert got.agg(F.countDistinct("doc_id")).first()[0] == 8
            continue
        assert got.columns == list(P.COLUMNS)
        rows = [tuple(r) for r in got.collect()]
        if name in ("quality", "near_dedup"):
            assert set(rows) <= {tuple(r) for r in odd.select(*P.COLUMNS).collect()}
        if name == "near_dedup":
            assert len(rows) == n - 1  # the row that is there twice
        if name == "pii":
            assert len(rows) == n and "ann.lee7" not in str(rows)
        if name == "mixing":
            assert {r[0] for r in rows} <= {1, 5, None, 7, 8, 9}
    spark.createDataFrame([], labels.schema).write.parquet(f"{folder}/none/labels.parquet")
    assert P.good_quality(spark, odd, f"{folder}/none").count() == n


def test_run_gives_the_last_stage(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == [c.split()[0] for c in packing.PIECES.split(", ")] and out.count() > 0


def test_repeated_rows_leave_one(spark, scratch, sf):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(1, "another text of the same id", "en", "s", 3), (None, "x", None, None, None), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.one_of_each(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2]


def test_of_a_repeated_id_the_unique_text_stays(spark, scratch, sf):
    docs = spark.createDataFrame([(0, "a b c d e f g", "en", "s", 13), (1, "A b c d e f g", "en", "s", 13), (1, "unlike any other text of the table", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in P.one_of_each(spark, docs, sf).collect()}
    assert got == {(0, "a b c d e f g"), (1, "unlike any other text of the table")}
