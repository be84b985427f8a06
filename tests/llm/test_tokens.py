import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from entitylink.llm import packing, queries, token_output
from entitylink.llm.tokens import Encoder, default_path, encoder

ENC = Encoder(default_path())
PIECES = st.sampled_from(["a", "foo", " ", "  ", "\n", "\t", "é", "漢字", "'s", "it's", "12", "!!", "***", "\0", "\xa0", "　", "<|endoftext|>", ".", " x"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    ids, bounds = ENC.encode(texts, 7)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*ENC.tok.encode(t, add_special_tokens=False).ids, 7]


def whole(text, end):
    return [*encoder(default_path()).tok.encode(text or "", add_special_tokens=False).ids, end]


def test_files_round_trip(spark, odd, scratch):
    folder = scratch.path("shards")
    m = scratch.save(token_output.write_tokens(odd, folder), "m")
    got = token_output.read_tokens(token_output.with_bases(m), folder).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, g in zip(rows, sorted(got, key=lambda g: g.start), strict=True):
        ids = np.array(whole(r.text, 2), "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_an_empty_table(spark, empty, scratch):
    m = scratch.save(token_output.write_tokens(empty, scratch.path("none")), "m0")
    assert token_output.read_tokens(token_output.with_bases(m), scratch.path("none")).count() == 0


def test_token_output_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for g in sorted(queries.op8_token_output(spark, sf).collect(), key=lambda g: g.doc_id):
        ids = np.array(whole(docs[g.doc_id], 2), "<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(rows, texts, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for d, ts in texts.items():
        if len(ts) > 1:
            continue
        ids, at = np.array(whole(ts[0], 1), "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sums = [sum(r.length for r in rs) for rs in by_seq.values()]
    padding = sum(0 if n & (n - 1) == 0 else size - n for n in sums)
    return padding, sum(sums)


def test_packing_places_every_id_once(spark, odd):
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    for window in (64, 1 << 20):
        padding, _ = check_packing(packing.pack(odd, size=256, window=window).collect(), texts, 256)
        assert padding == 0


def test_packing_query(spark, sf):
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        texts[r.doc_id].append(r.text)
    padding, tokens = check_packing(queries.op1_packing(spark, sf).collect(), texts, 2048)
    assert padding <= 0.001 * tokens


def test_packing_empty(spark, empty):
    assert packing.pack(empty).count() == 0


def test_assign_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 900, 400)
    pieces, left, n = packing.assign(lengths, 2048, True)
    load = np.zeros(n)
    for _, _, k, q, _ in pieces:
        load[q] += packing.cost(k)
    full = load[: int(lengths.sum()) // 2048]
    assert not left and full.std() / full.mean() < 0.1


def test_encoder_is_small_between_tasks():
    enc = Encoder(default_path())
    words = " ".join(f"w{k}x{k * 7919 % 100_003}" for k in range(150_000))
    for _ in range(2):
        ids, bounds = enc.encode([words + " the the", "the end"], 7)
        assert ids[: bounds[1]].tolist() == [*enc.tok.encode(words + " the the", add_special_tokens=False).ids, 7]
        enc.rest()
        assert len(enc.index) <= 100_000 and "the" in enc.index


def test_packing_and_output_encode_bounded_blocks(spark, scratch, monkeypatch):
    made = encoder

    def careful(path):
        class Spy:
            def __init__(self):
                self.n_bytes = made(path).n_bytes

            def encode(self, texts, end):
                assert len(texts) == 1 or sum(map(len, texts)) <= 2 << 20
                return made(path).encode(texts, end)

            def rest(self):
                made(path).rest()

        return Spy()

    docs = spark.createDataFrame([(k, "word and " * 20_000) for k in range(30)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(packing, "encoder", careful)
    monkeypatch.setattr(token_output, "encoder", careful)
    assert packing.pack(docs).select("doc_id").distinct().count() == 30
    assert token_output.write_tokens(docs, scratch.path("bounded")).selectExpr("sum(n_docs)").first()[0] == 30
