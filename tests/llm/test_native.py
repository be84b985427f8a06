import datetime as dt
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from entitylink.llm import mixing, pii, queries, topk


def prf(fmt, i, part):
    return int(hashlib.sha256(f"{pii.KEY}|{fmt}|{i}|{part}".encode()).hexdigest()[:15], 16)


def feistel(a, b, m, n, fmt):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + prf(fmt, i, b)) % m
        else:
            b = (b + prf(fmt, i, a)) % n
    return a, b


def digits(d, fmt):
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), fmt)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymise(df).collect(), key=lambda r: r.doc_id)]


def test_pseudonyms_match_plain_python(spark):
    card, (a, b) = "4485275742308327", feistel(192 * 256 + 168, 256 + 77, 65536, 65536, "ip")
    payload = digits(card[:-1], "card")
    check = next(c for c in "0123456789" if luhn(payload + c) == 0)
    day = (dt.date(2024, 2, 29) - dt.date(1900, 1, 1)).days
    x, y = feistel(day // 4297, day % 4297, 17, 4297, "date")
    new = dt.date(1900, 1, 1) + dt.timedelta(x * 4297 + y)
    s, t = feistel(122 * 99 + 44, 6788, 898 * 99, 9999, "ssn")
    area = s // 99 + 1 + (s // 99 >= 665)
    phone = digits("0175557713", "phone")
    got = run(spark, [f"pay {card}.", "at 192.168.1.77!", "on 2024-02-29,", "ssn 123-45-6789", "+1 (017) 555-7713"])
    assert got == [f"pay {payload}{check}.", f"at {a // 256}.{a % 256}.{b // 256}.{b % 256}!", f"on {new},", f"ssn {area:03d}-{s % 99 + 1:02d}-{t + 1:04d}", f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}"]


def test_invalid_values_and_plain_texts_stay(spark):
    texts = ["1234567890123456", "999.1.1.1", "2023-02-30", "666-12-1234", "DE89370400440532013001", "Version 2.0. 4.0 and 1,234", "", None, "no digits"]
    assert run(spark, texts) == texts


def test_formats_stay_and_equal_values_stay_linked(spark):
    texts = ["a 4485 2757 4230 8327 b", "4485275742308327", "GB82 WEST 1234 5698 7654 32", "31/12/1999 1.2.2003 2001/05/06", "bob.smith42@mail7.example.com, Bob@x.org", "bob.smith42@mail7.example.com"]
    got = run(spark, texts)
    for t, g in zip(texts, got, strict=True):
        assert g != t and re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", g))) == re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t))) or "." in t
    assert got[0].replace(" ", "")[1:-1] == got[1] and luhn(got[1]) == 0
    plain = got[2].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[4].split(",")[0] == got[5] and got[5].endswith("@mail7.example.com")


def test_permutations_are_one_to_one(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert df.select(pii.digits_pseudonym(F.col("d"), "k", "f").alias("p")).distinct().count() == 10_000
    ips = spark.range(3000).select(F.concat(F.lit("10.0."), (F.col("id") / 250).cast("int"), F.lit("."), F.col("id") % 250).alias("m"))
    assert ips.select(pii.ip(F.col("m"), "k").alias("p")).distinct().count() == 3000
    days = spark.range(3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("m"))
    assert days.select(pii.date(F.col("m"), "k").alias("p")).distinct().count() == 3000


def test_pii_query_and_odd_rows(spark, sf, odd, empty):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(before)
    assert all((r.text != before[r.doc_id]) == (r.pii_replaced > 0) for r in got)
    for r in got:
        for m in re.findall(r"[a-z]+\.\d\d@mail\d\.example\.com", before[r.doc_id] or ""):
            assert m not in r.text
    assert pii.pseudonymise(odd).count() == odd.count() and pii.pseudonymise(odd).columns == [*odd.columns, "pii_replaced"]
    assert pii.pseudonymise(empty).count() == 0


def test_iban_ends_before_the_next_word(spark):
    numbers = ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "DE89 3704 0044 0532 0130 00"]
    after = [" BIC GEBABEBB", " 2021", " BANK", ""]
    rows = [(i, f"pay {n}{a}") for i, (n, a) in enumerate((n, a) for n in numbers for a in after)]
    rows += [(100, "BE68 5390 0754 7034 4111 1111 1111 1111"), (101, "BE68 5390 0754 7035 BIC")]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (n, a) in enumerate((n, a) for n in numbers for a in after):
        new = out[i].text.removeprefix("pay ").removesuffix(a)
        assert out[i].pii_replaced == 1 and n not in out[i].text and out[i].text == f"pay {new}{a}"
        plain = new.replace(" ", "")
        assert len(new) == len(n) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert out[100].pii_replaced == 2 and "4111 1111 1111 1111" not in out[100].text
    assert out[101].pii_replaced == 0 and out[101].text == "BE68 5390 0754 7035 BIC"


def test_mixing_query_equals_sql(spark, sf, duck):
    got = {tuple(r) for r in queries.op9_mixing(spark, sf).collect()}
    assert got == set(duck.execute(mixing.SQL).fetchall())


def test_mixing_query_runs_the_curriculum(spark, sf, scratch, monkeypatch):
    monkeypatch.setattr(queries, "Scratch", lambda *_: scratch)
    got = queries.op9_mixing(spark, sf).collect()
    order = spark.read.parquet(scratch.path("order")).collect()
    per_doc, sources = Counter(), defaultdict(list)
    for r in order:
        per_doc[r.doc_id] += r.words
        sources[r.source].append(r)
    assert {r.doc_id: r.taken for r in got if r.taken} == per_doc and any(r.taken == 0 for r in got)
    # each source's words, in training order, follow the integral of its weight
    for k, name in enumerate(sorted(sources)):
        tilt, done = mixing.TILTS[k % 3], 0
        for r in sorted(sources[name], key=lambda r: r.mix_position):
            u = (1 - tilt) * r.mix_position + tilt * r.mix_position**2
            assert u * r.target == pytest.approx(done + r.words / 2, abs=0.01)
            done += r.words
        assert done == int(r.target)
    parts = defaultdict(list)
    for r in spark.read.parquet(scratch.path("order")).select("mix_position", F.input_file_name().alias("f")).collect():
        parts[r.f].append(r.mix_position)
    ends = sorted((p[0], p[-1]) for p in parts.values())
    assert all(p == sorted(p) for p in parts.values()) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_mixing_sums_copies_by_row(odd, empty, scratch):
    want = mixing.plan(odd, scratch).select("doc_id", "size", "source_size", "target", "taken").collect()
    got = mixing.taken(odd, scratch).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert mixing.taken(empty, scratch).count() == 0


def test_mixing_odd_rows(spark, odd, empty, scratch):
    rows = mixing.plan(odd, scratch).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    by = {r.source: r for r in rows}
    assert sum(r.target for r in by.values()) == pytest.approx(1.5 * total)
    for s, r in by.items():
        assert sum(x.taken for x in rows if x.source == s) == int(r.target)
        assert r.target <= 2 * r.source_size
    assert mixing.plan(empty, scratch).count() == 0
    copies = mixing.curriculum(odd, scratch)
    assert copies.columns == [*odd.columns, "mix_position"]
    got = copies.select("source", mixing.words(F.col("text")).alias("w"), "mix_position").collect()
    assert sum(r.w for r in got) == sum(r.taken for r in rows) and all(0 <= r.mix_position <= 1 for r in got)
    assert mixing.curriculum(empty, scratch).count() == 0


def test_positions_follow_the_schedule(spark):
    df = spark.range(1001).select((F.col("id") / 1000).alias("u"))
    for kind, tilt in enumerate(mixing.TILTS):
        for r in df.select("u", mixing.position(F.col("u"), F.lit(kind)).alias("t")).collect():
            assert (1 - tilt) * r.t + tilt * r.t**2 == pytest.approx(r.u, abs=1e-9)


def test_topk_query_equals_sql(spark, sf, duck):
    got = {tuple(r) for r in queries.op6_exact_topk(spark, sf).collect()}
    assert got == set(duck.execute(topk.SQL).fetchall())


def test_topk_odd_rows(spark, scratch):
    rows = [(0, [1.0, 0.5]), (50, [-1.0, 0.25]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, []), (None, [9.0, 9.0]), (8, [1e12, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, 2, scratch).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 256 * 256 * 10**12 - 768 * 128), (0, 2, 1, 65536 + 128 * 128), (50, 1, 0, -65536 + 64 * 128), (50, 2, 1, -65536 + 64 * 128)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 2, scratch).count() == 0
