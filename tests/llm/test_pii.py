import itertools
import time

from pyspark.sql import functions as F

from entitylink.llm import pii, queries
from tests.llm import plain_pii


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.pii_replaced) for r in sorted(pii.pseudonymise(df).collect(), key=lambda r: r.doc_id)]


def test_query_equals_plain_python(spark, sf):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.pii_replaced) for r in queries.op5_pii(spark, sf).collect()}
    assert got == {i: plain_pii.pseudonymise(t) for i, t in before.items()}
    assert sum(n for _, n in got.values()) > 20


def test_all_formats_equal_plain_python(spark):
    texts = [
        "a 4485 2757 4230 8327 b", "4485275742308327", "GB82 WEST 1234 5698 7654 32", "31/12/1999 1.2.2003 2001/05/06 12/31/1999 4/13/2020 1999-02-29",
        "bob.smith42@mail7.example.com, Bob@x.org", "MÜLLER@a.de müller@a.de möller@a.de", "x@a.de 7@a.de ж@пример.com иван.петров@mail.ru", "..-lead.ing@x.org a@b a@b.c",
        "+49 170 1234567 +491701234567 +1 (212) 555-0100 (212) 555-0100 +99 12", "123-45-6789 666-12-1234 10.0.0.1 256.1.1.1 1.2.3.4.5", "名前123@example.com ²½@x.org", "müller@a.de", "", None,
    ]
    assert run(spark, texts) == [plain_pii.pseudonymise(t) for t in texts]


def test_telephone_numbers_are_linked_however_they_are_spaced(spark):
    got = [t for t, _ in run(spark, ["+49 170 1234567", "+491701234567", "+49-170-123-4567", "+353 86 123 4567", "+353861234567"])]
    plain = ["".join(c for c in t if c.isdigit()) for t in got]
    assert plain[0] == plain[1] == plain[2] and plain[3] == plain[4] and plain[0].startswith("49") and plain[3].startswith("353") and plain[0] != "491701234567"


def one_to_one(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "m string")
    got = [r[0] for r in df.select(column(F.col("m"))).collect()]
    assert len(set(values)) == len(values) == len(set(got))
    return got


def test_different_local_parts_get_different_pseudonyms(spark):
    letters = "abzéöüßжяñçøABZÉÖØЖЯ059_.二三"
    locals_ = {"".join(p) for n in (1, 2, 3) for p in itertools.product(letters, repeat=n) if any(c.isalnum() for c in p)}
    values = sorted(f"{x}@a.de" for x in locals_ if x[0].isalnum())
    one_to_one(spark, values, lambda m: pii.email(m, "k"))
    # a whole small format: every letter of Latin-1 alone, and every pair of ASCII letters
    single = [f"{c}@a.de" for c in pii.SMALL]
    assert sorted(one_to_one(spark, single, lambda m: pii.email(m, "k"))) == sorted(single)
    pairs = [f"{a}{b}@a.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(one_to_one(spark, pairs, lambda m: pii.email(m, "k"))) == sorted(pairs)
    assert all(a != b for a, b in zip(single, one_to_one(spark, single, lambda m: pii.email(m, "k")), strict=True))


def test_dates_with_the_month_first_stay_apart(spark):
    day_first = [f"{d:02d}/{m:02d}/{y}" for y in (1900, 1999, 2024) for m in range(1, 13) for d in range(1, 29)]
    month_first = [f"{m:02d}/{d:02d}/{y}" for y in (1900, 1999, 2024) for m in range(1, 13) for d in range(13, 29)]
    got = one_to_one(spark, day_first + month_first, lambda m: pii.date(m, "k"))
    assert all(int(t[3:5]) > 12 for t in got[len(day_first) :]) and all(int(t[3:5]) <= 12 for t in got[: len(day_first)])


def test_long_texts_take_linear_time(spark):
    texts = ["x" * 1_000_000 + " 1", "a." * 500_000 + " 1", "1" * 1_000_000, "a@" * 300_000 + " 1", "x" * 1_000_000 + " call +1 212 555 0100", "1.2." * 200_000]
    run(spark, ["warm 1"])
    began = time.time()
    got = run(spark, texts)
    assert time.time() - began < 20
    assert [t for t, _ in got[:4]] == texts[:4] and got[4][1] == 1


def test_clashing_columns_keep_their_values_and_leak_nothing(spark):
    names = ["found", "_found", "new", "_new", "row", "x", "pii_replaced", "a.b"]
    df = spark.createDataFrame([(1, "mail ann.lee7@example.org", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.pseudonymise(df)
    r = out.first()
    assert out.columns == ["doc_id", "text", *[n for n in names if n != "pii_replaced"], "pii_replaced"]
    assert all(r[n] == n for n in names if n != "pii_replaced") and r["pii_replaced"] == 1 and "ann.lee7" not in str(r)


def test_empty_table_ties_and_repeated_rows(spark, empty):
    assert pii.pseudonymise(empty).count() == 0
    got = run(spark, ["call 123-45-6789"] * 3)
    assert len(set(got)) == 1 and got[0][1] == 1
