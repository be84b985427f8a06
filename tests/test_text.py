import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entitylink.functions import casts, hashing
from entitylink.functions import similarity as S
from entitylink.functions import text as X
from entitylink.operators.misses import country_kind, name_kind


def col(spark, values, *exprs, types="s string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], types)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_fold():
    assert X.fold("Café  Straße—№5 ½") == "cafe strasse No5 1 2"
    assert X.fold("लोटस मीडिया") == "ल टस म ड य"
    assert X.fold(None) == X.fold("") == ""


def test_native_fold_equals_full_fold_on_sample_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert d.where(X.fold_latin(F.col("text")) != X.fold_any(F.col("text"))).count() == 0


@given(st.text(alphabet=st.sampled_from("aBé9 .-ßÑ'_"), max_size=30))
def test_fold_is_idempotent(s):
    assert X.fold(X.fold(s)) == X.fold(s)


def test_names(spark):
    rows = [("acme private limited", "in"), ("acme co ltd", "us"), ("groupe fils sarl", "fr"), ("limited", "us"), ("co acme", "us"), ("acme gmbh", "de")]
    got = col(spark, rows, X.strip_legal(F.col("s"), F.col("c")), types="s string, c string")
    assert [g[0] for g in got] == ["acme", "acme", "", "", "co acme", "acme"]
    assert col(spark, ["united states", "usa", "brazil", ""], X.canonical_country(F.col("s"))) == [("us",), ("us",), ("brazil",), ("",)]
    assert col(spark, ["Visit www.Acme-Shop.com/x or b.org", "mail a@b.com"], X.domains(F.col("s"))) == [(["acme-shop.com", "b.org"],), ([],)]
    assert col(spark, ["A Inc d/b/a Bee: LLC aka C", "plain dbaseline"], X.alias_parts(F.col("s"))) == [(["A Inc", "Bee: LLC", "C"],), ([],)]
    assert col(spark, ["shop.acme.com", "localhost"], X.domain_base(F.col("s"))) == [("acme",), ("",)]


def test_ngrams(spark):
    got = col(spark, ["ab cab", "ab", "", "aaaa"], X.char_ngrams(F.col("s"), 3), X.char_ngram_list(F.col("s"), 3))
    assert got == [(["abc", "bca", "cab"], ["abc", "bca", "cab"]), (["ab"], ["ab"]), ([], []), (["aaa"], ["aaa", "aaa"])]


def test_addresses(spark):
    assert col(spark, ["12 main street 007", "r de lyon"], X.street_tokens(F.col("s"))) == [(["12", "main", "st", "7"],), (["rue", "de", "lyon"],)]
    assert col(spark, ["12345-6789", "101 22 MG Road", "K1A 0B1", "none"], X.postal_codes(F.col("s"))) == [(["12345", "12345-6789"],), (["10122"],), (["K1A0B1"],), ([],)]
    assert X.house_numbers("12/14 Main St 411001") == ["12/14", "12", "14"]
    assert X.house_numbers("No. 0189, flat 7-9") == ["189", "7", "9"]
    assert X.house_numbers("101 22 MG Road") == [] == X.house_numbers(None)


def test_transliterate():
    assert X.transliterate("Лотос Щука") == "Lotos Shchuka"
    assert X.transliterate("लोटस") == "lots"
    assert X.transliterate("plain é") == "plain é"


def test_older_normaliser(spark):
    assert col(spark, ["Acme (Bee Co) Ltd", "A fka B", "x"], X.old_alias_parts(F.col("s"))) == [(["Acme Ltd", "Bee Co"],), (["A", "B"],), ([],)]
    assert col(spark, ["see www.foo-bar.org now", "none"], X.old_domain(F.col("s"))) == [("foo bar",), ("",)]
    assert col(spark, ["acme co ltd of sons", "llc acme"], X.old_strip_legal(F.col("s"))) == [("acme of sons",), ("acme",)]
    assert col(spark, ["12 main st"], X.old_street_words(F.col("s"))) == [("12 main street",)]
    assert col(spark, ["012 a 12-14 b 411001"], X.old_house_numbers(F.col("s"))) == [(["12", "12-14"],)]
    rows = [("x 411001", "India"), ("x 99123", "France"), ("x 75001", "France"), ("x 90210-1234", "US"), ("x 123456", None), ("none", "US")]
    assert [g[0] for g in col(spark, rows, X.old_postal_code(F.col("s"), F.col("c")), types="s string, c string")] == ["411001", None, "75001", "90210", "123456", None]


def test_identity_keys(spark):
    got = col(spark, ["www.Acme.com d/b/a Bee, Inc", "X also known as Why", "plain"], X.identity_keys(F.col("s")))
    assert got == [(["domain:acme com", "alias:bee inc"],), (["alias:why"],), ([],)]


def test_jaro_winkler():
    assert S.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro("", "") == S.jaro("a", "") == 0.0 and S.jaro_winkler("abc", "abc") == 1.0


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_winkler_stays_in_range(a, b):
    assert 0 <= S.jaro(a, b) <= S.jaro_winkler(a, b) <= 1


def test_set_similarities(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(S.jaccard("x", "y") if False else S.jaccard(F.col("x"), F.col("y")), S.containment(F.col("x"), F.col("y")), S.max_containment(F.col("x"), F.col("y"))).collect()]
    assert got == [(pytest.approx(1 / 3), 0.5, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("a", "a")], "x string, y string")
    assert [r[0] for r in df.select(S.edit_similarity(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 - 3 / 7), 0.0, 1.0]


def test_evidence():
    assert S.evidence_text("Société Générale") == "societe generale"
    assert S.evidence_tokens("Acme, ACME & Söhne") == ["acme", "sohne"]
    assert S.host("https://www.AggieENagle.com/path") == "aggieenagle.com"
    assert S.domain_tokens("aggie-e-nagle.com") == ["aggie", "e", "nagle"]
    assert S.domain_tokens("https://www.acme-shop.com/x") == ["acme", "shop"]
    assert S.soft_similarity(["acme"], ["acme", "x"]) == 1.0 and S.soft_similarity([], ["a"]) == 0.0
    assert S.soft_similarity(["aggie", "nagle"], ["aggie", "nagl"]) == pytest.approx((1 + 8 / 9) / 2)
    assert S.soft_coverage(["aggie", "nagle"], ["aggie", "nagl"]) == 1.0
    assert S.domain_name_similarity("aggieenagle.com", "Aggie E Nagle") == 1.0 and S.combined_evidence("Aggie E Nagle", "aggieenagle.com") == 1.0
    # as one word alike: full coverage; else token by token of the smaller side, or of the name
    assert S.domain_coverage("acme-shop.com", "Acme Shop Ltd") == 1.0
    assert S.domain_coverage("acme-zz.com", "Blue Acme River Works") == 0.5
    assert S.name_coverage("Acme Blue River Works", "acmeblue.com") == 0.5
    v = dict(zip(S.SECONDARY, S.secondary("Acme Shop", "acme shop", "acme.com", ""), strict=True))
    assert v["soft_token_similarity"] == v["soft_token_coverage"] == 1.0
    assert v["domain_name_similarity_left_domain"] == 1.0 and v["domain_name_similarity_right_domain"] == 0.0
    assert v["domain_name_coverage_left_domain"] == 1.0 and v["name_domain_coverage_right_name"] == 0.5 and v["name_domain_coverage_left_name"] == 0.0
    assert v["combined_name_domain_evidence"] == 1.0
    assert S.secondary(None, "", None, "") == [0.0] * 9
    assert all(0 <= x <= 1 for x in S.secondary("मुंबई ट्रेडर्स", "Mumbai Traders", "", ""))


def test_pair_evidence():
    value = lambda a, b: dict(zip(S.EXTRA, S.pair_evidence(a, b), strict=True))
    assert S.embedded_domain("Acme Corp *** acme-example.com") == "acme-example.com" and S.embedded_domain("No domain here") == ""
    e = value("Acme Trading", "Acme Tradng")
    assert e["soft_token_similarity"] == round((1 + 2 * 6 / 13) / 2, 8) and e["soft_token_coverage"] == 1.0 and e["combined_name_domain_evidence"] == e["soft_token_similarity"]
    e = value("Acme Holdings acme.com", "Acme Holdings acme.com")
    assert [e[c] for c in S.EXTRA] == [1.0] * 8
    # the left side is held against the right one: one of three words here, the only one there
    assert value("Acme Blue River", "Acme")["soft_token_coverage"] == round(1 / 3, 8) and value("Acme", "Acme Blue River")["soft_token_coverage"] == 1.0
    # a domain's label is compared with the other domain's, not with the name
    e = value("Acme acme.com", "Acme")
    assert e["embedded_domain_left_present"] == e["embedded_domain_present"] == 1.0 and e["embedded_domain_right_present"] == e["embedded_domain_name_similarity"] == e["embedded_domain_name_coverage"] == 0.0
    e = value("Bo www.blue-river.co.in", "Zed blueriver.com")
    assert e["embedded_domain_name_similarity"] == round(2 * 9 / 19, 8) and e["embedded_domain_name_coverage"] == 0.0


def plain_jaro(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    m = len(mine)
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    t = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0


@given(st.text("abcd ", max_size=30), st.text("abcd ", max_size=30))
def test_jaro_by_bits_equals_jaro_by_loops(a, b):
    assert S.jaro(a, b) == plain_jaro(a, b)


def test_hashes(spark):
    got = [r[0] for r in spark.createDataFrame([("S1-1",), ("x",)], "s string").select(hashing.seeded_unit(F.col("s"), 42)).collect()]
    assert got == [hashing.unit("42:S1-1"), hashing.unit("42:x")] and all(0 <= g < 1 for g in got)
    assert hashing.config_hash({"b": 1, "a": 2}) == hashing.config_hash({"a": 2, "b": 1})


def test_casts(spark):
    got = col(spark, ["1", "1.5", "yes", "nan", "", None], casts.to_double(F.col("s")), casts.to_int(F.col("s")), casts.to_bool(F.col("s")))
    assert got == [(1.0, 1, True), (1.5, 1, False), (0.0, 0, True), (0.0, 0, False), (0.0, 0, False), (0.0, 0, False)]


def test_miss_kinds(spark):
    rows = [("", "a"), ("a b", "B A a"), ("Süd", "süd Ost"), ("a b", "b c"), ("acmeland", "acmetown"), ("x", "y"), ("Süd", "sud"), ("...", "a")]
    assert [g[0] for g in col(spark, rows, name_kind(F.col("a"), F.col("b")), types="a string, b string")] == ["NAME_EMPTY", "NAME_TOKEN_EXACT", "NAME_TOKEN_CONTAINMENT", "NAME_PARTIAL_OVERLAP", "NAME_PREFIX_SIMILAR", "NAME_NO_TOKEN_OVERLAP", "NAME_NO_TOKEN_OVERLAP", "NAME_EMPTY"]
    rows = [("", ""), ("us", ""), ("us", " US "), ("us", "fr"), (None, "us")]
    assert [g[0] for g in col(spark, rows, country_kind(F.col("a"), F.col("b")), types="a string, b string")] == ["COUNTRY_MISSING", "COUNTRY_MISSING", "COUNTRY_MATCH", "COUNTRY_CONFLICT", "COUNTRY_MISSING"]


@given(st.lists(st.text("0123456789 /-.aAnNoO\tß中é", max_size=25), min_size=40, max_size=60))
@settings(max_examples=6, deadline=None)
def test_house_numbers_equal_python(spark, texts):
    texts += ["12 Main Street 411001", "12-75001", "no. 7/9 A1B 2C3", "007 75 001 3", "12345-6789 4", "5a", "A1B2C3 8", "1234567 12345678", "１２ Road"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(X.house_numbers_of(F.col("s"))).collect()] == [X.house_numbers(t) for t in texts]


@given(st.lists(st.text(max_size=20), min_size=30, max_size=60))
@settings(max_examples=5, deadline=None)
def test_folding_native_where_it_can_equals_python(spark, texts):
    texts += ["Straße ŒUVRE", "Ÿ ÿ Éa", "ﬁ ™ ½ ²", "a…b—c’d", "İi Σς", " x", None]
    texts = [t if t is None else t.replace("\ud800", "") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(X.fold_any(F.col("s"))).collect()] == [X.fold(t) for t in texts]
    assert [r[0] for r in df.select(X.transliterated(F.col("s"))).collect()] == [X.transliterate(t) for t in texts]


def test_ngrams_of_long_and_odd_texts(spark):
    """A text of 400,000 characters is cut in one pass; characters outside the basic plane count once."""
    import time

    odd = ["", "a", "ab c", "a b c d", "x\ny z", "\U0001f600\U0001f601a\U0001f602", "aaaaaa"]
    long = "".join(chr(97 + i * i % 23) + chr(97 + i // 7 % 26) for i in range(200_000))
    df = spark.createDataFrame([(v,) for v in [*odd, long]], "v string")
    began = time.time()
    got = {r.v: (r.s, r.l) for r in df.select("v", X.char_ngrams(F.col("v"), 3).alias("s"), X.char_ngram_list(F.col("v"), 3).alias("l")).collect()}
    assert time.time() - began < 20
    for v in [*odd, long]:
        p = v.replace(" ", "")
        grams = [p[i : i + 3] for i in range(max(1, len(p) - 2))] if p else []
        assert got[v] == (sorted(set(grams), key=lambda g: g.encode()), grams)


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach, taken, mine = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(mine, [c for c, k in zip(b, taken, strict=True) if k], strict=True)) / 2.0
    s = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
    return s if s <= 0.7 else min(1.0, s + p * 0.1 * (1 - s))


def test_jaro_winkler_of_many_pairs(monkeypatch):
    import random

    from entitylink.functions import similarity as S

    r = random.Random(7)
    name = lambda n: "".join(r.choice("abcde éß漢😀") for _ in range(n))
    sizes = (0, 1, 2, 3, 4, 5, 31, 63, 64, 65, 127, 128, 129, 300, 513, 1030)
    pairs = [(name(n), name(m)) for n in sizes for m in sizes for _ in range(3 if n + m > 200 else 12)]
    pairs += [(a, a[: len(a) // 2] + b[len(a) // 2 :]) for a, b in pairs[::3]] + [(a, a) for a, _ in pairs[::9]]
    want = [plain_jaro_winkler(*p) for p in pairs]
    assert S.jaro_winklers(pairs).tolist() == want == [S.jaro_winkler(*p) for p in pairs]
    assert S.jaro_winklers([]).tolist() == [] and S.jaro_winklers([("", "")]).tolist() == [0.0]
    # names of usual lengths are compared without a call for each pair
    monkeypatch.setattr(S, "jaro_winkler", None)
    assert len(S.jaro_winklers([(name(40), name(n)) for n in range(33, 65) for _ in range(4)])) == 128


def test_distances_of_many_names_equal_those_of_pairs(monkeypatch):
    """Names of no, one and several numbers of 64 bits, copies, characters beyond 16 bits; small tables are halved."""
    import random

    from entitylink.functions import similarity as S

    rnd = random.Random(1)
    pairs = []
    for _ in range(1200):
        a = "".join(rnd.choice("abcdé щ\U0001f600") for _ in range(rnd.choice([0, 1, 5, 20, 63, 64, 65, 100, 128, 129, 190])))
        b = list(a)
        for _ in range(rnd.randint(0, 30)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 2)] = rnd.choice(["", "x", "ab"])
        pairs.append((a, "".join(b)))
    want = [S.edits(*p) for p in pairs]
    assert S.edits_of_many(pairs) == want
    for name, value in (("_MANY", 0), ("_PLACES", 16)):
        monkeypatch.setattr(S, name, value)
        assert S.edits_of_many(pairs) == want
    assert S.edits_of_many([]) == []
    assert S.edits_of_many([("kitten", "sitting")] * 40) == [3] * 40
    called = []
    monkeypatch.setattr(S, "edits", lambda a, b: called.append(a))
    S.edits_of_many([(a, b) for a, b in pairs if a and b and a != b])
    assert not called
