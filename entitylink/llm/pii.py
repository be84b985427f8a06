"""Format-preserving Feistel pseudonyms for personal data; DataFrame functions only, no shuffle.

Card numbers (13 to 19 digits with a valid Luhn digit), IBANs (valid mod 97), US social security
numbers, IPv4 addresses, dates from 1900 to 2099, telephone numbers and the local parts of e-mail
addresses are found in whole texts.  What passes its check is replaced by a keyed permutation within
its format: separators, lengths and letter classes stay, check digits are valid again.  The permutation
depends on nothing but key, format and value, so equal values get equal pseudonyms in all documents,
and different values get different ones.  As in any permutation, about one value in a whole format is
its own pseudonym.

The network alternates between two parts of a value, a in Z_m and b in Z_n: a += f(b) mod m, then
b += f(a) mod n, ``ROUNDS`` times; f is SHA-256 over key, format, round and the other part.  Numbers
are cut into halves of their digits, dates are days in Z_17 x Z_4297 (73,049 days), social security
numbers are in Z_88902 x Z_9999, addresses of two octets a side.  Dates with the month first (known by a day
above 12) are a format of their own, permuted among themselves: the network is repeated until its day is
above 12 again, so none looks like one with the day first.  Telephone numbers with a + keep their country
code, however they are spaced.  In e-mail addresses the parts are the halves of the local part, and each
letter or number is shifted within an alphabet that holds it: a-z, A-Z, 0-9, the small and the capital
letters of Latin-1, and for any other the aligned 16 code points around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

ROUNDS = 8
#: Only for tests and the sample queries; real runs pass their own.
KEY = "not-a-secret"

#: A local part is looked for only where its run of characters begins, and never backed out of, so long runs take linear time.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{M}._%+-]*+[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])"
#: Lengths of IBANs by country; with them a match ends where the number does, whatever word follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_LENGTH = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b" for n, c in IBAN_LENGTHS.items())
IBAN = rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_OF_LENGTH}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)"
CARD = r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
#: Country calling codes by length (ITU E.164): those of one and two digits; all others have three.
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters of Latin-1, without the signs of multiplication and division among them.
SMALL, CAPITAL = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: In this order at equal places; a match that fails its check stays as it is.
PATTERN = "|".join((EMAIL, IP, DATE, SSN, IBAN, PHONE, CARD))
DAYS, FIRST_DAY, WALK = 73_049, "1900-01-01", 64


def _prf(key: str, fmt: str, i: Column, part: Column) -> Column:
    """60 bits of SHA-256."""
    said = F.concat_ws("|", F.lit(key), F.lit(fmt), i.cast("string"), part)
    return F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, fmt: str) -> Column:
    """struct(a, b) permuted in Z_m x Z_n."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        na = F.when(even, F.pmod(s["a"] + _prf(key, fmt, i, s["b"].cast("string")) % m, m)).otherwise(s["a"])
        nb = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _prf(key, fmt, i, s["a"].cast("string")) % n, n))
        return F.struct(na.cast("long").alias("a"), nb.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ten(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("long")


def digits_pseudonym(d: Column, key: str, fmt: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length; a single digit is shifted."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    left, right = F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest)
    both = feistel(left.cast("long"), right.cast("long"), _ten(half), _ten(rest), key, fmt)
    two = _let(both, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))
    one = F.pmod(d.cast("long") + _prf(key, fmt, F.lit(0), F.lit("")) % 9 + 1, F.lit(10)).cast("string")
    return F.when(F.length(d) >= 2, two).when(F.length(d) == 1, one).otherwise(F.lit(""))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _fill(m: Column, digits: Column) -> Column:
    """The match with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        use = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["s"], F.when(use, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + use.cast("int")).alias("k"))

    return F.aggregate(_chars(m), start, step, lambda acc: acc["s"])


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn sum of a digit string, mod 10."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _let(F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def card(m: Column, key: str) -> Column:
    d = _only_digits(m)

    def swap(d: Column) -> Column:
        new = digits_pseudonym(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        full = _let(new, lambda p: F.concat(p, ((10 - luhn(F.concat(p, F.lit("0")))) % 10).cast("string")))
        return F.when((F.length(d).between(13, 19)) & (luhn(d) == 0), _fill(m, full)).otherwise(m)

    return _let(d, swap)


def mod97(s: Column) -> Column:
    """Of a string of digits and capitals, letters read as 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.aggregate(_chars(s), F.lit(0), step)


def iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")

    def swap(p: Column) -> Column:
        ok = F.length(p).between(15, 34) & (mod97(F.concat(F.substring(p, F.lit(5), F.lit(40)), F.substring(p, F.lit(1), F.lit(4)))) == 1)
        body = _fill(F.substring(p, F.lit(5), F.lit(40)), digits_pseudonym(_only_digits(F.substring(p, F.lit(5), F.lit(40))), key, "iban"))

        def close(b: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(b, F.substring(p, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), F.lit(2), "0")
            return _spaced(m, F.concat(F.substring(p, F.lit(1), F.lit(2)), check, b))

        return F.when(ok, _let(body, close)).otherwise(m)

    return _let(plain, swap)


def _spaced(m: Column, plain: Column) -> Column:
    """The plain characters with the match's spaces."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return F.aggregate(_chars(m), start, lambda a, c: F.struct(F.concat(a["s"], F.when(c == " ", c).otherwise(F.substring(plain, a["k"], F.lit(1)))).alias("s"), (a["k"] + (c != " ").cast("int")).alias("k")), lambda a: a["s"])


def ip(m: Column, key: str) -> Column:
    def swap(o: Column) -> Column:
        ok = F.forall(o, lambda x: x <= 255)
        both = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
        text = _let(both, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
        return F.when(ok, text).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), swap)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("int") for i in range(3))
    ok = area.between(1, 899) & (area != 666) & group.between(1, 99) & serial.between(1, 9999)
    index = area - 1 - (area > 666).cast("int")
    both = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def say(s: Column) -> Column:
        i = F.floor(s["a"] / 99)
        a = i + 1 + (i >= 665).cast("int")
        return F.concat_ws("-", F.lpad(a.cast("string"), F.lit(3), "0"), F.lpad((s["a"] % 99 + 1).cast("string"), F.lit(2), "0"), F.lpad((s["b"] + 1).cast("string"), F.lit(4), "0"))

    return F.when(ok, _let(both, say)).otherwise(m)


def date(m: Column, key: str) -> Column:
    """Year first; else day and month, or month and day where only that is a date.  Places and widths of a padded date stay."""
    sep = F.regexp_extract(m, r"[/.-]", 0)

    def swap(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        y = F.when(year_first, p[0]).otherwise(p[2]).cast("int")
        month_first = ~year_first & (p[1].cast("int") > 12)
        mo = F.when(month_first, p[0]).otherwise(p[1]).cast("int")
        d = F.when(year_first, p[2]).otherwise(F.when(month_first, p[1]).otherwise(p[0])).cast("int")
        last = F.when(mo == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
        ok = y.between(1900, 2099) & mo.between(1, 12) & (d >= 1) & (d <= last)
        day = F.datediff(F.make_date(y, mo, d), F.lit(FIRST_DAY).cast("date"))
        permuted = lambda k, fmt: _let(feistel(F.floor(k / 4297), k % 4297, F.lit(17), F.lit(4297), key, fmt), lambda s: (s["a"] * 4297 + s["b"]).cast("int"))
        late = lambda k: F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), k)) > 12
        first = permuted(day, "date-month-first")
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda k, _: F.when(late(k), k).otherwise(permuted(k, "date-month-first")))
        both = F.when(month_first, walked).otherwise(permuted(day, "date"))

        def say(s: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), s)
            wide = F.length(m) == 10
            dd, mm = (F.when(wide, F.date_format(new, f * 2)).otherwise(F.date_format(new, f)) for f in ("d", "M"))
            yy = F.date_format(new, "yyyy")
            return F.when(year_first, F.concat(yy, sep, mm, sep, dd)).when(month_first, F.concat(mm, sep, dd, sep, yy)).otherwise(F.concat(dd, sep, mm, sep, yy))

        return F.when(ok, _let(both, say)).otherwise(m)

    return _let(F.split(m, "[/.-]"), swap)


def phone(m: Column, key: str) -> Column:
    """The country code after + stays; all other digits are permuted."""

    def swap(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(d, CALLING_CODE, 0)).otherwise(F.lit(""))
        full = _let(code, lambda c: F.concat(c, digits_pseudonym(F.substring(d, F.length(c) + 1, F.length(d)), key, "phone")))
        return F.when(F.length(d).between(8, 15), _let(full, lambda new: _fill(m, new))).otherwise(m)

    return _let(_only_digits(m), swap)


def _moved(c: Column, k: Column, single: Column) -> Column:
    """A letter or number k places on in its alphabet, which wraps around; with ``single``, never in its own place."""

    def on(at: Column, n: int) -> Column:
        return (at + F.when(single, 1 + k % (n - 1)).otherwise(k)) % n

    def among(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), on(F.instr(F.lit(alphabet), c) - 1, len(alphabet)) + 1, F.lit(1))

    v = F.ascii(c)
    other = F.decode(F.unhex(F.lpad(F.hex(v - v % 16 + on(v % 16, 16)), 8, "0")), "UTF-32")
    out = F.when(c.rlike("^[a-z]$"), F.char(97 + on(v - 97, 26))).when(c.rlike("^[A-Z]$"), F.char(65 + on(v - 65, 26))).when(c.rlike("^[0-9]$"), F.char(48 + on(v - 48, 10)))
    return out.when(F.lit(SMALL).contains(c), among(SMALL)).when(F.lit(CAPITAL).contains(c), among(CAPITAL)).when(c.rlike(r"^[\p{L}\p{N}]$"), other).otherwise(c)


def email(m: Column, key: str) -> Column:
    """The local part permuted, apart for each domain; marks before its first letter or number, and the domain, stay."""
    whole, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    lead = F.regexp_extract(whole, r"^[^\p{L}\p{N}]*", 0)

    def shift(part: Column, stream: Column, single: Column) -> Column:
        """Each character moved by two hex digits of the stream (again from its start after 32 characters)."""
        return F.array_join(F.transform(_chars(part), lambda c, i: _moved(c, F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"), single)), "")

    def hashed(i: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), domain, other).cast("binary"), 256)

    def swap(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")
        single = F.length(local) == 1
        start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            # a single character moves once only, so that it never comes back to its place
            b = F.when(even | (single & (i > 1)), s["b"]).otherwise(shift(s["b"], hashed(i, s["a"]), single))
            return F.struct(F.when(even, shift(s["a"], hashed(i, s["b"]), single)).otherwise(s["a"]).alias("a"), b.alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))

    new = _let(lead, lambda x: F.concat(x, _let(F.substring(whole, F.length(x) + 1, F.length(whole)), swap)))
    return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


def _kinds(m: Column, key: str) -> list[tuple[str, Column, Column]]:
    full = lambda p: m.rlike("^(?:" + p + ")$")
    return [("email", m.contains("@"), email(m, key)), ("ip", full(IP), ip(m, key)), ("date", full(DATE), date(m, key)), ("ssn", full(SSN), ssn(m, key)), ("iban", full(IBAN), iban(m, key)), ("phone", full(PHONE), phone(m, key)), ("card", full(CARD), card(m, key))]


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match."""
    out = None
    for _, test, new in _kinds(m, key):
        out = F.when(test, new) if out is None else out.when(test, new)
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``pii_replaced``, the number of values that changed.

    Null text stays null with 0, empty text empty with 0.  Rows are replaced one by one, so repeated rows stay
    repeated and an empty table gives no rows.  All other columns are kept as they are, whatever their names,
    except that a column ``pii_replaced`` is replaced.
    """
    keep = [c for c in docs.columns if c != "pii_replaced"]
    found_, new_ = free_names(docs.columns, "found", "new")
    t, none = F.col(f"`{text}`"), F.array().cast("array<string>")
    df = docs.withColumn(found_, F.coalesce(F.when(t.rlike("[0-9]|@"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))), none))
    df = df.withColumn(new_, F.when(F.size(found_) > 0, F.transform(found_, lambda m: pseudonym(m, key))).otherwise(F.col(found_)))
    gaps = F.split(t, PATTERN, -1)
    put = F.array_join(F.zip_with(gaps, F.concat(F.col(new_), F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    changed = F.size(F.filter(F.zip_with(found_, new_, lambda a, b: a != b), lambda x: x))
    return df.select(*[(F.when(F.size(found_) > 0, put).otherwise(t) if c == text else F.col(f"`{c}`")).alias(c) for c in keep], changed.cast("int").alias("pii_replaced"))
