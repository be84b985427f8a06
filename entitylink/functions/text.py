"""Text functions.  Whatever Catalyst can express is a Column; full Unicode folding and what needs match
offsets are Arrow functions, one call for each batch."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from . import tables as T

#: The accented letters that the native path folds (fixed values), with what case folding and NFKD make of them.
_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


# -- folding ----------------------------------------------------------------------------------


def strip_marks(s: str) -> str:
    """NFKD without the characters of a combining class."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def fold(s: str | None) -> str:
    """Case-folded, without marks; everything but letters and numbers is one space."""
    if not s:
        return ""
    if s.isascii():
        return " ".join(re.findall("[a-z0-9]+", s.lower()))
    s = strip_marks(s.casefold())
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s).split())


@pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


#: Texts of these characters alone are folded natively: ASCII, the accented letters of the native path and common punctuation.
_SIMPLE = "^[\\x00-\\x7F" + _FROM + _FROM.upper().replace("Ÿ", "") + "ßŸ\\u00A0¡§«·»¿\\u2010-\\u2027‹›€]*$"


def fold_any(c: Column) -> Column:
    """``fold``; only texts that need it go through Python."""
    simple = F.coalesce(c.rlike(_SIMPLE), F.lit(True))
    return F.when(simple, fold_latin(c)).otherwise(_folded(F.when(~simple, c)))


def fold_latin(c: Column) -> Column:
    """The same as ``fold`` for texts of ASCII and the common accented Latin letters, inside codegen."""
    low = F.replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def _grams(value: Column, n: int) -> Column:
    """N-grams in order, by one pass over the value without spaces; ``substring`` would count from its start for each of them."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    each = F.regexp_extract_all(v, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(v) >= n, each).when(F.length(v) > 0, F.array(v)).otherwise(F.array().cast("array<string>"))


def char_ngrams(value: Column, n: int) -> Column:
    """Sorted distinct n-grams without spaces; a shorter value is its own; none of an empty one."""
    return F.sort_array(F.array_distinct(_grams(value, n)))


def char_ngram_list(value: Column, n: int) -> Column:
    """All n-grams in order, repeats kept; those of values shorter than n are the value."""
    return _grams(value, n)


# -- names ------------------------------------------------------------------------------------


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def canonical_country(clean: Column) -> Column:
    """Of a folded country: its code, or itself."""
    return F.coalesce(F.get(F.array(F.try_element_at(_map(T.COUNTRY_ALIASES), clean)), F.lit(0)), clean)


def _suffix_pattern(country: str) -> str:
    longest = sorted(T.LEGAL_SUFFIXES[country], key=lambda s: (-len(s.split()), -len(s)))
    one = "(?:" + "|".join(longest) + ")"
    return rf"(?:^|\s+){one}(?:\s+{one})*$"


def strip_legal(core: Column, country: Column) -> Column:
    """Folded names without the legal forms at their end, those of the country where it has its own list."""
    out = None
    for code in ("us", "in", "fr"):
        done = F.regexp_replace(core, _suffix_pattern(code), "")
        out = F.when(country == code, done) if out is None else out.when(country == code, done)
    return F.trim(out.otherwise(F.regexp_replace(core, _suffix_pattern("default"), "")))


def domains(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit("(?iU)" + T.DOMAIN), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda d: F.regexp_replace(F.lower(d), r"^\.+|\.+$", "")), lambda d: d != ""))


def without_domains(raw: Column) -> Column:
    return F.regexp_replace(raw, "(?iU)" + T.DOMAIN, " ")


def domain_base(d: Column) -> Column:
    """The label before the last dot, folded; empty for a single label."""
    parts = F.split(d, r"\.")
    return fold_latin(F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit("")))


def alias_parts(raw: Column) -> Column:
    """The parts of a name around alias markers; none without a marker."""
    parts = F.split(raw, "(?iU)" + T.ALIAS_MARKER)
    return F.when(raw.rlike("(?iU)" + T.ALIAS_MARKER), F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def transliterate(s: str | None) -> str:
    """Latin letters for Brahmic and Cyrillic ones; other texts stay as they are."""
    if not s or not any("ऀ" <= c <= "ൿ" or "Ѐ" <= c <= "ӿ" for c in s):
        return s or ""
    out = []
    for c in s:
        if "ऀ" <= c <= "ൿ":
            out.append(T.BRAHMIC.get((ord(c) - 0x900) % 0x80, ""))
        elif "Ѐ" <= c <= "ӿ":
            low = T.CYRILLIC.get(c.lower(), "")
            out.append(low if c.islower() else low.capitalize())
        else:
            out.append(c)
    return "".join(out)


@pandas_udf(StringType())
def _transliterated(s: pd.Series) -> pd.Series:
    return s.map(transliterate, na_action="ignore")


def has_script(c: Column) -> Column:
    """Whether a text holds letters that ``transliterate`` changes."""
    return F.coalesce(c.rlike("[\\u0900-\\u0D7F\\u0400-\\u04FF]"), F.lit(False))


def transliterated(c: Column) -> Column:
    """``transliterate``; other texts do not go through Python."""
    return F.when(has_script(c), _transliterated(F.when(has_script(c), c))).otherwise(F.coalesce(c, F.lit("")))


# -- addresses --------------------------------------------------------------------------------


def street_tokens(clean: Column) -> Column:
    """Street words in their short forms; numbers without leading zeros."""
    table = _map(T.STREET_TERMS)
    return F.transform(tokens(clean), lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(F.coalesce(F.try_element_at(table, t), t)))


def postal_codes(raw: Column) -> Column:
    """All codes that any of the patterns finds, without spaces, each once, pattern after pattern."""
    up = F.upper(raw)
    each = [F.regexp_extract_all(up, F.lit("(?U)" + p), F.lit(0)) for p in T.POSTAL_CODES]
    return F.array_distinct(F.transform(F.flatten(F.array(*each)), lambda p: F.regexp_replace(p, r"(?U)\s+", "")))


_HOUSE = re.compile(T.HOUSE_NUMBER, re.IGNORECASE)
_POSTAL = [re.compile(p) for p in T.POSTAL_CODES]


def house_numbers(raw: str | None) -> list[str]:
    """House numbers outside postal codes: ``a/b`` gives itself and both parts, ``a-b`` both parts."""
    if not raw:
        return []
    taken = [m.span() for p in _POSTAL for m in p.finditer(raw.upper())]
    out: list[str] = []
    for m in _HOUSE.finditer(raw):
        if any(m.start() < e and s < m.end() for s, e in taken):
            continue
        a, sep, b = m.group(1), m.group(2), m.group(3)
        a, b = str(int(a)), b and str(int(b))
        out += [f"{a}/{b}", a, b] if sep == "/" else [a, b] if sep else [a]
    return list(dict.fromkeys(out))


@pandas_udf(ArrayType(StringType()))
def _house_numbers(s: pd.Series) -> pd.Series:
    return s.map(house_numbers, na_action="ignore")


def house_numbers_of(raw: Column) -> Column:
    """``house_numbers``; texts without a digit do not go through Python."""
    some = F.coalesce(raw.rlike("(?U)\\d"), F.lit(False))
    return F.coalesce(_house_numbers(F.when(some, raw)), F.array().cast("array<string>"))


# -- the older normaliser -----------------------------------------------------------------------


def _old_clean(s: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", strip_marks((s or "").lower())).split())


@pandas_udf(StringType())
def old_clean(s: pd.Series) -> pd.Series:
    return s.map(_old_clean)


def old_domain(raw: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(raw, "(?iU)" + T.OLD_DOMAIN, 1)), F.lit("-"), F.lit(" "))


def old_alias_parts(raw: Column) -> Column:
    """Around markers; else the text outside and inside brackets, where that is longer than 2 characters."""
    none = F.array().cast("array<string>")
    marked = F.filter(F.transform(F.split(raw, "(?iU)" + T.OLD_ALIAS_MARKER), lambda p: F.trim(p)), lambda p: p != "")
    inner = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.trim(p)), lambda p: F.length(p) > 2)
    outer = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), r"\s+", " "))
    return F.when(raw.rlike("(?iU)" + T.OLD_ALIAS_MARKER), marked).when(F.size(inner) > 0, F.concat(F.when(outer != "", F.array(outer)).otherwise(none), inner)).otherwise(none)


def old_strip_legal(c: Column) -> Column:
    """Legal words removed anywhere."""
    words = "|".join(re.escape(w) for w in T.OLD_LEGAL_WORDS)
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?iU)\b(?:{words})\b", " "), r"\s+", " "))


def old_street_words(clean: Column) -> Column:
    for short, word in T.OLD_STREET_WORDS.items():
        clean = F.regexp_replace(clean, rf"\b{short}\b", word)
    return clean


def old_house_numbers(raw: Column) -> Column:
    """Numbers and joined pairs; bare ones of 5 or 6 digits are taken for postal codes. Leading zeros go."""
    found = F.filter(F.regexp_extract_all(raw, F.lit(r"\b\d+(?:[/-]\d+)?\b"), F.lit(0)), lambda x: ~x.rlike(r"^\d{5,6}$"))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\b0+(?=\d)", "")))


def old_postal_code(raw: Column, country: Column) -> Column:
    """One code by the country's format; null if none is there."""
    c = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    pick = lambda p: F.regexp_extract(raw, p, 0)
    got = F.when(c.isin("INDIA", "IN"), pick(r"\b[1-9]\d{5}\b")).when(c.isin("FRANCE", "FR"), pick(r"\b(?:0[1-9]|[1-8]\d|9[0-8])\d{3}\b")).when(c.isin("US", "USA", "UNITED STATES"), F.regexp_extract(raw, r"\b(\d{5})(?:-\d{4})?\b", 1)).otherwise(pick(r"\b\d{5,6}\b"))
    return F.when(got != "", got)


# -- secondary identity -------------------------------------------------------------------------


def identity_key(c: Column) -> Column:
    """Lower case, word characters only, one space between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def identity_domain(raw: Column) -> Column:
    return identity_key(F.regexp_extract(raw, "(?i)" + T.EMBEDDED_DOMAIN, 1))


def identity_aliases(raw: Column) -> Column:
    got = [identity_key(F.regexp_replace(F.regexp_extract(raw, "(?i)" + p, 1), "(?i)" + T.EMBEDDED_DOMAIN, " ")) for p in T.IDENTITY_ALIASES]
    return F.array_distinct(F.filter(F.array(*got), lambda a: a != ""))


def identity_keys(raw: Column) -> Column:
    d = identity_domain(raw)
    first = F.when(d != "", F.array(F.concat(F.lit("domain:"), d))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.transform(identity_aliases(raw), lambda a: F.concat(F.lit("alias:"), a))))
