"""Records to normalised records: clean and core names, tokens, aliases, domains, streets, house numbers, codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as X


def _none() -> Column:
    return F.array().cast("array<string>")


def normalize(records: DataFrame, unicode: bool = True) -> DataFrame:
    """Adds the normalised columns to (entity_id, business_name, business_address, country).

    With ``unicode``, texts of other scripts than Latin go through Python, all others stay within codegen.  Without,
    everything is folded natively, which is exact for ASCII and accented Latin letters.
    """
    fold = X.fold_any if unicode else X.fold_latin
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    df = records.withColumns({"_name": name, "_address": address, "_country": fold(F.coalesce("country", F.lit("")))})
    df = df.withColumns({"country_code": X.canonical_country(F.col("_country")), "name_clean": fold(F.col("_name")), "domains": X.domains(F.col("_name")), "_bare": fold(X.without_domains(F.col("_name"))), "_street": fold(F.col("_address"))})
    df = df.withColumns({"name_core": X.strip_legal(F.col("_bare"), F.col("country_code")), "_parts": X.alias_parts(X.without_domains(F.col("_name")))})
    df = df.withColumn("name_tokens", X.tokens(F.col("name_core")))
    if unicode:
        marked = F.size("_parts") > 0  # the parts of a name go through Python in one call, names without a marker not at all
        df = df.withColumn("_folded", F.when(marked, _fold_all(F.when(marked, F.col("_parts")))).otherwise(F.col("_parts")))
        df = df.withColumn("_latin", X.transliterated(F.col("_name")))
        df = df.withColumn("_latin", F.when(F.col("_latin") != F.col("_name"), X.fold_any(F.col("_latin"))).otherwise(F.lit("")))
    else:
        df = df.withColumn("_folded", F.transform("_parts", lambda p: X.fold_latin(p))).withColumn("_latin", F.lit(""))
    df = df.withColumn("_latin", F.when(F.col("_latin") != F.col("name_clean"), F.col("_latin")).otherwise(F.lit("")))
    both = F.flatten(F.transform("_folded", lambda p: F.array(p, X.strip_legal(p, F.col("country_code")))))
    df = df.withColumns(
        {
            "sorted_tokens": F.array_sort("name_tokens"),
            "aliases": F.array_distinct(F.filter(both, lambda a: a != "")),
            "domain_names": F.array_distinct(F.filter(F.transform("domains", lambda d: X.domain_base(d)), lambda d: d != "")),
            "name_char3": X.char_ngrams(F.col("name_core"), 3),
            "name_char4": X.char_ngrams(F.col("name_core"), 4),
            "translit_core": X.strip_legal(F.col("_latin"), F.col("country_code")),
            "street_tokens": X.street_tokens(F.col("_street")),
            "house_numbers": X.house_numbers_of(F.col("_address")),
            "postal_codes": X.postal_codes(F.col("_address")),
        }
    )
    df = df.withColumns({"translit_tokens": X.tokens(F.col("translit_core")), "street_core": F.array_join("street_tokens", " ")})
    df = df.withColumns({"address_char3": X.char_ngrams(F.col("street_core"), 3), "address_char4": X.char_ngrams(F.col("street_core"), 4), "name_prefix": F.left(F.replace("name_core", F.lit(" "), F.lit("")), F.lit(4)), "street_prefix": F.left(F.replace("street_core", F.lit(" "), F.lit("")), F.lit(3))})
    return df.drop("_name", "_address", "_country", "_bare", "_street", "_parts", "_folded", "_latin")


@F.pandas_udf(ArrayType(StringType()))
def _fold_all(parts: pd.Series) -> pd.Series:
    return pd.Series([None if ps is None else [X.fold(p) for p in ps] for ps in parts])


def normalize_old(records: DataFrame) -> DataFrame:
    """The older normaliser's view: legal words removed anywhere, tokens of 2 letters or more, one postal code."""
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    df = records.withColumns({"clean": X.old_clean(name), "domain": X.old_domain(name), "aliases": F.transform(X.old_alias_parts(name), lambda p: F.lower(p)), "address_clean": X.old_street_words(X.old_clean(address)), "house_numbers": X.old_house_numbers(address), "postal_code": X.old_postal_code(address, F.col("country"))})
    df = df.withColumns({"core": X.old_strip_legal(F.col("clean")), "address_tokens": F.filter(X.tokens(F.col("address_clean")), lambda t: F.length(t) >= 2)})
    words = F.filter("address_tokens", lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    return df.withColumns({"tokens": F.filter(X.tokens(F.col("clean")), lambda t: F.length(t) >= 2), "name_prefix": F.left(F.replace("core", F.lit(" "), F.lit("")), F.lit(4)), "name_char3": X.char_ngram_list(F.col("core"), 3), "name_char4": X.char_ngram_list(F.col("core"), 4), "street_core": F.array_join(F.slice(words, 1, 3), " "), "address_char3": X.char_ngram_list(F.col("address_clean"), 3)})
