"""Features of candidate pairs: joins of both records, then one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S

#: The columns and their order (fixed: stored models name their inputs by place).
BINARY = (
    "country_match", "country_conflict", "country_missing_either", "name_exact", "address_exact", "name_address_exact",
    "house_exact", "postal_exact", "domain_exact", "alias_exact", "name_nonempty_both", "address_nonempty_both",
    "domain_available_both", "alias_available_both", "name_address_both_available", "blocking_hit_count", "blocking_strategy_count",
)
NUMERIC = (
    "name_jaro_winkler", "name_edit_similarity", "name_token_jaccard", "name_token_containment", "name_sorted_token_jaccard",
    "name_char3_jaccard", "name_char4_jaccard", "name_length_ratio", "address_edit_similarity", "address_token_jaccard",
    "address_token_containment", "address_char3_jaccard", "address_char4_jaccard", "address_length_ratio", "house_overlap",
    "postal_overlap", "domain_jaccard", "alias_jaccard", "combined_evidence_count", "strong_evidence_count", "missing_field_count",
)
ALL = BINARY + NUMERIC
IDS = ("source1_id", "target_source", "target_id")
_SIDE = ("country_code", "name_core", "street_core", "name_tokens", "sorted_tokens", "street_tokens", "name_char3", "name_char4", "address_char3", "address_char4", "house_numbers", "postal_codes", "domains", "aliases")


def _flag(c: Column) -> Column:
    return c.cast("int")


#: A side up to so many bytes, as estimated from its texts, is sent to all executors; larger ones are shuffled.
BROADCAST = 128 << 20
#: Bytes of a record's arrays for each character of its name and address: two sets of n-grams of some 24 bytes each, and words.
_PER_CHARACTER = 64


def _fit(side: DataFrame) -> bool:
    """Whether a side may be broadcast: its size is counted, one pass over two columns."""
    n = side.agg(F.sum(F.length("name_core") + F.length("street_core") + 16)).first()[0] or 0
    return n * _PER_CHARACTER < BROADCAST


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, truth: DataFrame | None = None, hits: bool = False, jaro: bool = True) -> DataFrame:
    """The ids, 38 features and, with ``truth`` (source1_id, target_id), the label of each pair.

    A pair of which a record is missing is dropped.  Unless ``hits`` is set, the hit counts are 1: a pair is
    stored once, under its first strategy.  Fractions are rounded half-even to 8 places.  Without ``jaro``,
    name_jaro_winkler, the one feature that Python computes, is left out.  The names' distances are not computed again
    where ``pairs`` has them (edits).
    """
    more = ["hits"] * hits + [c for c in pairs.columns if c == "edits"]
    small = [F.broadcast if _fit(side) else (lambda d: d) for side in (s1, targets)]
    if jaro:
        # names only: the rows that wait for Python hold no arrays
        left = s1.select(F.col("entity_id").alias("source1_id"), F.col("name_core").alias("_l"))
        right = targets.select(F.col("source").alias("target_source"), F.col("entity_id").alias("target_id"), F.col("name_core").alias("_r"))
        named = pairs.select(*IDS, *more).join(small[0](left), "source1_id").join(small[1](right), ["target_source", "target_id"])
        pairs = named.withColumn("name_jaro_winkler", F.bround(S.jaro_winkler_of(F.col("_l"), F.col("_r")), 8)).drop("_l", "_r")
    a = s1.select(F.col("entity_id").alias("source1_id"), *[F.col(c).alias(f"a_{c}") for c in _SIDE])
    b = targets.select(F.col("source").alias("target_source"), F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"b_{c}") for c in _SIDE])
    p = pairs.select(*IDS, *more, *(["name_jaro_winkler"] if jaro else [])).join(small[0](a), "source1_id").join(small[1](b), ["target_source", "target_id"])
    both = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    ca, cb = both("country_code")
    na, nb = both("name_core")
    sa, sb = both("street_core")
    shares = lambda c: F.arrays_overlap(*both(c))
    full = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0)
    known = lambda c: ~c.isin("", "unknown")
    f = {
        "country_match": (ca == cb) & known(ca), "country_conflict": (ca != cb) & known(ca) & known(cb), "country_missing_either": ~(known(ca) & known(cb)),
        "name_exact": (na == nb) & (na != ""), "address_exact": (sa == sb) & (sa != ""), "name_address_exact": (na == nb) & (na != "") & (sa == sb) & (sa != ""),
        "house_exact": shares("house_numbers"), "postal_exact": shares("postal_codes"), "domain_exact": shares("domains"), "alias_exact": shares("aliases"),
        "name_nonempty_both": (na != "") & (nb != ""), "address_nonempty_both": (sa != "") & (sb != ""), "domain_available_both": full("domains"), "alias_available_both": full("aliases"),
        "name_address_both_available": (na != "") & (nb != "") & (sa != "") & (sb != ""),
    }
    p = p.withColumns({k: _flag(F.coalesce(v, F.lit(False))) for k, v in f.items()})
    n = F.col("hits").cast("int") if hits else F.lit(1)
    r = lambda c: F.bround(c, 8)
    p = p.withColumns(
        {
            "blocking_hit_count": n, "blocking_strategy_count": n,
            "name_edit_similarity": r(S.edit_similarity(na, nb, F.col("edits") if "edits" in more else None)), "name_token_jaccard": r(S.jaccard(*both("name_tokens"))), "name_token_containment": r(S.containment(*both("name_tokens"))),
            "name_sorted_token_jaccard": r(S.jaccard(*both("sorted_tokens"))), "name_char3_jaccard": r(S.set_jaccard(*both("name_char3"))), "name_char4_jaccard": r(S.set_jaccard(*both("name_char4"))), "name_length_ratio": r(S.ratio(F.length(na), F.length(nb))),
            "address_edit_similarity": r(S.edit_similarity(sa, sb)), "address_token_jaccard": r(S.jaccard(*both("street_tokens"))), "address_token_containment": r(S.containment(*both("street_tokens"))), "address_char3_jaccard": r(S.set_jaccard(*both("address_char3"))),
            "address_char4_jaccard": r(S.set_jaccard(*both("address_char4"))), "address_length_ratio": r(S.ratio(F.length(sa), F.length(sb))), "house_overlap": r(S.containment(*both("house_numbers"))), "postal_overlap": r(S.containment(*both("postal_codes"))),
            "domain_jaccard": r(S.set_jaccard(*both("domains"))), "alias_jaccard": r(S.set_jaccard(*both("aliases"))),
        }
    )
    i = F.col
    strong = i("name_exact") + i("address_exact") + i("house_exact") * i("postal_exact") + i("domain_exact") + i("alias_exact")
    combined = i("name_exact") + i("address_exact") + _flag(i("name_token_jaccard") >= 0.8) + _flag(i("address_token_jaccard") >= 0.8) + i("house_exact") + i("postal_exact") + i("domain_exact") + i("alias_exact") + i("country_match")
    missing = _flag(i("name_nonempty_both") == 0) + _flag(i("address_nonempty_both") == 0) + _flag(~full("house_numbers")) + _flag(~full("postal_codes"))
    p = p.withColumns({"strong_evidence_count": strong, "combined_evidence_count": combined, "missing_field_count": missing})
    cols = [c for c in ALL if jaro or c != "name_jaro_winkler"]
    if truth is None:
        return p.select(*IDS, *cols)
    t = truth.select("source1_id", "target_id").distinct().withColumn("label", F.lit(1))
    return p.join(t, ["source1_id", "target_id"], "left").select(*IDS, *cols, F.coalesce("label", F.lit(0)).alias("label"))


#: Which of the extra features a variant keeps; the others are 0.
VARIANTS = {"e0": (), "e1": S.EXTRA[:2], "e2": S.EXTRA[2:], "e3": S.EXTRA}


def names_of(names: DataFrame, order: str | None = None) -> DataFrame:
    """(entity_id, n): of an id that repeats, the name of the last row by the column ``order`` (without one, the largest name)."""
    names = names.where(F.trim("entity_id") != "")
    return names.groupBy(F.trim("entity_id").alias("entity_id")).agg((F.max_by("business_name", order) if order else F.max("business_name")).alias("n"))


def repeated(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each pair of rows, where ids repeat; without such ids the pairs as they are."""
    for side, ids in ((s1.select(F.col("entity_id").alias("source1_id")), ["source1_id"]), (targets.select(F.col("source").alias("target_source"), F.col("entity_id").alias("target_id")), ["target_source", "target_id"])):
        many = side.groupBy(*ids).agg((F.count(F.lit(1)) - 1).alias("_more")).where("_more > 0")
        if many.limit(1).count():
            each = F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)).cast("int")))
            pairs = pairs.join(many, ids, "left").select(*pairs.columns, each.alias("_copy")).drop("_copy")
    return pairs


def augment(features: DataFrame, names: DataFrame, variant: str = "e3", order: str | None = None) -> DataFrame:
    """Adds the evidence features from raw names (entity_id, business_name); a missing name is empty.

    Of an id that repeats, the name of the last row by the column ``order`` counts (without one, the largest name).
    """
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}; there are {sorted(VARIANTS)}")
    if variant == "e0":
        return features.withColumns({c: F.lit(0.0) for c in S.EXTRA})
    one = names_of(names, order)
    p = features.join(one.select(F.col("entity_id").alias("source1_id"), F.col("n").alias("_l")), "source1_id", "left").join(one.select(F.col("entity_id").alias("target_id"), F.col("n").alias("_r")), "target_id", "left")
    p = p.withColumn("_e", S.pair_evidence_of(F.coalesce("_l", F.lit("")), F.coalesce("_r", F.lit(""))))
    return p.select(*features.columns, *[(F.col(f"_e.{c}") if c in VARIANTS[variant] else F.lit(0.0)).alias(c) for c in S.EXTRA])


def hardness() -> Column:
    """How much a negative pair looks like a match."""
    sims = [F.col(c).cast("double") for c in ("name_jaro_winkler", "name_token_jaccard", "name_char4_jaccard", "address_token_jaccard", "address_char4_jaccard", "domain_jaccard", "alias_jaccard")]
    return 0.65 * F.greatest(*sims) + 0.25 * sum(sims[1:], sims[0]) / len(sims) + 0.10 * F.col("combined_evidence_count") / 9


def difficulty() -> Column:
    """The older measure of the same."""
    return 3 * F.col("name_jaro_winkler") + 2.5 * F.col("address_edit_similarity") + 2 * F.col("name_token_jaccard") + 1.5 * F.col("address_token_jaccard") + 0.5 * F.col("combined_evidence_count") + F.col("strong_evidence_count") + 0.2 * F.col("blocking_hit_count")
