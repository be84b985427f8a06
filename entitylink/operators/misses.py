"""True pairs that blocking misses, with both records and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def misses(truth: DataFrame, baseline: DataFrame, enhanced: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs in neither candidate set; records that are not found have empty fields."""
    k = ["source1_id", "target_id"]
    gone = truth.join(baseline.select(*k), k, "left_anti").join(enhanced.select(*k), k, "left_anti")
    side = lambda d, i, p: d.select(F.col("entity_id").alias(i), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"), F.col("country").alias(f"{p}_country"))
    out = gone.join(side(s1, "source1_id", "source1"), "source1_id", "left").join(side(targets, "target_id", "target"), "target_id", "left")
    text = [f"{p}_{c}" for c in ("name", "address", "country") for p in ("source1", "target")]
    return out.select(*k, "target_source", *[F.coalesce(c, F.lit("")).alias(c) for c in text], F.lit(False).alias("baseline_present"), F.lit(False).alias("enhanced_present"), F.lit("NO_B0_NO_B5").alias("failure_reason"))


def _words(name: Column) -> Column:
    """Distinct words of a raw name in one case."""
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def name_kind(a: Column, b: Column) -> Column:
    """How two raw names relate; the first that holds."""
    x, y = _words(a), _words(b)
    starts = lambda w: F.transform(F.filter(w, lambda t: F.length(t) >= 4), lambda t: F.left(t, F.lit(4)))
    more, less = F.size(F.array_except(x, y)) == 0, F.size(F.array_except(y, x)) == 0
    return F.when((F.size(x) == 0) | (F.size(y) == 0), "NAME_EMPTY").when(more & less, "NAME_TOKEN_EXACT").when(more | less, "NAME_TOKEN_CONTAINMENT").when(F.arrays_overlap(x, y), "NAME_PARTIAL_OVERLAP").when(F.arrays_overlap(starts(x), starts(y)), "NAME_PREFIX_SIMILAR").otherwise("NAME_NO_TOKEN_OVERLAP")


def country_kind(a: Column, b: Column) -> Column:
    """How two raw countries relate."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    return F.when((x == "") | (y == ""), "COUNTRY_MISSING").when(x == y, "COUNTRY_MATCH").otherwise("COUNTRY_CONFLICT")
