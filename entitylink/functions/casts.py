"""Lenient casts: what cannot be read is a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column, default: float = 0.0) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def to_int(c: Column, default: int = 0) -> Column:
    """Numbers with a fraction are cut."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))


def to_bool(c: Column) -> Column:
    """True for 1, true, yes and y in any case, and for numbers equal to 1."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce(t.isin("1", "true", "yes", "y") | (c.try_cast("double") == 1), F.lit(False))
