"""Numbers, vocabularies, arrays and maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def now_utc() -> Column:
    """The time of the query in UTC, to the second, as text."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def unit(weight: Column, norm: Column) -> Column:
    """weight / norm; unchanged where the norm is zero."""
    return F.when(norm > 0, weight / norm).otherwise(weight)


def confidence(raw: Column, places: int | None = None) -> Column:
    """A number clamped to 0..1; null if it is none."""
    number = raw.try_cast("double")
    out = F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return out if places is None else F.round(out, places)


def allowed_or(value: Column, allowed: list[str], fallback: str) -> Column:
    """The value if the vocabulary has it exactly, else the fallback (also for null)."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(fallback))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0).cast("double"), lambda s, x: s + x)


def unit_array(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def properties(**columns: Column) -> Column:
    """array<struct<key, value>> of the columns that are not null, as text, in order of their names."""
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in sorted(columns.items()))))
