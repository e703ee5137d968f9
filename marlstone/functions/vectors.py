"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    """A vector as a constant."""
    return F.lit([float(v) for v in values]).cast("array<double>") if len(values) else F.array().cast("array<double>")


def doubles(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_clamped(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 for vectors without length; an error for vectors of different sizes."""
    same = F.size(a) == F.size(b)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def l2_score(a: Column, b: Column) -> Column:
    """The negative squared distance: larger is nearer."""
    return -F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(doubles(a), lambda x: x / length)).otherwise(doubles(a))
