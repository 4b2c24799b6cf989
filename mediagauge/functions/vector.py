"""Vector expressions on arrays of numbers, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Cosine similarity; ``empty`` where a vector is null or has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(empty))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within 0..2, four decimals; 1 where a vector is null or has no length."""
    distance = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - cosine(a, b)))
    usable = a.isNotNull() & b.isNotNull() & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, F.round(distance, 4)).otherwise(F.lit(1.0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def softmax(values: list[Column], sharpness: float = 5.0, digits: int = 4) -> list[Column]:
    """Shares in proportion to exp(sharpness * value)."""
    powers = [F.exp(F.lit(sharpness) * v) for v in values]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [F.round(p / total, digits) for p in powers]
