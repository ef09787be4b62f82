"""Vector arithmetic on array<double> columns, without UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty vector, unequal lengths or a zero norm; null if either is null."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(usable, dot(a, b) / scale).otherwise(0.0)


def normalised(a: Column) -> Column:
    """The vector divided by its length; unchanged if that is 0."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)
