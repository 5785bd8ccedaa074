"""Vector expressions over array<float>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), 0.0).otherwise(dot(a, b) / lengths)


def l2_to_cosine(distance: Column) -> Column:
    """The cosine that a distance means between unit vectors."""
    return 1 - distance * distance / 2


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: (x.cast("double") / n).cast("float"))


def truncated(a: Column, dimensions: int) -> Column:
    """The first dimensions of a nested embedding, scaled to length 1 again."""
    return unit(F.slice(a, 1, dimensions))
