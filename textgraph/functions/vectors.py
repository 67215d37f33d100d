"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 where the lengths differ, a vector is null or has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), F.lit(0.0))
