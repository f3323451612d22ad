"""Dense vector expressions over ``array<float|double>`` columns.

Spark 4.1 has no vector_* SQL functions, so these are higher-order array
expressions; they stay in whole-stage codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Divide by the norm; a zero vector is returned unchanged (norm treated as 1)."""
    n = l2_norm(a)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(a, lambda x: (x.cast("double") / safe).cast("float"))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b) + F.lit(eps))


def round_vector(a: Column, places: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), places))
