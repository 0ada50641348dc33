"""Vectors as array columns; products are accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """To unit length, as floats; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))
