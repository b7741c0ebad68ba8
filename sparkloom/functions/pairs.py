"""Pairs of nodes without a direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unordered(a: str, b: str) -> Column:
    """(lo, hi) of two columns, null below all: the same for (a, b) and (b, a)."""
    x, y = F.col(a), F.col(b)
    first = F.coalesce(x <= y, x.isNull())
    return F.struct(F.when(first, x).otherwise(y).alias("lo"), F.when(first, y).otherwise(x).alias("hi"))


def directions(a: str, b: str) -> Column:
    """One row for each direction of the pair ``lo``, ``hi``, as (a, b); a single one for a node with itself."""
    there = F.struct(F.col("lo").alias(a), F.col("hi").alias(b))
    back = F.struct(F.col("hi").alias(a), F.col("lo").alias(b))
    return F.explode(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.array(there)).otherwise(F.array(there, back)))
