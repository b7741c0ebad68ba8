"""Scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_probability(p: Column) -> Column:
    """Natural log, minus infinity for zero (Spark's ``ln(0)`` is null)."""
    return F.when(p > 0, F.ln(p)).when(p.isNotNull(), F.lit(float("-inf")))
