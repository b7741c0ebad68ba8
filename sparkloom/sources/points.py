"""Numeric point tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV → ``(id, x)``; refuses files with nulls or text.

    Ids are unique but not consecutive.
    """
    raw = spark.read.csv(path, header=False, inferSchema=True)
    require_numeric(raw)
    x = F.array(*[F.col(c).cast("double") for c in raw.columns])
    return raw.select(F.monotonically_increasing_id().alias("id"), x.alias("x"))


def bad_cells(df: DataFrame) -> DataFrame:
    """One row: nulls and non-numeric cells per column, in one pass."""
    checks = []
    for c in df.columns:
        value = F.col(c).cast("string").try_cast("double")
        checks.append(F.count_if(F.col(c).isNull()).alias(f"{c}_null"))
        checks.append(F.count_if(F.col(c).isNotNull() & value.isNull()).alias(f"{c}_text"))
    return df.agg(*checks)


def require_numeric(df: DataFrame) -> None:
    found = {k: v for k, v in bad_cells(df).first().asDict().items() if v}
    if found:
        raise ValueError(f"input has unusable cells: {found}")


def all_present(columns: list[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
