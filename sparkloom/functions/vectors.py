"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[vector_literal(r) for r in rows])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def matvec(matrix: Sequence[Sequence[float]], x: Column) -> Column:
    """Literal matrix (one row per output) times a vector column."""
    return F.transform(matrix_literal(matrix), lambda row: dot(row, x))


def round_vector(x: Column, digits: int) -> Column:
    return F.transform(x, lambda v: F.round(v, digits))


def mean_vector(x: Column, width: int) -> Column:
    """Aggregate: component-wise mean, combined map-side, no explode."""
    return F.array(*[F.avg(x[i]) for i in range(width)])


def sum_vector(x: Column, width: int) -> Column:
    return F.array(*[F.sum(x[i]) for i in range(width)])


def json_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """Constant ``array<array<double>>``; folded to one literal by the optimizer."""
    text = json.dumps([[float(v) for v in row] for row in rows])
    return F.from_json(F.lit(text), "array<array<double>>")


def sum_of_squares(x: Column, width: int) -> Column:
    """Aggregate: sum of squared norms."""
    parts = [F.sum(x[i] * x[i]) for i in range(width)]
    return reduce(lambda a, b: a + b, parts)
