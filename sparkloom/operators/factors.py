"""Factor tables: label columns plus one probability column ``p``.

A factor maps a tuple of labels to a number. The algebra below is plain joins and
aggregations, so Catalyst chooses the join strategy from the factor sizes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUE = "p"


def scope(factor: DataFrame) -> list[str]:
    """Variables of a factor."""
    return [c for c in factor.columns if c != VALUE]


def drop_zeros(factor: DataFrame) -> DataFrame:
    return factor.where(F.col(VALUE) > 0)


def restrict(factor: DataFrame, event: Mapping[str, str]) -> DataFrame:
    """Keep the rows that agree with ``event``; the columns stay."""
    for var in scope(factor):
        if var in event:
            factor = factor.where(F.col(var) == F.lit(str(event[var])))
    return factor


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pointwise product: equi-join on the shared variables.

    Factors without a shared variable multiply to the Cartesian product of their
    rows; that product is the result itself, not an intermediate.
    """
    shared = [v for v in scope(left) if v in scope(right)]
    other = right.withColumnRenamed(VALUE, "__q")
    joined = left.join(other, shared) if shared else left.crossJoin(other)
    names = scope(left) + [v for v in scope(right) if v not in shared]
    return joined.select(*names, (F.col(VALUE) * F.col("__q")).alias(VALUE))


def product_all(factors: Iterable[DataFrame], keep_zeros: bool = False) -> DataFrame:
    """Fold :func:`product`, taking connected factors first to avoid products of strangers."""
    todo = list(factors) if keep_zeros else [drop_zeros(f) for f in factors]
    result = todo.pop(0)
    while todo:
        known = set(scope(result))
        pick = next((f for f in todo if known & set(scope(f))), todo[0])
        todo = [f for f in todo if f is not pick]
        result = product(result, pick)
    return result


def sum_out(factor: DataFrame, *variables: str) -> DataFrame:
    """Marginalise ``variables`` away."""
    missing = [v for v in variables if v not in scope(factor)]
    if missing:
        raise ValueError(f"not in the factor: {missing}")
    rest = [v for v in scope(factor) if v not in variables]
    return factor.groupBy(*rest).agg(F.sum(VALUE).alias(VALUE))


def normalise(factor: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Scale to total 1, over the whole factor or within each tuple of ``within``."""
    if within:
        total = F.sum(VALUE).over(Window.partitionBy(*within))
    else:
        total = factor.agg(F.sum(VALUE).alias("total")).scalar()
    return factor.select(*scope(factor), (F.col(VALUE) / total).alias(VALUE))


def eliminate(factors: list[DataFrame], hidden: Iterable[str]) -> list[DataFrame]:
    """Sum the hidden variables out one by one.

    Each step joins only the factors that mention the variable and aggregates at
    once, so intermediates stay as small as the order allows. The order takes the
    variable with the fewest neighbours first, names break ties.
    """
    factors = list(factors)
    left = set(hidden)
    while left:
        def neighbours(var: str) -> int:
            return len(set().union(*[scope(f) for f in factors if var in scope(f)], set()))

        var = min(left, key=lambda v: (neighbours(v), v))
        left.discard(var)
        touching = [f for f in factors if var in scope(f)]
        factors = [f for f in factors if var not in scope(f)]
        if touching:
            merged = reduce(product, [drop_zeros(f) for f in touching])
            factors.append(sum_out(merged, var))
    return factors
