"""Family counts: the sufficient statistics of a network, in one table.

Columns: ``node``, one string column per variable (null when the variable is not
in the node's family), ``n``. Integer counts are stored and probabilities derived,
so that merging batches is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.labelsets import count_sets
from sparkloom.operators.network import Network


def as_labels(df: DataFrame, variables: list[str]) -> DataFrame:
    return df.select(*[F.col(v).cast("string").alias(v) for v in variables])


def family_counts(df: DataFrame, net: Network) -> DataFrame:
    """Count every family of ``net`` in one pass over ``df``, for any number of variables.

    Rows with a null in a family are left out of that family only.
    """
    variables, nodes = sorted(net.nodes), net.nodes
    families = [net.family(n) for n in nodes]
    counted = count_sets(as_labels(df, variables), families)
    # label of each variable by its place in the family; null outside the family
    given = F.element_at(F.array(*[F.array(*[F.lit(v) for v in family]) for family in families]), F.col("at") + 1)
    rows = counted.select("at", "n", F.map_from_arrays(given, F.col("labels")).alias("family"))
    return rows.select(
        F.element_at(F.array(*[F.lit(n) for n in nodes]), F.col("at") + 1).alias("node"), *[F.col("family")[v].alias(v) for v in variables], "n"
    )


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Add count tables of the same network."""
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    keys = [c for c in stacked.columns if c != "n"]
    return stacked.groupBy(*keys).agg(F.sum("n").alias("n"))


def prior_counts(counts: DataFrame, net: Network, weight: int) -> DataFrame:
    """``weight`` for every combination of observed labels, per child family.

    Labels are read from the counts, not from the data. The table is the Cartesian
    product of label sets by definition.
    """
    variables = sorted(net.nodes)
    tables = []
    for node in net.nodes:
        if not net.parents[node]:
            continue
        grid = None
        for var in net.family(node):
            seen = counts.where(F.col("node") == var).select(var).distinct()
            grid = seen if grid is None else grid.crossJoin(seen)
        tables.append(
            grid.select(
                F.lit(node).alias("node"),
                *[(F.col(v) if v in net.family(node) else F.lit(None).cast("string")).alias(v)
                  for v in variables],
                F.lit(weight).cast("bigint").alias("n"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), tables) if tables else counts.limit(0)


def node_counts(counts: DataFrame, net: Network, node: str) -> DataFrame:
    return counts.where(F.col("node") == node).select(*net.family(node), "n")


def conditional(counts: DataFrame, net: Network, node: str) -> DataFrame:
    """Factor ``P(node | parents)`` with columns parents, node, ``p``."""
    rows = node_counts(counts, net, node)
    given = net.parents[node]
    if given:
        total = F.sum("n").over(Window.partitionBy(*given))
    else:
        total = rows.agg(F.sum("n").alias("total")).scalar()
    return rows.select(*net.family(node), (F.col("n") / total).alias("p"))


def cumulative(counts: DataFrame, net: Network, node: str) -> DataFrame:
    """Half-open integer intervals ``[lo, hi)`` of each conditional distribution."""
    rows = node_counts(counts, net, node)
    given = net.parents[node]
    upto = Window.partitionBy(*given).orderBy(node).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("n").over(upto)
    return rows.select(
        *given, node, (hi - F.col("n")).alias("lo"), hi.alias("hi"),
        F.sum("n").over(Window.partitionBy(*given)).alias("total"),
    )
