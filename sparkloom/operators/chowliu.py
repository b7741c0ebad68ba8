"""Chow-Liu structure learning: mutual information and its maximum spanning tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.counts import as_labels
from sparkloom.operators.forest import orient, spanning_tree
from sparkloom.operators.labelsets import count_pairs
from sparkloom.session import materialise


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Label counts ``(u, v, a, b, n)`` of every pair of columns, in one pass, for any number of columns.

    Rows with a null in a pair are left out of that pair only.
    """
    names = sorted(columns)
    return count_pairs(as_labels(df, names), names)


def mutual_information(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(u, v, mi)`` in nats for every pair of columns ``u < v``.

    ``MI = H(u) + H(v) − H(u, v)``, and each entropy is a sum of ``n ln n`` over counts.
    Cells and both marginals come from one grouping-sets pass over the pair cells, so
    no pair is ever gathered in one task.
    """
    cells = pair_counts(df, columns or df.columns)
    keys = ["u", "v", "a", "b"]
    sets = [keys, ["u", "v", "a"], ["u", "v", "b"]]
    counted = cells.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.sum("n").alias("n"), F.grouping_id().alias("gid")
    )
    joint = F.col("gid") == 0
    n_ln_n = F.col("n") * F.ln(F.col("n").cast("double"))
    total = F.sum(F.when(joint, F.col("n")))
    signed = F.sum(F.when(joint, n_ln_n).otherwise(-n_ln_n))
    return counted.groupBy("u", "v").agg(
        (signed / total + F.ln(total.cast("double"))).alias("mi")
    )


def ranked_edges(mi: DataFrame) -> DataFrame:
    return mi.orderBy(F.desc("mi"), "u", "v")


def chow_liu(df: DataFrame, root: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Edges ``(parent, child)`` of the best tree, directed away from ``root``.

    ``root`` defaults to the first column.
    """
    columns = columns or df.columns
    mi = materialise(mutual_information(df, columns), "mi")
    tree = spanning_tree(mi, weight="mi")
    return orient(tree, root or columns[0])
