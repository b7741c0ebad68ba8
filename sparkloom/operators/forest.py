"""Components, spanning trees and orientation on edge tables.

All three contract the graph: every component picks a neighbour, chains of picks
are shortened by pointer jumping, and the edge table shrinks to the edges that
still join different components. Rounds grow with the logarithm of the graph in
practice, not with its diameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise


def _jump(hooks: DataFrame) -> DataFrame:
    """Follow ``(comp, target)`` pointers to their roots; roots point at themselves."""
    while True:
        up = hooks.select(F.col("comp").alias("target"), F.col("target").alias("next"))
        step = hooks.join(up, "target", "left").select(
            "comp", F.coalesce("next", "target").alias("new"), "target"
        )
        step = materialise(step, "jump")
        moved = step.where(F.col("new") != F.col("target")).limit(1).count()
        hooks = step.select("comp", F.col("new").alias("target"))
        if not moved:
            return hooks


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Replace the component columns ``cu``, ``cv`` by their roots and drop inner edges."""
    for side in ("cu", "cv"):
        to = roots.select(F.col("comp").alias(side), F.col("target").alias("__root"))
        edges = edges.join(to, side, "left").withColumn(
            side, F.coalesce("__root", side)
        ).drop("__root")
    return edges.where(F.col("cu") != F.col("cv"))


def _compose(labels: DataFrame, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("comp").alias("component"), F.col("target").alias("__root"))
    return labels.join(to, "component", "left").select(
        "node", F.coalesce("__root", "component").alias("component")
    )


def components(edges: DataFrame, u: str = "u", v: str = "v", nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)``: the component is the smallest node name in it.

    ``nodes`` has a column ``node``; those without an edge are components of their own. Without it,
    only nodes with an edge are known.
    """
    pairs = edges.select(F.col(u).alias("cu"), F.col(v).alias("cv"))
    known = pairs.select(F.explode(F.array("cu", "cv")).alias("node"))
    if nodes is not None:
        known = known.unionByName(nodes.select("node"))
    labels = materialise(known.distinct().withColumn("component", F.col("node")), "labels")
    active = materialise(
        pairs.select(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
        .where(F.col("cu") != F.col("cv")).distinct(), "contracted"
    )
    while True:
        if active.isEmpty():
            return labels
        # the larger end hooks to its smallest neighbour; local minima stay roots
        hooks = active.groupBy(F.col("cv").alias("comp")).agg(F.min("cu").alias("target"))
        roots = _jump(materialise(hooks, "hooks"))
        labels = materialise(_compose(labels, roots), "labels")
        moved = _relabel(active, roots)
        active = materialise(
            moved.select(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
            .distinct(), "contracted"
        )


def largest_component(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Edges of the component with most nodes (ties: smallest name)."""
    labels = components(edges, u, v)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.min(F.struct((-F.col("n")).alias("neg"), "component")).alias("m"))
    keep = best.select(F.col("m.component").alias("component"))
    inside = labels.join(keep, "component", "left_semi").select(F.col("node").alias(u))
    return edges.join(inside, u, "left_semi")


def spanning_tree(edges: DataFrame, weight: str, u: str = "u", v: str = "v") -> DataFrame:
    """Maximum spanning tree (a forest if the graph is not connected): ``(u, v, weight)``.

    Edges follow the strict order (weight descending, u, v), so equal weights
    cannot close a cycle.
    """
    active = edges.select(
        F.col(u).alias("cu"), F.col(v).alias("cv"),
        F.struct((-F.col(weight)).alias("neg"), F.col(u).alias("u"), F.col(v).alias("v")).alias("edge"),
    ).where(F.col("cu") != F.col("cv"))
    active = materialise(active, "active")
    chosen = []
    while True:
        if active.isEmpty():
            break
        ends = active.select(
            F.explode(
                F.array(
                    F.struct(F.col("cu").alias("comp"), F.col("cv").alias("other"), "edge"),
                    F.struct(F.col("cv").alias("comp"), F.col("cu").alias("other"), "edge"),
                )
            ).alias("e")
        ).select("e.*")
        best = ends.groupBy("comp").agg(F.min(F.struct("edge", "other")).alias("b"))
        best = materialise(best.select("comp", "b.edge", F.col("b.other").alias("target")), "best")
        chosen.append(best.select("edge"))
        # two components that pick the same edge: the smaller name becomes the root
        back = best.select(F.col("comp").alias("target"), F.col("target").alias("back"))
        hooks = best.join(back, "target", "left").select(
            "comp",
            F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("target")), F.col("comp"))
            .otherwise(F.col("target")).alias("target"),
        )
        roots = _jump(materialise(hooks, "hooks"))
        active = materialise(_relabel(active, roots), "active")
    if not chosen:
        return edges.select(u, v, weight).limit(0)
    edge = reduce(lambda a, b: a.unionByName(b), chosen).distinct()
    return edge.select(
        F.col("edge.u").alias(u), F.col("edge.v").alias(v), (-F.col("edge.neg")).alias(weight)
    )


def orient(tree: DataFrame, root: str, u: str = "u", v: str = "v") -> DataFrame:
    """Direct tree edges away from ``root``: ``(parent, child)``. Raises if the edges hold a cycle."""
    both = materialise(
        tree.select(F.explode(F.array(F.struct(F.col(u).alias("parent"), F.col(v).alias("child")),
                                      F.struct(F.col(v).alias("parent"), F.col(u).alias("child"))))
                    .alias("e")).select("e.*"), "both"
    )
    frontier = both.where(F.col("parent") == F.lit(root))
    layers, directed, edges = [], 0, tree.count()
    while True:
        frontier = materialise(frontier, "layer")
        found = frontier.count()
        if not found:
            break
        directed += found
        if directed > edges:  # each edge of a tree is directed once
            raise ValueError("the edges hold a cycle")
        layers.append(frontier)
        reached = frontier.select(F.col("child").alias("parent"), F.col("parent").alias("came"))
        frontier = both.join(reached, "parent").where(F.col("child") != F.col("came")).select(
            "parent", "child"
        )
    if not layers:
        return both.limit(0)
    return reduce(lambda a, b: a.unionByName(b), layers)
