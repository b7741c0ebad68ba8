"""Directed acyclic graphs as edge tables ``(parent, child)`` of any size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.pairs import directions, unordered
from sparkloom.operators.ranking import global_rank
from sparkloom.session import materialise

MERGE_ROUNDS = 16  # rounds whose deltas are read side by side
PART_ROWS = 1 << 19  # rows that one task groups or sorts


def _parts(df: DataFrame, rows: float) -> int:
    """Partitions of about PART_ROWS of ``rows``, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PART_ROWS))


def _distinct(df: DataFrame, rows: float) -> DataFrame:
    """Distinct rows of about ``rows``. They are dealt first, as a task that groups what it reads holds as much as it reads."""
    return df.repartition(_parts(df, rows), *df.columns).distinct()


def edges_from_lists(spec: DataFrame, parents: str = "parents", children: str = "children") -> DataFrame:
    """Rows of (list of parents, list of children) → distinct ``(parent, child)`` pairs."""
    return (
        spec.select(F.explode(parents).alias("parent"), children)
        .select("parent", F.explode(children).alias("child"))
        .distinct()
    )


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without parents."""
    return (
        edges.select(F.col("parent").alias("node")).distinct()
        .join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    )


def ancestors(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(node, ancestor)`` pairs for the nodes in ``of`` (all nodes by default).

    Round k holds the distinct pairs that are k links apart, so a round is never
    larger than the result and the number of rounds is the depth of the graph. With
    all nodes a cycle shows as a node above itself. With ``of`` a round leaves out the
    pairs already known, so a cycle above the chosen nodes ends as well.
    """
    links = edges.select(F.col("child").alias("at"), F.col("parent").alias("ancestor")).distinct()
    links = materialise(links, "links")
    # parents of a node that has any, on average: a round grows about so much
    width = links.agg(F.count("*") / F.greatest(F.approx_count_distinct("at"), F.lit(1))).first()[0]
    first = links.withColumnRenamed("at", "node")
    if of is not None:
        first = first.join(of.select("node").distinct(), "node", "left_semi")
    fresh = materialise(first, "pairs")
    found, total = [], 0
    while True:
        loops, pairs = fresh.agg(F.count_if(F.col("node") == F.col("ancestor")), F.count("*")).first()
        if loops:
            raise ValueError("the graph has a cycle")
        if not pairs:
            break
        found.append(fresh)
        total += pairs
        step = fresh.select("node", F.col("ancestor").alias("at")).join(links, "at")
        step = _distinct(step.select("node", "ancestor"), pairs * width)
        if of is not None:
            known = reduce(lambda a, b: a.unionByName(b), found)
            step = step.join(known, ["node", "ancestor"], "left_anti")
        fresh = materialise(step, "pairs")
    return _distinct(reduce(lambda a, b: a.unionByName(b), found), total) if found else fresh


def relevant(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The target nodes and all their ancestors."""
    up = ancestors(edges, targets).select(F.col("ancestor").alias("node"))
    return targets.select("node").union(up).distinct()


def markov_boundary(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(node, member)``: parents, children and the children's other parents."""
    if of is None:
        # a member's boundary holds the node too, so a pair is found and told apart once, in one direction
        links = edges.select("parent", "child").repartition("child").distinct()
        near = links.select(unordered("parent", "child").alias("p")).select("p.*")
        other = links.select("child", F.col("parent").alias("hi"))
        spouses = links.withColumnRenamed("parent", "lo").join(other, "child").where("lo < hi").select("lo", "hi")
        return near.union(spouses).distinct().select(directions("node", "member").alias("e")).select("e.*")
    links = edges.select("parent", "child").distinct()
    up = links.select(F.col("child").alias("node"), F.col("parent").alias("member"))
    down = links.select(F.col("parent").alias("node"), F.col("child").alias("member"))
    wanted = of.select("node").distinct()
    up, down = (d.join(wanted, "node", "left_semi") for d in (up, down))
    spouses = (
        down.select("node", F.col("member").alias("child")).join(links, "child")
        .select("node", F.col("parent").alias("member"))
        .where(F.col("node") != F.col("member"))
    )
    return up.union(down).union(spouses).distinct()


def topological_level(edges: DataFrame) -> DataFrame:
    """``(node, level)``: length of the longest path from a root.

    Peels the graph: a node is free once all its parents are. A round follows the links of
    the nodes freed last and writes only the nodes it met, with their parents left. Links
    and counts are rewritten without the freed nodes when these are half of them, or after
    ``MERGE_ROUNDS`` rounds. Nodes that never become free lie on a cycle or below one.
    """
    links = materialise(edges.select("parent", "child").distinct(), "links")
    free = materialise(roots(links), "level")
    waiting = materialise(links.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("left")), "waiting")
    missing = stored = waiting.count()
    levels, met = [free], []
    while missing:
        counts = links.join(free.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("met"))
        known = reduce(DataFrame.unionByName, met, waiting)
        touched = materialise(
            known.join(counts, "node").groupBy("node").agg((F.min("left") - F.first("met")).alias("left")), "met"
        )
        met.append(touched)
        free = touched.where("left = 0").select("node")
        freed = free.count()
        if not freed:
            raise ValueError("the graph has a cycle")
        levels.append(free)
        missing -= freed
        if missing and (2 * missing < stored or len(met) == MERGE_ROUNDS):
            left = reduce(DataFrame.unionByName, met, waiting).groupBy("node").agg(F.min("left").alias("left"))
            waiting, met, stored = materialise(left.where("left > 0"), "waiting"), [], missing
            # links still to be followed start at a waiting node or at one just freed
            ahead = waiting.select("node").union(free).withColumnRenamed("node", "parent")
            links = materialise(links.join(ahead, "parent", "left_semi"), "links")
    return reduce(DataFrame.unionByName, [f.withColumn("level", F.lit(k).cast("bigint")) for k, f in enumerate(levels)])


def topological_order(edges: DataFrame) -> DataFrame:
    """``(node, level, position)``: a valid order, by level and name."""
    return global_rank(topological_level(edges), ["level", "node"], "position")


def is_tree(edges: DataFrame) -> DataFrame:
    """One row: no node has more than one parent."""
    per_child = edges.select("parent", "child").distinct().groupBy("child").count()
    return per_child.agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias("is_tree"))


def depth_first_order(edges: DataFrame) -> DataFrame:
    """``(node, position)``: preorder from the roots, siblings by name, each node once.

    A node's place is set by its smallest path. Two paths to the same node are
    compared at the end of the round that finds them, and only the smaller one is
    extended: everything below the node then inherits the smaller prefix. A path that
    comes back to a node is longer than the node's own and goes no further, so a cycle
    ends too; it shows as a link to a node on the smallest path of its parent, or as
    nodes no root reaches.
    """
    links = materialise(edges.select("parent", "child").distinct(), "links")
    best = materialise(roots(links).withColumn("path", F.array("node")), "paths")
    changed = best
    while True:
        reached = (
            changed.withColumnRenamed("node", "parent").join(links, "parent")
            .select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
            .groupBy("node").agg(F.min("path").alias("path"))
        )
        known = best.withColumnRenamed("path", "known")
        changed = materialise(
            reached.join(known, "node", "left")
            .where(F.col("known").isNull() | (F.col("path") < F.col("known")))
            .select("node", "path"), "paths",
        )
        if changed.isEmpty():
            above = best.select(F.col("node").alias("parent"), F.col("path").alias("above"))
            checked = links.join(above, "parent", "left").join(best.withColumnRenamed("node", "child"), "child", "left")
            back = F.slice("above", 1, F.size("path")) == F.col("path")
            if not checked.where(F.col("above").isNull() | F.col("path").isNull() | back).isEmpty():
                raise ValueError("the graph has a cycle")
            return global_rank(best, ["path"], "position").select("node", "position")
        best = materialise(best.union(changed).groupBy("node").agg(F.min("path").alias("path")), "paths")
