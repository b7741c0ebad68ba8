"""Sampled posteriors. Every draw is a row; draws are functions of (seed, id, node)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.uniform import uniform
from sparkloom.operators import factors as fx
from sparkloom.session import materialise

_PAD = 1e-9  # wider than any rounding of a bound


def _guide(table: DataFrame, given: list[str], step: Column, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """Guide table of cumulative intervals, and the column ``__step`` of each parent tuple.

    The range of the draws is cut into as many equal cells as a parent tuple has labels
    (``__m``), ``__step`` wide, and an interval row is repeated, column ``__cell``, for every cell
    it touches. L intervals touch 2L cells, so a draw meets two candidates on average, however
    many labels there are. Columns of the guide are named with two underscores in front.
    """
    # the intervals were numbered in the same windows, so the count needs no exchange of its own
    sized = table.withColumn("__m", F.count("*").over(Window.partitionBy(*given))).withColumn("__step", step)
    total = [F.first("total").alias("__of")] if "total" in table.columns else []
    cells = sized.groupBy(*given).agg(F.first("__step").alias("__step"), *total)
    guide = sized.withColumn("__cell", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return guide.select(*[F.col(c).alias(f"__{c}") for c in table.columns], "__cell"), cells


def _with_cells_of(rows: DataFrame, cells: DataFrame, given: list[str]) -> DataFrame:
    """Add the other columns of ``cells`` by the row's parents; null if the parents are not there."""
    more = [c for c in cells.columns if c not in given]
    if not given:
        return rows.select("*", *[cells.select(c).scalar().alias(c) for c in more])
    named = cells.toDF(*[f"__given_{c}" if c in given else c for c in cells.columns])
    return rows.join(named, [F.col(g) == F.col(f"__given_{g}") for g in given], "left").drop(*[f"__given_{g}" for g in given])


def forward(
    net, rows: DataFrame, id_col: str, seed: int, event: Mapping[str, str] | None = None
) -> DataFrame:
    """Ancestral sampling, one sample per row.

    Variables named in ``event`` are clamped; column ``weight`` is then the
    probability of the clamped labels given their sampled parents.
    """
    event = event or {}
    out = rows.select(id_col).withColumn("weight", F.lit(1.0))
    for node in net.nodes:
        if node in event:
            out = out.withColumn(node, F.lit(str(event[node])))
            table = net.cpt(node).withColumnRenamed("p", "__p")
            out = out.join(table, net.family(node), "left").withColumn(
                "weight", F.col("weight") * F.coalesce(F.col("__p"), F.lit(0.0))
            ).drop("__p")
        else:
            given = net.parents[node]
            # integer cells, so bounds and draws fall in the same one without rounding
            guide, cells = _guide(net.cdf(node), given, F.expr("(total + __m - 1) div __m"), F.expr("lo div __step"), F.expr("(hi - 1) div __step"))
            drawn = _with_cells_of(out, cells, given).withColumn("__pick", F.floor(uniform(seed, F.col(id_col), node) * F.col("__of")))
            pick = F.col("__pick")
            hit = (F.col("__cell") == F.expr("__pick div __step")) & (F.col("__lo") <= pick) & (pick < F.col("__hi"))
            for parent in given:
                hit = hit & (F.col(parent) == F.col(f"__{parent}"))
            out = drawn.join(guide, hit).select(*out.columns, F.col(f"__{node}").alias(node))
    return out


def _shares(samples: DataFrame, query: list[str], weight: Column) -> DataFrame:
    grouped = samples.groupBy(*query).agg(F.sum(weight).alias("p"))
    return fx.normalise(grouped)


def rejection(net, query, event, rows, id_col, seed) -> DataFrame:
    """Shares among the samples that agree with the event."""
    kept = fx.restrict(forward(net, rows, id_col, seed), event)
    return _shares(kept, query, F.lit(1.0))


def likelihood_weighting(net, query, event, rows, id_col, seed) -> DataFrame:
    """Weighted shares with the event clamped."""
    return _shares(forward(net, rows, id_col, seed, event), query, F.col("weight"))


def full_conditional(net, node: str) -> DataFrame:
    """Factor ``P(node | Markov boundary)``."""
    touching = [net.cpt(n) for n in [node, *net.children[node]]]
    joint = fx.product_all(touching)
    boundary = net.markov_boundary(node)
    return fx.normalise(joint, within=boundary).select(*boundary, node, "p")


def _intervals(net, node: str) -> DataFrame:
    """Full conditional with cumulative bounds; the last interval is open above."""
    boundary = net.markov_boundary(node)
    w = Window.partitionBy(*boundary).orderBy(node)
    hi = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    lo = F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    last = F.lead(node).over(w).isNull()
    return full_conditional(net, node).select(
        *boundary, F.col(node).alias("new"), lo.alias("lo"), F.when(last, F.lit(2.0)).otherwise(hi).alias("hi"),
    )


def gibbs_chains(net, event, rows, id_col, seed, sweeps: int = 2) -> DataFrame:
    """One short chain per row: columns id, ``weight``, ``step`` and the state after each step.

    A chain starts at a draw with the event clamped and keeps that draw's likelihood weight.
    Weighted starts follow the posterior and a step leaves the posterior as it is, so weighted
    states are right after any number of sweeps. A chain is sequential, so the parallelism is across chains. A step is an
    equi-join of the states with the full-conditional table of one variable.
    """
    free = sorted(set(net.nodes) - set(event))
    tables = {}
    for v in free:
        table = materialise(_intervals(net, v), "conditional")
        m = F.col("__m")
        first, last = F.greatest(F.floor((F.col("lo") - _PAD) * m), F.lit(0)), F.least(F.floor((F.col("hi") + _PAD) * m), m - 1)
        guide, cells = _guide(table, net.markov_boundary(v), m, first, last)
        tables[v] = materialise(guide, "guide"), materialise(cells, "cells")
    names = sorted(net.nodes)
    state = forward(net, rows, id_col, seed, event).select(id_col, "weight", *names)
    history = []
    for sweep in range(sweeps):
        trace = []
        for i, var in enumerate(free):
            step = sweep * len(free) + i + 1
            (guide, cells), given, u = tables[var], net.markov_boundary(var), F.col("__u")
            hit = (F.col("__cell") == F.floor(u * F.col("__step")).cast("int")) & (F.col("__lo") <= u) & (u < F.col("__hi"))
            for member in given:
                hit = hit & (F.col(member) == F.col(f"__{member}"))
            # a boundary that no table row covers keeps its label
            new = F.coalesce(F.col("__new"), F.col(var)).alias(var)
            moved = _with_cells_of(state, cells, given).withColumn("__u", uniform(seed, F.col(id_col), var, F.lit(step)))
            state = moved.join(guide, hit, "left").select(
                *[new if c == var else F.col(c) for c in state.columns]
            )
            trace.append(f"__s{i}")
            snapshot = F.struct(F.lit(step).cast("bigint").alias("step"), *names)
            state = state.withColumn(trace[-1], snapshot)
        # one write per sweep keeps the plan short
        state = materialise(state.withColumn("__trace", F.array(*trace)).drop(*trace), "chains")
        history.append(state.select(id_col, "weight", F.inline("__trace")))
        state = state.drop("__trace")
    return reduce(lambda a, b: a.unionByName(b), history)


def gibbs(net, query, event, rows, id_col, seed, sweeps: int = 2, burn_in: int = 0) -> DataFrame:
    """Weighted shares over the steps of all chains after the first ``burn_in`` sweeps."""
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in leaves no sweep to record")
    chains = gibbs_chains(net, event, rows, id_col, seed, sweeps)
    free = len(set(net.nodes) - set(event))
    return _shares(chains.where(F.col("step") > burn_in * free), query, F.col("weight"))
