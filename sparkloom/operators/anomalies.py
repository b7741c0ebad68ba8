"""Anomaly report of a clustering: tiny clusters and points outside their cluster's band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vx

SMALL_SHARE = 0.01
SIGMAS = 2.0


def bands(assigned: DataFrame, width: int | None = None) -> DataFrame:
    """``(cid, n, lo, hi)``: per feature, mean ∓ 2 population deviations."""
    width = width or assigned.select(F.size("x")).first()[0]
    x = F.col("x")
    stats = assigned.groupBy("cid").agg(
        F.count("*").alias("n"), vx.mean_vector(x, width).alias("m"),
        F.array(*[F.stddev_pop(x[i]) for i in range(width)]).alias("s"),
    )
    return stats.select(
        "cid", "n",
        F.zip_with("m", "s", lambda m, s: m - SIGMAS * s).alias("lo"),
        F.zip_with("m", "s", lambda m, s: m + SIGMAS * s).alias("hi"),
    )


def anomalies(assigned: DataFrame, rule: str = "any", digits: int = 2) -> DataFrame:
    """``(id, cid, reason, x)``; a point can appear for both reasons.

    ``rule="any"`` reports points with any feature outside the band,
    ``rule="all_above"`` points with every feature at or above the upper bound.
    """
    if rule not in ("any", "all_above"):
        raise ValueError("rule must be any or all_above")
    stats = bands(assigned).collect()  # one row per cluster
    total = sum(r["n"] for r in stats)
    threshold = int(SMALL_SHARE * total)
    size = {r["cid"]: r["n"] for r in stats}
    tiny = [c for c, n in size.items() if n == 1 or n < threshold]
    # clusters without points get empty bands, so that the index is the cluster id
    top = max(size, default=-1) + 1
    lo, hi = ([[] for _ in range(top)] for _ in range(2))
    for r in stats:
        lo[r["cid"]], hi[r["cid"]] = r["lo"], r["hi"]
    x = F.col("x")
    low, high = F.get(vx.json_matrix(lo), F.col("cid")), F.get(vx.json_matrix(hi), F.col("cid"))
    above = F.zip_with(x, high, lambda v, h: v >= h)
    if rule == "any":
        outside = F.exists(F.zip_with(x, high, lambda v, h: v > h), lambda b: b) | F.exists(
            F.zip_with(x, low, lambda v, b: v < b), lambda b: b)
    else:
        outside = F.forall(above, lambda b: b)
    reasons = F.array_compact(F.array(
        F.when(F.col("cid").isin(tiny) if tiny else F.lit(False), F.lit("small cluster")),
        F.when(outside, F.lit("outside band")),
    ))
    return assigned.select("id", "cid", F.explode(reasons).alias("reason"),
                           vx.round_vector(x, digits).alias("x"))
