"""Silhouette scores.

``squared``: squared Euclidean distance. The mean squared distance of a point to a
cluster follows from the cluster's size, vector sum and sum of squared norms, so two
scans suffice at any size.

``euclidean``: plain distance, which has no such shortcut. The work is quadratic in
the rows; it is cut into tiles of bounded size that return only sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vx
from sparkloom.functions.distance import BLOCK_CELLS, as_matrix, closest_index, cluster_sums
from sparkloom.operators.kmeans import Centroids, _packed, _vectors, assign_runs, run_sums
from sparkloom.session import materialise

TILE_ROWS = 1 << 14
TILE_NUMBERS = 1 << 21  # of a block's vectors
SMALL_ROWS = 500
CLOSE = 1e-4  # squares below this share of the two norms are measured without the product


def score(own: Column, other: Column, size: Column) -> Column:
    """Silhouette from mean distances; 0 for singletons and when there is one cluster."""
    top = F.greatest(own, other)
    value = F.when(top > 0, (other - own) / F.when(top > 0, top)).otherwise(0.0)
    return F.when((size > 1) & other.isNotNull(), value).otherwise(0.0)


def cluster_statistics(assigned: DataFrame, width: int) -> DataFrame:
    """Per run and cluster: size, vector sum, sum of squared norms."""
    x = F.col("x")
    return assigned.groupBy("run", "cid").agg(
        F.count("*").cast("double").alias("n"), vx.sum_vector(x, width).alias("s"),
        vx.sum_of_squares(x, width).alias("q"),
    )


def _gaps(points: np.ndarray, cids: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean squared distance of every row to its own and the nearest other cluster, NaN if there is none, and its cluster's size.

    ``model`` holds one row ``cid, n, q, s…`` per centroid.
    """
    ids, n, q, s = model[:, 0], model[:, 1], model[:, 2], model[:, 3:]
    norms = (points**2).sum(axis=1)
    total = np.maximum(n * norms[:, None] - 2 * points @ s.T + q, 0)
    mine, line = np.searchsorted(ids, cids), np.arange(len(points))
    own, other = total[line, mine] / np.maximum(n[mine] - 1, 1), np.full(len(points), np.nan)
    if len(ids) > 1:
        mean = total / n
        mean[line, mine] = np.inf
        other = mean.min(axis=1)
    return own, other, n[mine]


def _mean_gaps(models: dict[int, np.ndarray]):
    """UDF (x, run, cid) → :func:`_gaps` of the run's model."""
    @F.arrow_udf("own double, other double, size double")
    def gaps(x: pa.Array, run: pa.Array, cid: pa.Array) -> pa.Array:
        points, runs, cids = as_matrix(x), run.to_numpy(), cid.to_numpy()
        found = np.full((3, len(points)), np.nan)
        for r in np.unique(runs):
            at = np.flatnonzero(runs == r)
            found[:, at] = _gaps(points[at], cids[at], models[r])
        return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in found], ["own", "other", "size"])

    return gaps


def squared_silhouette(assigned: DataFrame) -> DataFrame:
    """Add ``sil`` to rows ``(run, id, x, cid)``."""
    width = assigned.select(F.size("x")).first()[0]
    rows: dict[int, list] = {}
    for r in cluster_statistics(assigned, width).orderBy("cid").collect():  # one per centroid
        rows.setdefault(r["run"], []).append([r["cid"], r["n"], r["q"], *r["s"]])
    models = {run: np.array(stats, dtype=float) for run, stats in rows.items()}
    gaps = _mean_gaps(models)(F.col("x"), F.col("run"), F.col("cid")).alias("g")
    return assigned.select("*", gaps).select(
        *assigned.columns, score(F.col("g.own"), F.col("g.other"), F.col("g.size")).alias("sil"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs by a matrix product; squares that it rounds too much are measured one by one."""
    shift = a.mean(axis=0)
    u, v = a - shift, b - shift
    scale = np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", v, v)
    if not np.isfinite(scale).all():
        return np.sqrt(np.stack([((row - b) ** 2).sum(axis=1) for row in a]))
    squares = scale - 2 * (u @ v.T)
    row, column = np.nonzero(squares <= CLOSE * scale)
    step = max(1, BLOCK_CELLS // max(1, a.shape[1]))
    for at in range(0, len(row), step):
        i, j = row[at : at + step], column[at : at + step]
        squares[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(squares)


def _tile_sums(a: np.ndarray, b: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance sums from rows of ``a`` to the clusters of ``b`` and back; ``own`` and ``other`` mark the members."""
    there, back = np.empty((len(a), other.shape[1])), np.zeros((len(b), own.shape[1]))
    step = max(1, BLOCK_CELLS // len(b))
    for at in range(0, len(a), step):
        gaps = _distances(a[at : at + step], b)
        there[at : at + step] = gaps @ other
        back += gaps.T @ own[at : at + step]
    return there, back


def euclidean_silhouette(assigned: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(run, id, cid, sil)`` with plain distances, exact.

    Points are hashed into blocks of at most about ``tile_rows``, fewer if vectors are long. Every
    unordered pair of blocks is one group of bounded size, in which each distance is measured
    once; a group returns one row of sums per point.
    """
    runs = sorted(r["run"] for r in assigned.select("run").distinct().collect())
    per_point = materialise(
        assigned.groupBy("id").agg(
            F.first("x").alias("x"),
            F.transform(F.array_sort(F.collect_list(F.struct("run", "cid"))), lambda s: s["cid"])
            .alias("clusters"),  # one entry per run
        ), "points",
    )
    size = per_point.agg(F.count("*"), F.max(F.size("x"))).first()
    counted = per_point.select(F.posexplode("clusters").alias("slot", "other")).groupBy("slot", "other").agg(F.count("*").alias("n"))
    cells = [tuple(r) for r in counted.orderBy("slot", "other").collect()]  # one per run and cluster
    slots, others = (np.array([c[k] for c in cells], int) for k in (0, 1))
    rows = max(1, min(tile_rows, TILE_NUMBERS // max(1, size[1] or 1)))
    cores = assigned.sparkSession.sparkContext.defaultParallelism
    # enough pairs of blocks for all cores, unless the blocks get small
    blocks = max(1, math.ceil(size[0] / rows), min(math.ceil(size[0] / SMALL_ROWS), math.isqrt(4 * cores)))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = per_point.select("id", "x", "clusters", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    met = met.select("id", "x", "clusters", "block", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"))

    def tile(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        if not len(left) or not len(right):
            return pa.table({"id": group.column("id")[:0], "totals": pa.array([], pa.list_(pa.float64()))})
        x = as_matrix(group.column("x").combine_chunks())
        member = (as_matrix(group.column("clusters").combine_chunks())[:, slots] == others).astype(float)
        there, back = _tile_sums(x[left], x[right], member[left], member[right])
        at, totals = (left, there) if i[0] == j[0] else (np.r_[left, right], np.concatenate([there, back]))
        return pa.table({"id": group.column("id").take(pa.array(at)), "totals": pa.array(list(totals), pa.list_(pa.float64()))})

    id_type = dict(assigned.dtypes)["id"]
    sums = met.groupBy("i", "j").applyInArrow(tile, f"id {id_type}, totals array<double>")
    sums = sums.groupBy("id").agg(vx.sum_vector(F.col("totals"), len(cells)).alias("totals"))
    named = F.arrays_zip("totals", F.array(*[F.struct(F.lit(runs[slot]).alias("run"), F.lit(other).alias("other"), F.lit(n).cast("bigint").alias("n"))
                                             for slot, other, n in cells]).alias("cell"))
    joined = sums.select("id", F.explode(named).alias("c")).select("id", "c.cell.run", "c.cell.other", "c.cell.n", F.col("c.totals").alias("total"))
    joined = joined.join(assigned.select("id", "run", "cid"), ["id", "run"])
    own = F.col("other") == F.col("cid")
    size = F.max(F.when(own, F.col("n")))
    return (
        joined.groupBy("run", "id", "cid")
        .agg(
            size.alias("size"), F.max(F.when(own, F.col("total"))).alias("t"),
            F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        )
        .select("run", "id", "cid",
                score(F.col("t") / F.greatest(F.col("size") - 1, F.lit(1)), F.col("b"), F.col("size"))
                .alias("sil"))
    )


def silhouette(points: DataFrame, models: dict[int, Centroids], metric: str = "squared") -> DataFrame:
    assigned = assign_runs(points, models)
    if metric == "squared":
        return squared_silhouette(assigned)
    if metric == "euclidean":
        return euclidean_silhouette(assigned)
    raise ValueError("metric must be squared or euclidean")


def _mean_squared(blocks: DataFrame, models: dict[int, Centroids]) -> DataFrame:
    """``(k, sil)`` by the ``squared`` distance over packed vectors: a scan for the clusters' sums, one for the scores, none of which leave a task."""
    known = {run: np.asarray(c, dtype=float) for run, c in models.items()}

    def statistics(x, model):
        n, s = cluster_sums(np.column_stack([(x**2).sum(axis=1), x]), closest_index(x, model), len(model))
        return {0: (n, s)}

    rows = sorted((tuple(r) for r in run_sums(blocks, known, statistics).groupBy("run", "cid").agg(
        F.sum("n").alias("n"), vx.sum_vector(F.col("s"), 1 + len(next(iter(models.values()))[0])).alias("s")).collect()), key=lambda r: r[:2])  # one per centroid
    stats = {run: np.array([[cid, n, *s] for r, cid, n, s in rows if r == run], dtype=float) for run in known}

    def scores(batches):
        found = {run: [0, 0.0] for run in known}
        for x in _vectors(batches):
            for run, model in known.items():
                own, other, size = _gaps(x, closest_index(x, model), stats[run])
                top = np.fmax(own, other)
                good = (top > 0) & (size > 1) & ~np.isnan(other)
                found[run][0] += len(x)
                found[run][1] += ((other[good] - own[good]) / top[good]).sum()
        yield pa.RecordBatch.from_pydict({"run": pa.array(list(found), pa.int32()), "n": pa.array([n for n, _ in found.values()], pa.int64()),
                                          "total": pa.array([t for _, t in found.values()], pa.float64())})

    parts = blocks.mapInArrow(scores, "run int, n bigint, total double").where(F.col("n") > 0)
    return parts.groupBy(F.col("run").alias("k")).agg((F.sum("total") / F.sum("n")).alias("sil"))


def mean_silhouette(points: DataFrame, models: dict[int, Centroids], metric: str = "squared", blocks: DataFrame | None = None) -> DataFrame:
    """``(k, sil)`` for models keyed by their k. ``blocks`` are the points as packed vectors, if they are stored so."""
    if metric == "squared":
        return materialise(_mean_squared(_packed(points) if blocks is None else blocks, models), "scores")
    scored = silhouette(points, models, metric)
    means = scored.groupBy(F.col("run").alias("k")).agg(F.avg("sil").alias("sil"))
    return materialise(means, "scores")
