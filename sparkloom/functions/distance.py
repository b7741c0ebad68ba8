"""Distances from a vector column to a small set of centroids, on Arrow batches.

Writing k·d terms out as one compiled expression was measured first: the generated
method grows past what the JIT compiles at a few dozen terms, and new centroids mean
new code in every round. Array lambdas cost hundreds of nanoseconds per element.
Arrow batches keep the cost per row flat in both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_CELLS = 4_000_000  # distances of a batch that are held at a time

Matrix = Sequence[Sequence[float]]


def _model(rows: Matrix) -> np.ndarray:
    return np.asarray(rows, dtype=float)


def as_matrix(x: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column; null rows, null or NaN components and unequal lengths are errors."""
    lengths = np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, int)
    flat = x.flatten()
    bad = max(x.null_count, int((lengths != lengths[:1]).sum()))
    if not bad and (flat.null_count or np.isnan(flat.to_numpy(zero_copy_only=False).astype(float)).any()):
        bad = sum(v is None or None in v or any(c != c for c in v) for v in x.to_pylist())
    if bad:
        raise ValueError(f"{bad} of {len(x)} vectors of a batch are null, of another length or hold nulls or NaN")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _distances(points: np.ndarray, model: np.ndarray) -> np.ndarray:
    squares = np.zeros((len(points), len(model)))
    for j in range(model.shape[1]):  # squares are added in feature order
        squares += (points[:, j : j + 1] - model[:, j]) ** 2
    return np.sqrt(squares)


def _blocks(points: np.ndarray, model: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances to a block of centroids at a time, with the index of the block's first."""
    if len(points) and points.shape[1] != model.shape[1]:
        raise ValueError(f"vectors have {points.shape[1]} components and the model has {model.shape[1]}")
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    for start in range(0, len(model), step):
        yield start, _distances(points, model[start : start + step])


def closest(points: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and index of the closest centroid, the lowest index on ties."""
    best, at = np.full(len(points), np.inf), np.zeros(len(points), "int32")
    for start, gaps in _blocks(points, model):
        low = gaps.min(axis=1)
        nearer = low < best
        at[nearer] = start + gaps.argmin(axis=1)[nearer]
        best[nearer] = low[nearer]
    return best, at


def closest_index(points: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The index that :func:`closest` gives, from a matrix product.

    Rows whose two best squares differ by less than the product's rounding are measured again.
    """
    return closest_margin(points, model)[0]


def closest_margin(points: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of :func:`closest_index` and how much farther the second centroid is, at least.

    While no centroid moves by half of a row's margin or more, the row's index stays the same.
    """
    if len(points) and points.shape[1] != model.shape[1]:
        raise ValueError(f"vectors have {points.shape[1]} components and the model has {model.shape[1]}")
    at, margin = np.zeros(len(points), "int32"), np.zeros(len(points))
    if len(model) == 1:
        return at, np.full(len(points), np.inf)
    sizes = np.einsum("ij,ij->i", model, model)
    step = max(1, BLOCK_CELLS // len(model))
    for start in range(0, len(points), step):
        x = points[start : start + step]
        norms = np.einsum("ij,ij->i", x, x)
        if not (np.isfinite(norms).all() and np.isfinite(sizes).all()):
            at[start : start + step] = closest(x, model)[1]
            continue
        best, second, own = np.full(len(x), np.inf), np.full(len(x), np.inf), at[start : start + step]
        for j, gap in enumerate(sizes[:, None] - 2 * (model @ x.T)):
            own[gap < best] = j
            second = np.minimum(second, np.maximum(gap, best))
            best = np.minimum(best, gap)
        error = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (norms + sizes.max())
        lead = second - best - error
        unsure = np.flatnonzero(lead <= 0)
        if len(unsure):
            own[unsure] = closest(x[unsure], model)[1]
        most = np.sqrt(np.maximum(best + norms + error, 0)) + np.sqrt(np.maximum(second + norms + error, 0))
        np.divide(lead, most, out=margin[start : start + step], where=lead > 0)
    return at, margin


def cluster_sums(points: np.ndarray, cid: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of rows and vector sum of every cluster."""
    count = np.bincount(cid, minlength=clusters)
    if not np.isfinite(points).all():
        return count, np.stack([np.bincount(cid, weights=x, minlength=clusters) for x in points.T], axis=1)
    total, names = np.zeros((clusters, points.shape[1])), np.arange(clusters)[:, None]
    step = max(1, BLOCK_CELLS // clusters)
    for start in range(0, len(points), step):
        total += (cid[start : start + step] == names).astype(float) @ points[start : start + step]
    return count, total


def totals(points: np.ndarray, model: np.ndarray, total: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and minimum of the distances on top of earlier ones; the columns are added one by one, in seed order."""
    total = total.copy()
    for _, gaps in _blocks(points, model):
        for column in gaps.T:
            total += column
        near = np.minimum(near, gaps.min(axis=1))
    return total, near


def _struct_array(names: list[str], columns: Sequence) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names)


def nearest(x: Column, centroids: Matrix) -> Column:
    """Struct ``(dist, cid)`` of the closest centroid, the lowest index on ties."""
    model = _model(centroids)

    @F.arrow_udf("dist double, cid int")
    def run(x: pa.Array) -> pa.Array:
        return _struct_array(["dist", "cid"], closest(as_matrix(x), model) if len(x) else ([], []))

    return run(x)
