"""Edge-table graph operators. Edges are ``(src, dst, w)``; signals ``(sample, node, value)``."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vx
from sparkloom.functions.distance import as_matrix
from sparkloom.functions.pairs import directions, unordered
from sparkloom.functions.uniform import draw_key, uniform
from sparkloom.operators.blocks import EdgeBlocks, combined, dot
from sparkloom.operators.ranking import global_rank
from sparkloom.operators.skew import SaltedEdges
from sparkloom.session import materialise

POWER_TOLERANCE = 1e-10
DENSE_SAMPLES = 16


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# shape ---------------------------------------------------------------------


def fuse_edges(layers: DataFrame, undirected: bool = True) -> DataFrame:
    """Sum the weights of all layers; ``undirected`` averages both directions."""
    if undirected:
        # both directions have one sum, so a pair is grouped once
        pairs = layers.select(unordered("src", "dst").alias("p"), (F.col("w") / 2).alias("w")).groupBy("p.lo", "p.hi").agg(F.sum("w").alias("w"))
        whole = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("w") * 2).otherwise(F.col("w")).cast(pairs.schema["w"].dataType)
        return pairs.select(directions("src", "dst").alias("e"), whole.alias("w")).select("e.src", "e.dst", "w")
    return layers.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    """``(node, degree, n)``: weighted degree and number of out-edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(
        F.sum("w").alias("degree"), F.count("*").alias("n")
    )


def top_nodes(degrees: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest degree, names break ties."""
    return degrees.orderBy(F.desc("degree"), "node").limit(n)


def source_nodes(degrees: DataFrame, community: DataFrame) -> DataFrame:
    """The node of highest degree in each community: ``(community, node, degree)``."""
    place = F.struct((-F.col("degree")).alias("neg"), F.col("node"))
    best = degrees.join(community, "node").groupBy("community").agg(F.min(place).alias("b"))
    return best.select("community", "b.node", (-F.col("b.neg")).alias("degree"))


def split(nodes: DataFrame, train: float, valid: float, seed: int = 42) -> DataFrame:
    """Add ``split``: train, valid or test, fixed by the node's own draw."""
    u = uniform(seed, F.col("node"), "split")
    label = F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")
    return nodes.withColumn("split", label)


def minibatches(nodes: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` in a shuffled order, no row left out."""
    shuffled = nodes.withColumn("__key", draw_key(seed, F.col("node"), "batch"))
    ranked = global_rank(shuffled, ["__key", "node"], "__rank")
    batch = F.floor((F.col("__rank") - 1) / size)
    return ranked.withColumn("batch", batch).drop("__key", "__rank")


def dataset_stats(edges: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sizes of the graph, its classes, its feature vectors and its splits."""
    sizes = labels.agg(
        F.count("*").alias("n_nodes"), F.countDistinct("label").alias("n_classes"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "valid", "test")],
    )
    width = features.agg(F.max(F.size("x")).cast("bigint").alias("n")).scalar()
    links = edges.agg(F.count("*").alias("n")).scalar()
    return sizes.select("*", width.alias("n_features"), links.alias("n_edges"))


# neighbours ----------------------------------------------------------------


def sample_neighbours(
    edges: DataFrame | SaltedEdges, seeds: DataFrame, fanouts: Sequence[int], seed: int = 42, **salting
) -> DataFrame:
    """``(layer, dst, src)``: at most ``fanouts[layer]`` in-neighbours per frontier node.

    Draws are without replacement. The next frontier is the old one plus the sampled
    sources. The rank limit is applied before the shuffle as well, so a node with
    very many in-edges sends only a few rows per task.
    """
    by_dst = SaltedEdges.of(edges, ["src", "dst"], "dst", "src", **salting)
    frontier = materialise(seeds.select("node").distinct(), "frontier")
    layers = []
    for layer, fanout in enumerate(fanouts):
        key = draw_key(seed, F.lit(layer), F.col("dst"), F.col("src"))
        candidates = by_dst.join(frontier).withColumn("__key", key)
        order = Window.partitionBy("dst").orderBy("__key", "src")
        kept = (
            candidates.withColumn("__rank", F.row_number().over(order))
            .where(F.col("__rank") <= fanout)
            .select(F.lit(layer).cast("bigint").alias("layer"), "dst", "src")
        )
        layers.append(materialise(kept, "layer"))
        grown = frontier.union(layers[-1].select(F.col("src").alias("node")))
        if layer + 1 < len(fanouts):
            frontier = materialise(grown.distinct(), "frontier")
    return _union(layers)


def mean_neighbours(edges: DataFrame | SaltedEdges, features: DataFrame, width: int, **salting) -> DataFrame:
    """``(node, x, m)``: own features and mean of the in-neighbours' (zeros without any)."""
    by_src = SaltedEdges.of(edges, ["src", "dst"], "src", "dst", **salting)
    means = by_src.join(features.select("node", "x")).groupBy(F.col("dst").alias("node")).agg(
        vx.mean_vector(F.col("x"), width).alias("m")
    )
    zeros = F.array_repeat(F.lit(0.0), width)
    return features.select("node", "x").join(means, "node", "left").select(
        "node", "x", F.coalesce("m", zeros).alias("m")
    )


def affine_relu(terms: list[tuple[Column, Sequence[Sequence[float]]]], bias: Sequence[float]) -> Column:
    """``max(0, Σ W x + b)`` over vector columns x with literal matrices W."""
    weights, shift = [np.asarray(m, dtype=float) for _, m in terms], np.asarray(bias, dtype=float)

    @F.arrow_udf("array<double>")
    def layer(*columns: pa.Array) -> pa.Array:
        total = shift + sum(as_matrix(c) @ w.T for c, w in zip(columns, weights))
        flat = np.maximum(total, 0.0).reshape(-1)
        offsets = np.arange(0, len(flat) + 1, len(shift), dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return layer(*[x for x, _ in terms])


def sage_layer(
    edges: DataFrame | SaltedEdges, features: DataFrame, w_self, w_neigh, bias, **salting
) -> DataFrame:
    """One mean-aggregator layer with given weights: ``(node, x)``."""
    joined = mean_neighbours(edges, features, len(w_self[0]), **salting)
    return joined.select(
        "node", affine_relu([(F.col("x"), w_self), (F.col("m"), w_neigh)], bias).alias("x")
    )


def smoothed_features(edges: DataFrame | SaltedEdges, features: DataFrame, width: int, rounds: int) -> DataFrame:
    """Features averaged over neighbours ``rounds`` times: ``(node, x)``."""
    by_src = SaltedEdges.of(edges, ["src", "dst"], "src", "dst")
    at = features.select("node", "x")
    for _ in range(rounds):
        mixed = mean_neighbours(by_src, at, width)
        at = materialise(mixed.select("node", F.col("m").alias("x")), "features")
    return at


# diffusion -----------------------------------------------------------------


def _step(by_src: SaltedEdges, signal: DataFrame) -> DataFrame:
    return by_src.join(signal).groupBy("sample", F.col("dst").alias("node")).agg(
        F.sum(F.col("value") * F.col("w")).alias("value")
    )


def diffuse(edges: DataFrame | SaltedEdges | EdgeBlocks, signal: DataFrame, steps: int, **salting) -> DataFrame:
    """``(sample, t, node, value)`` for t = 0 … steps − 1, value at t is ``S^t x``.

    The edges are stored once, as blocks. Signals of more than ``DENSE_SAMPLES`` samples, which may be
    sparse, are joined with the edges instead; each step sums map-side before it shuffles.
    """
    at = materialise(signal.select("sample", "node", "value"), "signal")
    frames = [at]
    if at.select("sample").distinct().limit(DENSE_SAMPLES + 1).count() <= DENSE_SAMPLES:
        blocks = EdgeBlocks.of(edges, **salting)
        vector = blocks.vector(at)
        for _ in range(steps - 1):
            vector = materialise(blocks.product(vector), "vector")
            frames.append(blocks.rows(vector))
    else:
        by_src = SaltedEdges.of(edges.frame if isinstance(edges, EdgeBlocks) else edges, ["src", "dst", "w"], "src", "dst", **salting)
        for _ in range(steps - 1):
            at = materialise(_step(by_src, at), "signal")
            frames.append(at)
    return _union([f.withColumn("t", F.lit(t).cast("bigint")) for t, f in enumerate(frames)])


def shift_features(diffused: DataFrame, taps: int) -> DataFrame:
    """Columns ``s0 … s<taps−1>`` per sample and node."""
    cols = [F.coalesce(F.sum(F.when(F.col("t") == k, F.col("value"))), F.lit(0.0)).alias(f"s{k}")
            for k in range(taps)]
    return diffused.groupBy("sample", "node").agg(*cols)


def filtered(diffused: DataFrame, taps: Sequence[float]) -> DataFrame:
    """``(sample, node, value)``: ``Σ h_k S^k x``."""
    weight = F.element_at(vx.vector_literal(taps), (F.col("t") + 1).cast("int"))
    kept = diffused.where(F.col("t") < len(taps))
    return kept.groupBy("sample", "node").agg(F.sum(F.col("value") * weight).alias("value"))


def local_max(edges: DataFrame | SaltedEdges, signal: DataFrame, hops: int, **salting) -> DataFrame:
    """``(node, value)``: maximum over all nodes within ``hops`` links.

    A maximum of maxima needs one step per hop and never lists the reachable pairs.
    """
    by_src = SaltedEdges.of(edges, ["src", "dst"], "src", "dst", **salting)
    at = signal.select("node", "value")
    for _ in range(hops):
        seen = by_src.join(at).groupBy(F.col("dst").alias("node")).agg(F.max("value").alias("value"))
        grown = at.union(seen).groupBy("node").agg(F.max("value").alias("value"))
        at = materialise(grown, "maximum")
    return at


# spectrum ------------------------------------------------------------------


def spectral_radius(
    edges: DataFrame | SaltedEdges | EdgeBlocks, tol: float = POWER_TOLERANCE, seed: int = 42, method: str = "lanczos", **salting
) -> float:
    """Largest absolute eigenvalue of a symmetric table, 0 for a table without edges; ``lanczos`` or ``power`` iteration."""
    blocks = EdgeBlocks.of(edges, **salting)
    return {"lanczos": _lanczos, "power": _power}[method](blocks, tol, seed)


def _power(blocks: EdgeBlocks, tol: float, seed: int) -> float:
    """A unit vector is multiplied until the length of the product changes by ``tol`` of itself or less.

    The length never falls from round to round, so this ends, and it is right for the
    ±λ pairs of bipartite graphs too.
    """
    at = blocks.start(lambda node: uniform(seed, node, "power") - 0.5)

    def length(frame: DataFrame) -> float:
        return frame.agg(F.sqrt(F.sum(dot("value", "value")))).first()[0] or 0.0

    now = length(at)
    while now:
        before = now
        at = materialise(blocks.divided(before).product(at), "power")
        now = length(at)
        if abs(now - before) <= tol * now:
            break
    return now


def _lanczos(blocks: EdgeBlocks, tol: float, seed: int) -> float:
    """A step multiplies the last vector by the table once and keeps the last two.

    The driver holds the tridiagonal matrix, two numbers per step. It ends when the residual of the
    outermost Ritz pair (both ends are looked at, for the ±λ pairs of bipartite graphs) bounds
    the error of its value by ``tol`` of itself. Lost orthogonality repeats values that have
    been found but moves none.
    """
    at = blocks.start(lambda node: uniform(seed, node, "power") - 0.5)
    length = at.agg(F.sqrt(F.sum(dot("value", "value")))).first()[0]
    if not length:
        return 0.0
    at = at.select("seg", combined(1 / length, "value", 0.0, "value").alias("now"), combined(0.0, "value", 0.0, "value").alias("before"))
    diagonal, beside = [], [0.0]
    while True:
        moved = blocks.partials(at.select(F.lit(0).alias("sample"), "seg", F.col("now").alias("value"), F.lit(b"").alias("state")))
        # the product and the vectors it is reduced by meet in one shuffle
        step = moved.select("seg", F.col("value").alias("product")).unionByName(
            at.select("seg", combined(-beside[-1], "before", 0.0, "now").alias("product"), "now"), allowMissingColumns=True)
        step = materialise(step.groupBy("seg").applyInArrow(_reduced, "seg int, product binary, now binary"), "lanczos")
        diagonal.append(step.agg(F.sum(dot("product", "now"))).first()[0])
        rest = combined(1.0, "product", -diagonal[-1], "now")
        beside.append(step.agg(F.sqrt(F.sum(dot(rest, rest)))).first()[0])
        value, error = _outermost(diagonal, beside[1:])
        if error <= tol * value or beside[-1] <= 1e-14 * value:
            return value
        at = step.select("seg", combined(1 / beside[-1], "product", -diagonal[-1] / beside[-1], "now").alias("now"), F.col("now").alias("before"))


def _reduced(parts: pa.Table) -> pa.Table:
    """The sum of a segment's products, beside the vector that was multiplied."""
    total = sum(np.frombuffer(c.as_buffer()) for c in parts["product"])
    now = parts["now"].drop_null()
    return pa.table({"seg": parts["seg"].slice(0, 1), "product": pa.array([total.tobytes()], pa.binary()), "now": now})


def _outermost(diagonal: list[float], beside: list[float]) -> tuple[float, float]:
    """(value, error bound) of the eigenvalue of largest size; the last number of ``beside`` leads out of the matrix."""
    ritz, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    end = len(ritz) - 1 if ritz[-1] >= -ritz[0] else 0
    residual = abs(beside[-1] * vectors[-1, end])
    gap = abs(ritz[end] - ritz[end - 1 if end else 1]) if len(ritz) > 1 else 0.0
    # the error is at most the residual, and of its square over the gap once the pair stands apart
    return abs(ritz[end]), min(residual, residual ** 2 / gap) if gap > 10 * residual else residual


def scaled_edges(
    edges: DataFrame | SaltedEdges | EdgeBlocks, tol: float = POWER_TOLERANCE, seed: int = 42, method: str = "lanczos"
) -> EdgeBlocks:
    """Edges divided by their spectral radius, stored and ready for diffusion."""
    blocks = EdgeBlocks.of(edges)
    return blocks.divided(spectral_radius(blocks, tol, seed, method))


def spectral_scale(edges: DataFrame, tol: float = POWER_TOLERANCE, seed: int = 42) -> DataFrame:
    """``(src, dst, w)`` divided by the spectral radius."""
    return scaled_edges(edges, tol, seed).frame.select("src", "dst", "w")


def laplacian(edges: DataFrame | SaltedEdges | EdgeBlocks) -> DataFrame:
    """Normalised Laplacian ``I − D^-1/2 S D^-1/2`` as an edge table with its diagonal.

    The table holds both directions of every edge; a one-way edge to a node without edges of
    its own has no degree to divide by and is an error.
    """
    return EdgeBlocks.of(edges).laplacian().frame


def rescaled_laplacian(edges: DataFrame | SaltedEdges | EdgeBlocks, tol: float = POWER_TOLERANCE, seed: int = 42) -> DataFrame:
    """``2 L / λmax − I``."""
    table = EdgeBlocks.of(edges).laplacian()
    top = spectral_radius(table, tol, seed)
    one = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)
    return table.frame.select("src", "dst", (F.col("w") * 2 / top - one).alias("w"))


# labelled data sets --------------------------------------------------------


def source_data_set(
    edges: DataFrame | SaltedEdges, sources: DataFrame, steps: int, train: float, valid: float, seed: int = 42
) -> DataFrame:
    """``(label, t, split, node, value)``: diffusion of a unit impulse at each source.

    Each (source, t) is one labelled sample; the label is the source.
    """
    impulse = sources.select(F.col("node").alias("sample"), "node", F.lit(1.0).alias("value"))
    rows = diffuse(edges, impulse, steps)
    u = uniform(seed, F.col("sample"), F.col("t"), "split")
    part = F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")
    return rows.select(F.col("sample").alias("label"), "t", part.alias("split"), "node", "value")


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: ``accuracy`` and ``error_rate`` of columns prediction, label."""
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return predictions.agg(hit.alias("accuracy"), (1 - hit).alias("error_rate"))


def best_epoch(scores: DataFrame) -> DataFrame:
    """One row ``(epoch, acc)``: the highest accuracy, the earliest epoch on ties."""
    best = F.min(F.struct((-F.col("acc")).alias("neg"), "epoch")).alias("b")
    return scores.agg(best).select("b.epoch", (-F.col("b.neg")).alias("acc"))


def fit_classifier(rows: DataFrame, max_iter: int = 500, tol: float = 1e-6):
    """Multinomial logistic regression on the train rows of (x, label, split), as a ``PipelineModel``.

    It is fitted until its loss changes by ``tol`` or less; a fit that stops at ``max_iter`` before
    that warns. The model adds ``prediction`` to rows with ``features`` (:func:`with_features`),
    which need no label, and is stored and read back by its own ``save`` and ``load``.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    train = with_features(index.transform(rows)).where(F.col("split") == "train")
    model = LogisticRegression(featuresCol="features", labelCol="y", predictionCol="y_hat", maxIter=max_iter, tol=tol)
    fitted = model.fit(train)
    if fitted.summary.totalIterations >= max_iter:
        warnings.warn(f"the classifier still moved after {max_iter} iterations", RuntimeWarning, stacklevel=3)
    return PipelineModel([fitted, IndexToString(inputCol="y_hat", outputCol="prediction", labels=index.labels)])


def with_features(rows: DataFrame) -> DataFrame:
    """Add ``features``, the vector form of the array ``x``."""
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector("x"))


def classify_nodes(
    edges: DataFrame, features: DataFrame, labels: DataFrame, width: int,
    rounds: int = 3, max_iter: int = 500, tol: float = 1e-6,
) -> DataFrame:
    """Node classification on smoothed features (simplified graph convolution, Wu et al. 2019).

    ``labels`` has node, label and split; the model is that of :func:`fit_classifier`.
    Returns ``(node, split, label, prediction)``.
    """
    smooth = smoothed_features(edges, features, width, rounds)
    rows = materialise(smooth.join(labels, "node"), "labelled")
    model = fit_classifier(rows, max_iter, tol)
    return model.transform(with_features(rows)).select("node", "split", "label", "prediction")
