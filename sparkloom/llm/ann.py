"""Approximate nearest neighbours by largest inner product, with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is assigned to a leaf. Vectors get one
more component so that all have one length, which turns the largest inner product into the smallest distance.
A query walks the tree best bin first: a priority queue holds the branches seen so far by
distance to their centre, and leaves come out in that order. When a query stops is widened until
a sample of queries, answered exactly as well, reaches the wanted recall: after a number of
leaves or at a multiple of the distance of its first leaf, whichever reads less. A query goes on
past that while its leaves hold too few rows.

Leaves that follow each other in the tree form groups. A query is one row per group it visits,
with the list of its leaves there, and gets its k best of a group from one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_share
from sparkloom.session import materialise

SAMPLE = 50_000  # vectors the tree is fitted on, at most
CALIBRATION = 256  # queries with exact answers, at most
RECALL = 0.93  # wanted on the calibration queries
BRANCHES = 8
LEAF_ROWS = 500  # rows a leaf should hold
GROUPS = 32  # groups of leaves, or more if they would hold more than PIECE_ROWS rows
PIECE_ROWS = 20_000  # rows of a group that meet one task
PIECE_QUERIES = 5_000
NEAR_ROWS = 1 << 17  # candidates scored exactly at once
_SEED = 11


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision): of ``width`` components, no null, zero or non-finite vectors."""
    if not len(column) or not width:
        return np.zeros(0, np.int64), np.zeros((0, width))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # null components become nan
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component, so that all have the length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.c_[x, rest]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        of = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


class CentreTree:
    """children[node] is a list of nodes or None for a leaf; leaf[node] numbers the leaves."""

    def __init__(self, x: np.ndarray, leaf_size: int, longest: float):
        self.longest, self.centres, self.children, self.leaf, self.leaves = longest, [], [], [], 0
        self._grow(_lift(x, longest), leaf_size, np.random.default_rng(_SEED))
        self.tables = [np.array([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def _grow(self, x: np.ndarray, leaf_size: int, rng) -> int:
        node = len(self.children)
        self.centres.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
        self.children.append(None)
        self.leaf.append(-1)
        parts = []
        if len(x) > leaf_size:
            _, of = _kmeans(x, min(BRANCHES, len(x)), rng)
            parts = [x[of == k] for k in np.unique(of)]
        if len(parts) > 1:
            self.children[node] = [self._grow(p, leaf_size, rng) for p in parts]
        else:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, down the nearest centres."""
        out, stack, x = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))], _lift(x, self.longest)
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if self.children[node] is None:
                out[at] = self.leaf[node]
                continue
            of = _nearest(x[at], self.tables[node])
            stack += [(c, at[of == k]) for k, c in enumerate(self.children[node])]
        return out

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(distance of its centre, leaf) of all leaves, best bin first."""
        size = float(np.sqrt((query**2).sum()))
        q = np.r_[query * (self.longest / size), 0.0]  # the order of a query's neighbours does not depend on its length
        queue = [(0.0, 0)]
        while queue:
            far, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield far, self.leaf[node]
                continue
            d = ((self.tables[node] - q) ** 2).sum(axis=1)
            for k, c in enumerate(self.children[node]):
                heapq.heappush(queue, (float(d[k]), c))

    def best_bins(self, query: np.ndarray, leaves: int, ratio: float, held: np.ndarray | None = None, wanted: int = 0) -> list[int]:
        """The first leaves of the walk: at most ``leaves`` and none farther than ``ratio`` times the first, but more until they hold ``wanted`` rows.

        ``held`` has the rows of each leaf.
        """
        found, rows, limit = [], 0, None
        for far, leaf in self.walk(query):
            limit = far * ratio if limit is None else limit
            if found and (len(found) >= leaves or far > limit) and rows >= wanted:
                break
            found.append(leaf)
            rows += int(held[leaf]) if wanted else 0
        return found


def _distinct(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows by id; equal rows with one id are one candidate."""
    order = np.argsort(ids, kind="stable")
    if not (ids[order][1:] == ids[order][:-1]).any():
        return order
    order = np.lexsort((*x.T, ids))
    new = (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(axis=1)
    return order[np.r_[True, new]]


def _top(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, asked: list[np.ndarray] | None = None, leaf: np.ndarray | None = None):
    """(query_id, vec_id, score) of each query's k best among the rows, without itself; ties to the smaller id.

    With ``asked``, a query sees only rows whose ``leaf`` is in its list.
    """
    keep = _distinct(x, ids)
    if leaf is not None:
        keep = keep[np.argsort(leaf[keep], kind="stable")]
        leaf = leaf[keep]
        begins = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        parts = dict(zip(leaf[begins].tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(leaf)])))
    x, ids, out = x[keep], ids[keep], []
    for a in range(0, len(queries), 256):
        q = queries[a:a + 256]
        if leaf is None:
            rough = q @ x.T
        else:
            rough = np.full((len(q), len(ids)), -np.inf)
            pairs = [(number, i) for i, own in enumerate(asked[a:a + 256]) for number in own.tolist()]
            pairs.sort()
            for number, of in groupby(pairs, lambda p: p[0]):
                if number in parts:
                    at, (begin, end) = [i for _, i in of], parts[number]
                    rough[at, begin:end] = q[at] @ x[begin:end].T
        rough[query_ids[a:a + 256, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        cut = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
        # rounding differs between matrix and vector products: keep what may tie, then score exactly
        near = np.isfinite(rough) & (rough >= np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), -np.inf)[:, None])
        # many rows may tie, so a few queries at a time
        ends = np.cumsum(near.sum(axis=1))
        first = 0
        while first < len(q):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + NEAR_ROWS, "right")))
            row, at = np.nonzero(near[first:last])
            row += first
            exact = (x[at] * q[row]).sum(axis=1)
            order = np.lexsort((ids[at], -exact, row))
            row, at, exact = row[order], at[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            out.append((query_ids[a:a + 256][row][rank < k], ids[at][rank < k], exact[rank < k]))
            first = last
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _stops(tree: CentreTree, asked: dict[int, np.ndarray], truth: list[tuple[int, int]], recall: float) -> tuple[int, float]:
    """(leaves, ratio): the cheaper of two rules that find ``recall`` of the true (query, leaf) pairs."""
    walks = {q: list(tree.walk(x)) for q, x in asked.items()}
    place = {q: {leaf: i for i, (_, leaf) in enumerate(w)} for q, w in walks.items()}
    far = {q: np.maximum.accumulate([d for d, _ in w]) / max(w[0][0], 1e-300) for q, w in walks.items()}
    at = np.array([place[q][leaf] for q, leaf in truth])
    need = int(np.ceil(recall * len(at))) - 1
    leaves = int(np.sort(at)[need]) + 1
    ratio = float(np.sort([far[q][i] for (q, _), i in zip(truth, at)])[need]) * (1 + 1e-12)
    read = np.mean([np.searchsorted(f, ratio, "right") for f in far.values()])
    return (tree.leaves, ratio) if read < leaves else (leaves, np.inf)


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found among all other rows.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on its rows. The score
    is the inner product in double precision. Null ids, null, empty, zero and non-finite
    vectors and vectors with null components take no part, nor do vectors of another length
    than the table's commonest (of equally common ones the smallest). Rows with one vec_id are
    one point seen several times; none of them is its own neighbour. A query gets fewer rows if
    there are fewer candidates.
    """
    spark = vectors.sparkSession
    out_type = "query_id bigint, rank int, vec_id bigint, score double"
    named = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint"), "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    widths = named.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n"))
    width = widths.agg(F.max_by("w", F.struct("n", -F.col("w")))).first()[0] or 0

    def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors_of(batch.column(1), width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), lists, batch.column(2).take(take)], ["vec_id", "x", "q"])

    points = named.mapInArrow(readable, "vec_id bigint, x array<double>, q boolean")
    stats = points.agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("longest")).first()
    if not stats["n"] or not stats["m"]:
        return spark.createDataFrame([], out_type)

    share = min(1.0, SAMPLE / stats["n"])
    sample = points.filter(hash_share(F.col("vec_id"), seed=21) < share).select("x").limit(SAMPLE).toArrow().column(0).combine_chunks()
    _, fitted = vectors_of(sample, width)
    tree = CentreTree(fitted, max(8, int(LEAF_ROWS * len(fitted) / stats["n"])), float(np.sqrt(stats["longest"])))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = vectors_of(batch.column(1), width)
            leaf = tree.assign(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], ["vec_id", "x", "q", "leaf"])

    stored = materialise(points.mapInArrow(leaves, "vec_id bigint, x array<double>, q boolean, leaf int"), "leaves")

    # exact answers for a bounded number of queries, in one pass over all rows
    chosen = stored.filter("q").filter(hash_share(F.col("vec_id"), seed=22) < min(1.0, CALIBRATION / stats["m"]))
    chosen = chosen.select("vec_id", "x").limit(2 * CALIBRATION).toArrow().combine_chunks()
    asked = chosen.column(0).to_numpy()
    asked_x = vectors_of(chosen.column(1).combine_chunks(), width)[1] if len(asked) else np.zeros((0, width))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(), vectors_of(batch.column(1), width)[1], batch.column(2).to_numpy()
            if not len(ids):
                continue
            q, v, s = _top(asked_x, asked, x, ids, k)
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), pa.array(leaf[order][np.searchsorted(ids[order], v)])], ["query_id", "vec_id", "score", "leaf"])

    def best(found: DataFrame, *more: str) -> DataFrame:
        """k best per query of the k best of its groups."""
        row = F.struct((-F.col("score")).alias("d"), "vec_id", "score", *more)
        ranked = found.groupBy("query_id").agg(F.array_sort(F.collect_set(row)).alias("all")).select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "r"))
        return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score", *[f"r.{c}" for c in more])

    visits, ratio = tree.leaves, np.inf
    if len(asked):
        truth = best(stored.select("vec_id", "x", "leaf").mapInArrow(exact, "query_id bigint, vec_id bigint, score double, leaf int"), "leaf").select("query_id", "leaf").collect()
        if truth:
            visits, ratio = _stops(tree, dict(zip(asked.tolist(), asked_x)), [tuple(r) for r in truth], recall)

    # rows of each leaf, and its distinct ids: an id in several leaves counts in one, so the sum over visited leaves never exceeds their ids
    rows_in, held = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    by_id = stored.groupBy("vec_id").agg(F.min("leaf").alias("leaf"))
    for into, counted in ((rows_in, stored), (held, by_id)):
        for row in counted.groupBy("leaf").agg(F.count("*").alias("n")).collect():
            into[row["leaf"]] = row["n"]
    group_rows = max(1, min(PIECE_ROWS, -(-stats["n"] // GROUPS)))
    group = (np.cumsum(rows_in) - rows_in) // group_rows  # of each leaf

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, groups, lists = [], [], []
            for i, v in enumerate(vectors_of(batch.column(1), width)[1]):
                bins = np.sort(tree.best_bins(v, visits, ratio, held, k + 1))
                own = group[bins]  # leaves are numbered along the tree, so groups rise with them
                new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                at += [i] * len(new)
                groups += own[new].tolist()
                lists += np.split(bins.astype(np.int32), new[1:])
            take = pa.array(np.array(at, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(groups, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "x", "g", "leaves"])

    queries = materialise(stored.filter("q").select("vec_id", "x").mapInArrow(walk, "vec_id bigint, x array<double>, g bigint, leaves array<int>"), "walk")
    # one task per group; one with many rows or queries is dealt over a grid of tasks
    of_leaf = F.element_at(F.lit(group.tolist()).cast("array<bigint>"), F.col("leaf") + 1)
    rows = stored.select("vec_id", "x", "leaf", of_leaf.alias("g"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("a"))
    grid = sizes.join(queries.groupBy("g").agg(F.ceil(F.count("*") / PIECE_QUERIES).cast("int").alias("b")), "g")
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    one = F.array(F.col("leaf"))
    own = rows.join(grid, "g").select("vec_id", "x", "g", one.alias("leaves"), spread(F.col("a")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), F.lit(False).alias("ask"))
    ask = queries.join(grid, "g").select("vec_id", "x", "g", "leaves", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), spread(F.col("b")).alias("j"), F.lit(True).alias("ask"))

    def score(met: pa.Table) -> pa.Table:
        met = met.combine_chunks()
        ids, ask = met.column("vec_id").to_numpy(), met.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        _, x = vectors_of(met.column("x").combine_chunks(), width)
        if ask.all() or not ask.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        lists = met.column("leaves").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
        asked_leaves = [flat[ends[i] - n:ends[i]] for i, n in zip(np.flatnonzero(ask), pc.list_value_length(lists).to_numpy()[ask])]
        q, v, s = _top(x[ask], ids[ask], x[~ask], ids[~ask], k, asked_leaves, flat[ends[~ask] - 1])
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    found = own.unionAll(ask).groupBy("g", "i", "j").applyInArrow(score, "query_id bigint, vec_id bigint, score double")
    return best(found).select("query_id", "rank", "vec_id", "score")
