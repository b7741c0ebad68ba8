"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit in one of
their halves, so each half gets a vantage-point tree over the Hamming distance of 32 bits and
a search radius of one. (A tree over all 64 bits with radius three must visit both sides of a
median split for 55 % of random fingerprints, one over a half with radius one for 28 %.)

A tree is fitted on a bounded sample and routes every fingerprint to its home shard, and as a
query to each shard that the triangle bounds cannot rule out. In a shard the same bounds prune
further, and pairs are tested on all 64 bits. A shard reports a spanning forest of its links
instead of all pairs, which is what components need and stays linear in a dense group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_share
from sparkloom.llm.textbatch import pieces
from sparkloom.operators.forest import components
from sparkloom.session import materialise

BITS = 3  # largest number of differing bits
HALF_RADIUS = BITS // 2
SEED = 42
WORDS = 3
SAMPLE = 1 << 19  # fingerprints a tree is fitted on, at most
SHARD = 4096  # fingerprints a shard should hold
PIECE = 1 << 15  # fingerprints of a shard that meet one task
QUERIES = 1 << 17  # queries of a shard that meet one task
BRUTE = 512  # shards of this size are compared pair by pair
_FLUSH = 1 << 18  # shingles per numpy step


def _hashes(text: bytes, size: int = WORDS) -> list[int]:
    words = text.lower().split()  # lower() changes A-Z alone on bytes
    if not words:
        return []
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    hash64 = xxhash.xxh64_intdigest
    return [hash64(s, SEED) for s in shingles]


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text, of its ``words``-word shingles; zero for texts without words and null."""
    n = len(column)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    pending, owners, held = [], [], 0

    def flush():
        values = np.concatenate(pending)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.array([len(p) for p in pending])
        starts = np.cumsum(counts) - counts
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        np.add.at(ones, owners, sums)
        np.add.at(total, owners, counts)

    for i, text in enumerate(column.cast(pa.large_binary())):
        hashes = _hashes(text.as_py() or b"", words)
        for at in range(0, len(hashes), _FLUSH):
            part = np.array(hashes[at:at + _FLUSH], np.uint64)
            pending.append(part)
            owners.append(i)
            held += len(part)
            if held >= _FLUSH:
                flush()
                pending, owners, held = [], [], 0
    if pending:
        flush()
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class VantageTree:
    """Arrays of a vantage-point tree over 32-bit halves; negative children are shards."""

    def __init__(self, points: np.ndarray, shards: int, rng: np.random.Generator):
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.shards = 0
        self._leaf_size = max(1, len(points) // max(shards, 1))
        self.root = self._build(points, rng)
        self.vantage = np.array(self.vantage, np.uint32)

    def _build(self, points: np.ndarray, rng) -> int:
        split = None if len(points) <= self._leaf_size else best_split(points, rng)
        if split is None:
            self.shards += 1
            return -self.shards
        vantage, radius, near = split
        node = len(self.vantage)
        self.vantage.append(vantage)
        self.radius.append(radius)
        self.inside.append(0)
        self.outside.append(0)
        self.inside[node] = self._build(points[near], rng)
        self.outside[node] = self._build(points[~near], rng)
        return node

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard that may hold a point within ``reach``; reach 0: home only."""
        rows, shards, stack = [], [], [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), -node - 1))
                continue
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int16)
            stack.append((self.inside[node], at[d <= self.radius[node] + reach]))
            stack.append((self.outside[node], at[d > self.radius[node] - reach]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(shards)


def best_split(points: np.ndarray, rng) -> tuple[np.uint32, int, np.ndarray] | None:
    """(vantage point, radius, near mask) of the most even of a few median splits; None if all points are equal."""
    best = None
    for vantage in rng.choice(points, 5):
        d = np.bitwise_count(points ^ vantage)
        radius = int(np.median(d))
        for r in (radius, radius - 1):
            near = d <= r
            even = abs(2 * int(near.sum()) - len(points))
            if 0 < near.sum() < len(points) and (best is None or even < best[0]):
                best = (even, vantage, r, near)
    return best and best[1:]


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


def linked_pairs(data: np.ndarray, queries: np.ndarray, half: int, rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query index, data index) arrays of pairs within BITS of which the half differs in HALF_RADIUS bits at most; data < query."""
    stack = [(np.arange(len(data)), np.arange(len(queries)))]
    halves, asked = _half(data, half), _half(queries, half)
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        split = None if len(own) <= BRUTE else best_split(halves[own], rng)
        if split is None:
            step = max(1, (1 << 21) // len(own))
            for a in range(0, len(ask), step):
                q = ask[a:a + step]
                close = np.bitwise_count(queries[q][:, None] ^ data[own][None, :]) <= BITS
                i, j = np.nonzero(close)
                i, j = q[i], own[j]
                smaller = data[j] < queries[i]
                if smaller.any():
                    yield i[smaller], j[smaller]
            continue
        vantage, radius, near = split
        d = np.bitwise_count(asked[ask] ^ vantage).astype(np.int16)
        stack.append((own[near], ask[d <= radius + HALF_RADIUS]))
        stack.append((own[~near], ask[d > radius - HALF_RADIUS]))


def forest(data: np.ndarray, queries: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root fingerprint) of a spanning forest of a shard's links."""
    nodes = np.unique(np.concatenate([data, queries]))
    label = np.arange(len(nodes))
    of_data, of_query = np.searchsorted(nodes, data), np.searchsorted(nodes, queries)
    for i, j in linked_pairs(data, queries, half, np.random.default_rng(0)):
        u, v = of_query[i], of_data[j]
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that connect what is linked."""
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    # the sample holds at most SAMPLE longs, 4 MB
    sample = fps.select("fp").filter(hash_share(F.col("fp"), seed=1) < share).limit(SAMPLE).toArrow()
    sample = sample.column(0).to_numpy().astype(np.int64).view(np.uint64)
    rng = np.random.default_rng(1)
    trees = [VantageTree(_half(sample, h), max(1, min(n // SHARD, len(sample) // 8)), rng) for h in (0, 1)] if len(sample) else []
    if not trees:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for h, tree in enumerate(trees):
                for query in (False, True):
                    row, shard = tree.route(_half(fp, h), HALF_RADIUS if query else 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[row]), pa.array((shard * 2 + h).astype(np.int32)), pa.array(np.full(len(row), query))],
                        ["fp", "shard", "query"],
                    )

    routed = fps.select("fp").mapInArrow(route, "fp bigint, shard int, query boolean")
    # one row per shard: a shard with many fingerprints or queries is dealt over a grid of tasks
    grid = routed.groupBy("shard").agg(
        F.ceil(F.count_if(~F.col("query")) / PIECE).cast("int").alias("a"), F.ceil(F.count_if("query") / QUERIES).cast("int").alias("b")
    ).filter("a > 1 OR b > 1").collect()
    wide = {r["shard"]: (max(r["a"], 1), max(r["b"], 1)) for r in grid}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in route(batches):
            fp, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            query = bool(len(batch)) and batch.column(2)[0].as_py()
            a = np.array([wide.get(s, (1, 1))[0] for s in range(int(shard.max(initial=0)) + 1)], np.int32)
            b = np.array([wide.get(s, (1, 1))[1] for s in range(len(a))], np.int32)
            own, other = (b, a) if query else (a, b)
            repeat = other[shard]
            at = np.repeat(np.arange(len(fp)), repeat)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            mine = (fp.view(np.uint64)[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % own[shard[at]]
            i, j = (turn, mine) if query else (mine, turn)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[at]), pa.array(shard[at]), pa.array((i * 100_003 + j).astype(np.int64)), pa.array(np.full(len(at), query))],
                ["fp", "shard", "cell", "query"],
            )

    def match(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
        half = int(group.column("shard")[0].as_py()) % 2
        u, v = forest(fp[~query], fp[query], half)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "fp bigint, shard int, cell bigint, query boolean")
    return dealt.groupBy("shard", "cell").applyInArrow(match, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    Words are lower-cased in A-Z; a text of fewer than three words is one shingle, one
    without words (also null) has fingerprint zero and is linked like any other. The
    component is named by the smallest doc_id that links reach. Rows with a null doc_id take
    part and never name a component that has an id. Repeated rows stay; an empty table gives
    an empty result.
    """
    marked = materialise(with_fingerprint(docs), "fingerprints")
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = materialise(links(firsts), "links")
    labels = components(found)
    joined = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    # only fingerprints; hot ones are one row here
    named = materialise(joined.join(names, "component").select("fp", "component_id"), "components")
    # the hot side of this join is the documents', which AQE splits
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, all columns kept.

    ``grouped`` gives the component_id of rows of doc_id and text. Of repeated rows with that id one stays. Rows with a null doc_id cannot be told apart and all stay.
    """
    groups = grouped(docs.select("doc_id", "text"))
    # a group is named by its smallest id: those rows are the ones to keep
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id IS NULL"))
