"""An edge table cut into a grid of blocks, for repeated products with vectors over its nodes.

Nodes are dealt to ``groups`` segments by their hash, an edge to the block of its two ends'
segments; a block with too many edges is split. A vector is one row per sample and segment. In a
product every segment goes to the blocks in its row of the grid and every block returns one partial
segment, so a product shuffles ``2 · groups`` numbers per node and sample and none per edge. Blocks are
stored in buckets and are not shuffled again. A hot node's edges lie in a whole row or column of blocks.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from sparkloom.operators.skew import SaltedEdges
from sparkloom.session import materialise, materialise_bucketed

BLOCK_EDGES = 4_000_000
SEGMENT_NODES = 4_000_000
MAX_SPLITS = 1 << 20
ABSENT, NULL, VALUE = 0, 1, 2  # state of a node in a vector
VECTOR = "seg int, value binary, state binary"  # no state: every node has a value
BLOCK = pa.schema([("block", pa.int64()), ("seg", pa.int32()), ("size", pa.int32()), ("sources", pa.int32()), *((c, pa.binary()) for c in ("src", "dst", "w", "known"))])
BLOCK_DDL = "block bigint, seg int, size int, sources int, src binary, dst binary, w binary, known binary"


class EdgeBlocks:
    """Stored edges ``(src, dst, w)`` as blocks; an edge without a source takes no part in a product.

    ``min_hot_rows`` is the number of edges from which on a block is split.
    """

    def __init__(self, edges: DataFrame, min_hot_rows: int = BLOCK_EDGES):
        self.edges = edges = materialise(edges.select("src", "dst", "w"), "edges")
        self.divisor = 1.0
        both = edges.select(F.col("src").alias("node"), F.lit(True).alias("out")).union(edges.select("dst", F.lit(False)))
        self.node_type = both.schema["node"].dataType
        nodes = materialise(both.groupBy("node").agg(F.max("out").alias("out")), "nodes")
        self.parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sizes = math.sqrt(self.parts), math.sqrt(edges.count() / BLOCK_EDGES), nodes.count() / SEGMENT_NODES
        self.groups = math.ceil(max(sizes))
        listed = nodes.groupBy(self._segment("node").alias("seg")).agg(F.collect_list(F.struct("node", "out")).alias("l"))
        # the places of nodes in their segment, from here on
        self.nodes = materialise(listed.select("seg", F.col("l.node").alias("node"), F.col("l.out").alias("out")), "segments")
        pair = self._segment("src") * self.groups + self._segment("dst")
        linked = edges.where(F.col("src").isNotNull()).withColumn("pair", pair)
        counts = linked.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") > min_hot_rows).collect()
        self.splits = {r["pair"]: min(MAX_SPLITS, -(-r["n"] // min_hot_rows)) for r in counts}
        # equal edges stay together, those of a node with itself in the first
        split = F.when(F.col("src") == F.col("dst"), 0).otherwise(F.pmod(F.xxhash64("dst", "src"), self._splits(F.col("pair"))))
        dealt = linked.select((F.col("pair").cast("bigint") * MAX_SPLITS + split).alias("block"), F.col("src").cast(self.node_type).alias("src"),
                              F.col("dst").cast(self.node_type).alias("dst"), F.col("w").cast("double").alias("w"))
        groups = self.groups

        def packed(some: pa.Table, names: pa.Table) -> pa.Table:
            return _packed(some, names, groups)

        self._store(dealt.groupBy("block").cogroup(self._to_both(self.nodes.select("seg", "node"))).applyInArrow(packed, BLOCK_DDL))

    def _store(self, blocks: DataFrame) -> None:
        self.blocks = materialise_bucketed(blocks, ["block"], self.parts, dealt=True)

    @classmethod
    def of(cls, edges: DataFrame | SaltedEdges | EdgeBlocks, min_hot_rows: int = BLOCK_EDGES, **salting) -> EdgeBlocks:
        """``edges`` itself if it is cut already; ``salting`` is for joins and unused here."""
        if isinstance(edges, cls):
            return edges
        return cls(edges.frame if isinstance(edges, SaltedEdges) else edges, min_hot_rows)

    @property
    def frame(self) -> DataFrame:
        return self.edges if self.divisor == 1.0 else self.edges.withColumn("w", F.col("w") / self.divisor)

    def divided(self, divisor: float) -> EdgeBlocks:
        """The same stored edges with their weights divided."""
        other = copy.copy(self)
        other.divisor = self.divisor * divisor
        return other

    def _segment(self, node: str) -> Column:
        return F.pmod(F.xxhash64(F.col(node).cast(self.node_type)), F.lit(self.groups)).cast("int")

    def _splits(self, pair: Column) -> Column:
        if not self.splits:
            return F.lit(1)
        known = F.create_map(*[F.lit(x) for item in self.splits.items() for x in item])
        return F.coalesce(F.try_element_at(known, pair), F.lit(1))

    def _to_blocks(self, rows: DataFrame, source: bool) -> DataFrame:
        """``rows`` of a segment once for each block whose sources (or targets) are in it, with ``block`` for ``seg``."""
        others = F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))
        pair = F.col("seg") * self.groups + F.col("__other") if source else F.col("__other") * self.groups + F.col("seg")
        pairs = rows.withColumn("__other", others).withColumn("__pair", pair)
        splits = F.explode(F.sequence(F.lit(0), self._splits(F.col("__pair")) - 1))
        dealt = pairs.withColumn("__split", splits)
        return dealt.withColumn("block", F.col("__pair").cast("bigint") * MAX_SPLITS + F.col("__split")).drop(
            "seg", "__other", "__pair", "__split")

    def _to_both(self, rows: DataFrame):
        """``rows`` of a segment for each block with an end in it, ``source`` says which, grouped by block."""
        sent = self._to_blocks(rows, True).withColumn("source", F.lit(True))
        return sent.unionByName(self._to_blocks(rows, False).withColumn("source", F.lit(False))).groupBy("block")

    def partials(self, vector: DataFrame) -> DataFrame:
        """Products of the blocks with ``vector`` (sample, seg, value, state); their sum by segment is the product."""
        kind, divisor = vector.schema["sample"].dataType.simpleString(), self.divisor
        sent = self._to_blocks(vector, True)

        def products(blocks: pa.Table, vectors: pa.Table) -> pa.Table:
            return _products(blocks, vectors, divisor)

        return self.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(products, f"sample {kind}, {VECTOR}")

    def product(self, vector: DataFrame) -> DataFrame:
        """``(sample, seg, value, state)``: the sum of ``w · value`` over the edges into each node."""
        kind = vector.schema["sample"].dataType.simpleString()
        return self.partials(vector).groupBy("sample", "seg").applyInArrow(_summed, f"sample {kind}, {VECTOR}")

    def degrees(self) -> DataFrame:
        """The sum of the weights out of each node, as a vector."""
        groups, divisor = self.groups, self.divisor

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _out_weights(pa.Table.from_batches([batch]), groups, divisor).to_batches()

        return self.blocks.mapInArrow(parts, f"sample int, {VECTOR}").groupBy("sample", "seg").applyInArrow(_summed, f"sample int, {VECTOR}")

    def laplacian(self) -> EdgeBlocks:
        """The blocks of ``I − D^-1/2 S D^-1/2``; equal edges are added up, and the table's rows are read from its blocks."""
        degrees = materialise(self.degrees().select("seg", "value", "state"), "degree")
        groups, divisor = self.groups, self.divisor

        def scaled(blocks: pa.Table, ends: pa.Table) -> pa.Table:
            return _laplacian(blocks, ends, groups, divisor)

        other = copy.copy(self)
        other.divisor = 1.0
        other._store(self.blocks.groupBy("block").cogroup(self._to_both(degrees)).applyInArrow(scaled, BLOCK_DDL))
        kind = self.node_type.simpleString()
        rows = other.blocks.groupBy("block").cogroup(self._to_both(self.nodes.select("seg", "node"))).applyInArrow(
            _unpacked, f"src {kind}, dst {kind}, w double")
        # a node without a name has a degree, so a diagonal, but is joined to nothing
        unnamed = self.edges.where(F.col("src").isNull()).limit(1).select(F.lit(None).cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(1.0).alias("w"))
        other.edges = rows.union(unnamed)
        return other

    def vector(self, signal: DataFrame) -> DataFrame:
        """Rows (sample, node, value) as a vector; nodes without an edge have no place in it."""
        kind = signal.schema["sample"].dataType.simpleString()
        node = F.col("node").try_cast(self.node_type)
        rows = signal.where(F.col("node").isNotNull()).select("sample", node.alias("node"), F.col("value").cast("double").alias("value"))
        rows = rows.where(F.col("node").isNotNull()).withColumn("seg", self._segment("node"))
        return self.nodes.select("seg", "node").groupBy("seg").cogroup(rows.groupBy("seg")).applyInArrow(
            _placed, f"sample {kind}, {VECTOR}")

    def start(self, number: Callable[[Column], Column]) -> DataFrame:
        """A vector with ``number(node)`` at the nodes with an edge out and 0 at all others."""
        value = _where(F.transform("node", number), "out")
        return self.nodes.select(F.lit(0).alias("sample"), "seg", value.alias("value"), F.lit(b"").alias("state"))

    def rows(self, vector: DataFrame) -> DataFrame:
        """A vector as rows (sample, node, value)."""
        kind = vector.schema["sample"].dataType.simpleString()
        return self.nodes.select("seg", "node").groupBy("seg").cogroup(vector.groupBy("seg")).applyInArrow(
            _named, f"sample {kind}, node {self.node_type.simpleString()}, value double")


@F.arrow_udf(BinaryType())
def _where(numbers: pa.Array, kept: pa.Array) -> pa.Array:
    cells = (np.where(k.values.to_numpy(zero_copy_only=False), x.values.to_numpy(), 0.0) for x, k in zip(numbers, kept))
    return pa.array([c.tobytes() for c in cells], pa.binary())


@F.arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner product of two packed columns."""
    return pa.array([float(_numbers(x, float) @ _numbers(y, float)) for x, y in zip(a, b)], pa.float64())


def combined(p: float, a: str, q: float, b: str) -> Column:
    """``p · a + q · b`` of two packed columns."""

    @F.arrow_udf(BinaryType())
    def mixed(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([(p * _numbers(i, float) + q * _numbers(j, float)).tobytes() for i, j in zip(x, y)], pa.binary())

    return mixed(a, b)


def _numbers(cell: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _members(column: pa.ChunkedArray) -> pa.Array:
    """The list in the only row of a column."""
    return column[0].values


def _packed(edges: pa.Table, ends: pa.Table, groups: int) -> pa.Table:
    """One row per block: places of the edges' ends in their segments and the weights, by target; ``known`` only beside null weights."""
    if not edges.num_rows:
        return BLOCK.empty_table()
    of = {s: _members(ends.filter(pc.equal(ends["source"], s))["node"]) for s in (True, False)}
    src, dst = (pc.index_in(edges[c], value_set=of[c == "src"]).to_numpy().astype(np.int32) for c in ("src", "dst"))
    order = np.argsort(dst, kind="stable")
    weight, block = edges["w"], edges["block"][0].as_py()
    known = pc.is_valid(weight).to_numpy()[order].tobytes() if weight.null_count else b""
    weight = pc.fill_null(weight, 0.0).to_numpy()[order].tobytes()
    cells = [block, block // MAX_SPLITS % groups, len(of[False]), len(of[True]), src[order].tobytes(), dst[order].tobytes(), weight, known]
    return pa.table([[c] for c in cells], schema=BLOCK)


def _products(blocks: pa.Table, vectors: pa.Table, divisor: float) -> pa.Table:
    out = []
    for block in range(blocks.num_rows):
        seg, size = blocks["seg"][block].as_py(), blocks["size"][block].as_py()
        src, dst = (_numbers(blocks[c][block], np.int32) for c in ("src", "dst"))
        weight, known = _numbers(blocks["w"][block], float), _numbers(blocks["known"][block], bool)
        weight = weight / divisor if divisor != 1.0 else weight
        for k in range(vectors.num_rows):
            with np.errstate(invalid="ignore"):  # numbers where there is no value
                product = _numbers(vectors["value"][k], float)[src] * weight
            at = _numbers(vectors["state"][k], np.uint8)
            if not len(at):
                product = np.where(known, product, 0.0) if len(known) else product
                out.append((vectors["sample"][k], seg, np.bincount(dst, product, size), at))
                continue
            at = at[src]
            good = (at == VALUE) & known if len(known) else at == VALUE
            state = np.zeros(size, np.uint8)
            if good.all():
                state[dst] = VALUE
            else:
                product = np.where(good, product, 0.0)
                state[dst[at > ABSENT]] = NULL
                state[dst[good]] = VALUE
            if state.any():
                out.append((vectors["sample"][k], seg, np.bincount(dst, product, size), state))
    return _vector_rows(out, vectors.schema.field("sample").type)


def _out_weights(blocks: pa.Table, groups: int, divisor: float) -> pa.Table:
    out = []
    for block in range(blocks.num_rows):
        seg, size = blocks["block"][block].as_py() // MAX_SPLITS // groups, blocks["sources"][block].as_py()
        src, weight, known = _numbers(blocks["src"][block], np.int32), _numbers(blocks["w"][block], float), _numbers(blocks["known"][block], bool)
        state = np.zeros(size, np.uint8)
        state[src] = NULL if len(known) else VALUE
        state[src[known] if len(known) else src[:0]] = VALUE
        out.append((pa.scalar(0, pa.int32()), seg, np.bincount(src, weight / divisor, size), state))  # unknown weights are stored as 0
    return _vector_rows(out, pa.int32())


def _laplacian(blocks: pa.Table, ends: pa.Table, groups: int, divisor: float) -> pa.Table:
    """A block of the Laplacian, made from that of the table and the degrees at its ends."""
    block = (blocks if blocks.num_rows else ends)["block"][0].as_py()
    pair, split = divmod(block, MAX_SPLITS)
    rows = {s: ends.filter(pc.equal(ends["source"], s)) for s in (True, False)}
    value = {s: _numbers(t["value"][0], float) if t.num_rows else None for s, t in rows.items()}
    state = {s: _numbers(t["state"][0], np.uint8) if t.num_rows else None for s, t in rows.items()}
    src = dst = np.zeros(0, np.int32)
    weight, known = np.zeros(0), np.zeros(0, bool)
    if blocks.num_rows:
        src, dst = (_numbers(blocks[c][0], np.int32) for c in ("src", "dst"))
        if value[False] is None or (state[False][dst] != VALUE).any():
            raise ValueError("the edge table lacks the other direction of an edge")
        weight, known = _numbers(blocks["w"][0], float) / divisor, _numbers(blocks["known"][0], bool)
        known = (known if len(known) else np.ones(len(src), bool)) & (state[True][src] == VALUE)
        with np.errstate(invalid="ignore"):
            root = np.sqrt(value[True][src] * value[False][dst])
        if (root[known] == 0).any():
            raise ZeroDivisionError("the degree of a node with an edge is 0")
        weight = np.divide(-weight, root, out=np.zeros(len(src)), where=known)
    if pair // groups == pair % groups and split == 0 and value[True] is not None:
        place = np.flatnonzero(state[True]).astype(np.int32)
        src, dst = np.concatenate([src, place]), np.concatenate([dst, place])
        weight, known = np.concatenate([weight, np.ones(len(place))]), np.concatenate([known, np.ones(len(place), bool)])
    if not len(src):
        return BLOCK.empty_table()
    sources, size = len(value[True]), blocks["size"][0].as_py() if blocks.num_rows else len(value[False])
    edge = dst.astype(np.int64) * sources + src
    order = np.argsort(edge, kind="stable")
    edge = edge[order]
    first = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
    src, dst = (edge[first] % sources).astype(np.int32), (edge[first] // sources).astype(np.int32)
    weight, known = np.add.reduceat(weight[order], first), np.logical_or.reduceat(known[order], first)
    cells = [block, pair % groups, size, sources, src.tobytes(), dst.tobytes(), weight.tobytes(), b"" if known.all() else known.tobytes()]
    return pa.table([[c] for c in cells], schema=BLOCK)


def _unpacked(blocks: pa.Table, ends: pa.Table) -> pa.Table:
    """The edges of a block by name."""
    of = {s: _members(t["node"]) for s in (True, False) if (t := ends.filter(pc.equal(ends["source"], s))).num_rows}
    tables = [pa.table({"src": pa.array([], t), "dst": pa.array([], t), "w": pa.array([], pa.float64())}) for t in [ends.schema.field("node").type.value_type]]
    for k in range(blocks.num_rows):
        src, dst = (pa.array(_numbers(blocks[c][k], np.int32)) for c in ("src", "dst"))
        known = _numbers(blocks["known"][k], bool)
        w = pa.array(_numbers(blocks["w"][k], float), mask=~known if len(known) else None)
        tables.append(pa.table({"src": of[True].take(src), "dst": of[False].take(dst), "w": w}))
    return pa.concat_tables(tables)


def _vector_rows(rows: list, kind: pa.DataType) -> pa.Table:
    samples = pa.array([r[0].as_py() for r in rows], kind)
    columns = [pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (2, 3))]
    return pa.Table.from_arrays([samples, *columns], ["sample", "seg", "value", "state"])


def _summed(parts: pa.Table) -> pa.Table:
    value = sum(_numbers(c, float) for c in parts["value"])
    state = np.maximum.reduce([_numbers(c, np.uint8) for c in parts["state"]])
    return _vector_rows([(parts["sample"][0], parts["seg"][0].as_py(), value, state)], parts.schema.field("sample").type)


def _placed(nodes: pa.Table, signal: pa.Table) -> pa.Table:
    out = []
    if nodes.num_rows and signal.num_rows:
        names = _members(nodes["node"])
        signal = signal.append_column("at", pc.index_in(signal["node"], value_set=names))
        coded = signal["sample"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, place = coded.indices.to_numpy(), signal["at"]
        linked, given = pc.is_valid(place).to_numpy(), pc.is_valid(signal["value"]).to_numpy()
        place, value = pc.fill_null(place, 0).to_numpy(), pc.fill_null(signal["value"], 0.0).to_numpy()
        for code, sample in enumerate(coded.dictionary):
            mine = linked & (codes == code)
            if mine.any():
                state = np.zeros(len(names), np.uint8)
                state[place[mine]] = NULL
                state[place[mine & given]] = VALUE
                total = np.bincount(place[mine], value[mine], len(names))
                out.append((sample, nodes["seg"][0].as_py(), total, state))
    return _vector_rows(out, signal.schema.field("sample").type)


def _named(nodes: pa.Table, vectors: pa.Table) -> pa.Table:
    kind = vectors.schema.field("sample").type
    tables = [pa.table({"sample": pa.array([], kind), "node": pa.array([], nodes.schema.field("node").type.value_type), "value": pa.array([], pa.float64())})]
    for k in range(vectors.num_rows):
        state = _numbers(vectors["state"][k], np.uint8)
        place = np.flatnonzero(state)
        value = pa.array(_numbers(vectors["value"][k], float)[place], mask=state[place] == NULL)
        sample = pa.array([vectors["sample"][k].as_py()], kind).take(pa.array(np.zeros(len(place), np.int32)))
        tables.append(pa.table({"sample": sample, "node": _members(nodes["node"]).take(pa.array(place)), "value": value}))
    return pa.concat_tables(tables)
