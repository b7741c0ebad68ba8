"""Shards along a Hilbert curve over metadata, in DataFrame functions only.

Three dimensions (source, language, size) are quantised to 5 bits each, a document's place on
the three-dimensional Hilbert curve is its sort key, and runs of equal bytes are the shards.
Neighbouring shards hold neighbouring cells, so the minima and maxima of a shard's files
prune scans by any of the three. Equal texts take one cell and stay in one shard, unless
their group alone is a notable part of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_size, hash_share, running_sum, text_crc32
from sparkloom.operators.ranking import global_rank
from sparkloom.session import materialise

BITS = 5
_DIMS = 3


def _rotate(value: Column, by: Column) -> Column:
    """Rotate a three-bit number left; ``by`` is 0, 1 or 2 (a right turn by k is one by 3 - k)."""
    doubled = value * F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), by + 1)
    return (doubled % 8).bitwiseOR(F.floor(doubled / 8).cast("int")).cast("int")


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the three-dimensional Hilbert curve; each coordinate is in [0, 2^bits).

    Walks from the highest bit down and keeps the entry corner and the direction of the
    current sub-cube (Hamilton's form of the curve).
    """
    gray_rank = F.array(*[F.lit(i) for i in (0, 1, 3, 2, 7, 6, 4, 5)])  # inverse of i xor i/2
    entry = F.array(*[F.lit(0 if w == 0 else (k := 2 * ((w - 1) // 2)) ^ (k >> 1)) for w in range(8)])
    # trailing one bits of w - 1 (even w) or of w (odd w), mod 3
    turn = F.array(*[F.lit(0 if w == 0 else _ones(w if w % 2 else w - 1) % _DIMS) for w in range(8)])
    x, y, z = coordinates

    def digit(level: Column) -> Column:
        def bit(c: Column) -> Column:
            return F.floor(c / F.pow(F.lit(2.0), level)).cast("int") % 2

        return bit(x) + 2 * bit(y) + 4 * bit(z)

    def step(state: Column, level: Column) -> Column:
        e, d = state["e"], state["d"]
        inward = _rotate(digit(level).bitwiseXOR(e).cast("int"), (_DIMS - (d + 1) % _DIMS) % _DIMS)
        w = F.element_at(gray_rank, inward + 1)
        return F.struct(
            (state["h"] * 8 + w).cast("int").alias("h"),
            e.bitwiseXOR(_rotate(F.element_at(entry, w + 1), (d + 1) % _DIMS)).cast("int").alias("e"),
            ((d + F.element_at(turn, w + 1) + 1) % _DIMS).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda s: s["h"])


def _ones(number: int) -> int:
    count = 0
    while number & 1:
        number, count = number >> 1, count + 1
    return count


def _levels(rows: DataFrame, column: str) -> DataFrame:
    """(value, level): an order-preserving level by the share of rows before each value.

    One row per distinct value meets in one task.
    """
    ordered = Window.orderBy(F.col("value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(ordered), F.lit(0)) / F.sum("n").over(Window.partitionBy())
    return rows.groupBy(F.col(column).alias("value")).agg(F.sum("copies").alias("n")).select(
        "value", F.floor(share * 2**BITS).cast("int").alias("level")
    )


def shard(
    docs: DataFrame, shards: int = 8, whole_group_share: float = 0.01, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(carried columns, size, text_crc32, law, shard, slot), one row per document.

    The law is ``bytes``: sizes of shards are near equal. Groups of equal texts stay whole,
    but for those of more than ``whole_group_share`` of a shard: such a group's rows are spread
    over the stretch of the curve that the group covers, by a hash of their id. ``size`` is
    the UTF-8 bytes of the text (null: none) plus 1, so null and empty texts have size 1 and
    are one group. ``slot`` numbers a shard's rows from 0 along the curve. Null sources and
    languages sort last; ids may be null or repeated; an empty table gives an empty result.
    ``carry`` names the columns to keep; only they and the hash of the text move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id"),
        (byte_size(F.col("text")) + 1).alias("size"), text_crc32(F.col("text")).alias("crc"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"), "source", "lang",
    ), "shard-rows")
    # equal texts take the cell of their smallest source and language
    groups = rows.groupBy("g1", "g2").agg(
        F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("size").alias("size"),
        F.sum("size").alias("bytes"), F.count("*").alias("copies"),
    )
    groups = materialise(groups, "shard-groups")
    for column in ("source", "lang"):
        levels = _levels(groups, column).select(F.col("value").alias(f"v_{column}"), F.col("level").alias(f"l_{column}"))
        groups = groups.join(levels, F.col(column).eqNullSafe(F.col(f"v_{column}")))
    size_level = F.least(F.floor(F.log2(F.col("size").cast("double")) * 1.5), F.lit(2**BITS - 1)).cast("int")
    cells = groups.select("g1", "g2", "bytes", "copies", hilbert_index([F.col("l_source"), F.col("l_lang"), size_level]).alias("cell"))
    placed = running_sum(cells, ["cell", "g1", "g2"], "bytes").withColumnsRenamed({"g1": "p1", "g2": "p2"})

    whole = (F.col("copies") == 1) | (F.col("bytes") * shards <= F.col("total") * F.lit(whole_group_share))
    within = F.when(whole, 0.5).otherwise(hash_share(F.col("doc_id"), seed=7))
    at = (F.col("before") + F.col("bytes") * within) * shards / F.col("total")
    assigned = rows.join(placed, (F.col("g1") == F.col("p1")) & (F.col("g2") == F.col("p2"))).select(
        "row", "doc_id", "size", "crc", "g1", "g2", "cell", F.least(F.floor(at), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    ranked = global_rank(assigned, ["shard", "cell", "g1", "g2", F.col("doc_id").asc_nulls_last()], "rank")
    # at most one row per shard
    earlier = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranked.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("n")).select(
        "s", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    return ranked.join(bases, F.col("shard") == F.col("s")).select(
        "row.*", F.col("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("base") - 1).alias("slot"),
    )
