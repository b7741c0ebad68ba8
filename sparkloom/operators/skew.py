"""Joins of an edge table with one row per node, safe against hot nodes.

A node whose edges exceed one partition's fair share is hot. There can be no more
hot nodes than partitions, so their names fit in the plan. Edges of a hot node are
spread over ``SPREAD`` salts and the node's row is repeated once per salt; all other
rows join unsalted. No row is dropped.

Large edge tables are stored in buckets of the join key, so that the rounds of an
iterative job shuffle only the node side.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import estimated_bytes, materialise, materialise_bucketed

SPREAD = 32
MIN_HOT_ROWS = 1_000_000
BUCKET_BYTES = 1 << 30


class SaltedEdges:
    """Stored edge table, ready to be joined on ``key`` many times."""

    def __init__(
        self, edges: DataFrame, key: str, other: str,
        min_hot_rows: int = MIN_HOT_ROWS, bucket_bytes: int = BUCKET_BYTES,
    ):
        self.key = key
        self.hot = []
        edges = materialise(edges, "edges")
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = edges.count()
        if rows > min_hot_rows:
            # more than rows/parts each: at most ``parts`` nodes
            degrees = edges.groupBy(key).agg(F.count("*").alias("n"))
            limit = max(min_hot_rows, rows // parts)
            self.hot = [r[key] for r in degrees.where(F.col("n") > limit).collect()]
        if self.hot:
            salt = F.pmod(F.xxhash64(other), F.lit(SPREAD)).cast("int")
            edges = edges.withColumn("__salt", F.when(F.col(key).isin(self.hot), salt).otherwise(0))
        if estimated_bytes(edges) > bucket_bytes:
            edges = materialise_bucketed(edges, [key, "__salt"] if self.hot else [key], parts)
        self.edges = edges

    @classmethod
    def of(cls, edges: DataFrame | SaltedEdges, columns: list[str], key: str, other: str, **options):
        """``edges`` itself if it is prepared already."""
        return edges if isinstance(edges, cls) else cls(edges.select(*columns), key, other, **options)

    @property
    def frame(self) -> DataFrame:
        return self.edges.drop("__salt")

    def with_weight(self, weight: Column) -> SaltedEdges:
        """The same stored edges with column ``w`` replaced."""
        other = copy.copy(self)
        other.edges = self.edges.withColumn("w", weight)
        return other

    def join(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """Inner join of the edges with ``rows`` on ``key = node``; ``node`` is dropped."""
        rows = rows.withColumnRenamed(node, self.key)
        if not self.hot:
            return self.edges.join(rows, self.key)
        return self.edges.join(_repeated(rows, self.key, self.hot), [self.key, "__salt"]).drop("__salt")


def _repeated(rows: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` with a salt; those of hot nodes once per salt."""
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return rows.withColumn("__salt", F.explode(F.coalesce(salts, F.array(F.lit(0)))))
