"""How the workloads read the given tables: each input as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import table

# --- discrete observations -------------------------------------------------

OBS_EDGES = [("pri", "st"), ("seg", "st")]
WIDE_EDGES = [*OBS_EDGES, ("st", "ls"), ("st", "rf")]


def observations(spark: SparkSession, root: str) -> DataFrame:
    """One row per order: id, segment, priority, status, and the date for batching."""
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("seg"),
        F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"),
        F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"),
    )


def wide_observations(spark: SparkSession, root: str) -> DataFrame:
    """One row per line item: the order's labels plus return flag, line status, line number."""
    lines = table(spark, root, "lineitem")
    return observations(spark, root).join(lines, F.col("id") == F.col("l_orderkey")).select(
        "seg", "pri", "st", F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        F.col("l_linenumber").cast("string").alias("ln"),
    )


OBS_SQL = """obs AS MATERIALIZED (
  SELECT o_orderkey AS id, c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS st,
         year(o_orderdate) AS year, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

WIDE_SQL = OBS_SQL + """, wide AS MATERIALIZED (
  SELECT seg, pri, st, l_returnflag AS rf, l_linestatus AS ls, CAST(l_linenumber AS VARCHAR) AS ln
  FROM obs JOIN lineitem ON id = l_orderkey)"""

# --- supply graph: region → nation → customer → order, nation → supplier → order ---


def supply_links(spark: SparkSession, root: str) -> DataFrame:
    nation = table(spark, root, "nation")
    customer = table(spark, root, "customer")
    supplier = table(spark, root, "supplier")
    orders = table(spark, root, "orders")
    lines = table(spark, root, "lineitem")

    def name(kind: str, col: str):
        return F.concat(F.lit(kind), F.col(col).cast("string"))

    def link(df, a, b):
        return df.select(name(*a).alias("parent"), name(*b).alias("child"))

    return (
        link(nation, ("R", "n_regionkey"), ("N", "n_nationkey"))
        .union(link(customer, ("N", "c_nationkey"), ("C", "c_custkey")))
        .union(link(supplier, ("N", "s_nationkey"), ("S", "s_suppkey")))
        .union(link(orders, ("C", "o_custkey"), ("O", "o_orderkey")))
        .union(link(lines.select("l_suppkey", "l_orderkey").distinct(),
                    ("S", "l_suppkey"), ("O", "l_orderkey")))
    )


LINKS_SQL = """links AS MATERIALIZED (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'O' || l_orderkey FROM lineitem)"""

# --- points ----------------------------------------------------------------

EMBEDDING_WIDTH = 64
LINE_WIDTH = 4


def embedding_points(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")
    )


def line_points(spark: SparkSession, root: str) -> DataFrame:
    """Line items as 4-dimensional points with comparable ranges."""
    return table(spark, root, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("id"),
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000,
                F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"),
    )


def event_points(spark: SparkSession, root: str) -> DataFrame:
    """Event values as 1-dimensional points."""
    return table(spark, root, "events").select(
        F.col("event_id").alias("id"), F.array("value").alias("x"))


EVENT_POINTS_SQL = "pts AS MATERIALIZED (SELECT event_id AS id, [value] AS x FROM events)"

EMBEDDING_SQL = """pts AS MATERIALIZED (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""

LINE_POINTS_SQL = """pts AS MATERIALIZED (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
           || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
         [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] AS x
  FROM lineitem)"""

# --- part–supplier graph ---------------------------------------------------


def trade_edges(spark: SparkSession, root: str) -> DataFrame:
    """Undirected weighted graph as both directions: parts are even nodes, suppliers odd."""
    pairs = (
        table(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey")
        .agg(F.count("*").cast("double").alias("w"))
        .select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), "w")
    )
    return both_ways(pairs)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b, w) → directed edges (src, dst, w) both ways, one pass over ``pairs``."""
    return pairs.select(
        F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                          F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w",
    ).select("e.src", "e.dst", "w")


TRADE_SQL = """pairs AS MATERIALIZED (
  SELECT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem GROUP BY 1, 2),
edges AS MATERIALIZED (
  SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs)"""
