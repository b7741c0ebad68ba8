import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph as gr
from sparkloom.operators.blocks import EdgeBlocks
from sparkloom.operators.skew import SaltedEdges


def odd_edges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(40), rng.choice([.5, 1.0, -2.0, None])) for _ in range(200)]
    rows += [(None, 3, 1.0), (4, None, 2.0), (5, None, None), (6, 7, None), (6, 7, 1.5), (6, 7, 1.5), (50, 51, None), (1, 60, float("inf"))]
    return spark.createDataFrame(rows, "src int, dst int, w double")


@pytest.mark.parametrize("min_hot_rows", [10**6, 3])
def test_products_of_blocks_are_those_of_the_join(spark, rows, min_hot_rows):
    edges = odd_edges(spark)
    values = [("a", i, float(i) / 3) for i in range(20)] + [("a", 3, 1.0), ("a", 6, None), ("b", 50, 1.0), (None, 4, 2.0), ("c", None, 1.0), ("c", 999, 1.0)]
    signal = spark.createDataFrame(values, "sample string, node bigint, value double")
    blocks = EdgeBlocks(edges, min_hot_rows)
    assert bool(blocks.splits) == (min_hot_rows == 3)
    got, want = blocks.vector(signal), signal
    for _ in range(2):
        got, want = blocks.product(got), gr._step(SaltedEdges.of(edges, ["src", "dst", "w"], "src", "dst"), want)
        assert rows(blocks.rows(got)) == rows(want)
    assert rows(blocks.divided(4.0).rows(blocks.divided(4.0).product(blocks.vector(signal)))) == rows(
        gr._step(SaltedEdges.of(edges.withColumn("w", F.col("w") / 4), ["src", "dst", "w"], "src", "dst"), signal))


@pytest.mark.parametrize("min_hot_rows", [10**6, 3])
def test_laplacian_of_blocks(spark, rows, min_hot_rows):
    pairs = [(0, 1, 2.0), (1, 2, 1.0), (1, 2, 3.0), (2, 3, None), (0, 4, .5), (3, 4, 1.0), (5, 5, 2.0), (0, 5, 1.0), *((i, i + 1, 1.5) for i in range(6, 40))]
    both = [e for i, j, w in pairs for e in {(i, j, w), (j, i, w)}]
    degree, want = {}, {}
    for i, _, w in both:
        degree[i] = degree.get(i, 0) + (w or 0)
    for i, j, w in both:
        term = None if w is None else -w / (degree[i] * degree[j]) ** .5
        want[i, j] = term if want.get((i, j)) is None else want[i, j] + (term or 0)
    want |= {(i, i): 1.0 + want.get((i, i), 0) for i in degree}
    edges = spark.createDataFrame(both, "src int, dst int, w double")
    cut = EdgeBlocks(edges, min_hot_rows)
    assert rows(gr.laplacian(cut)) == sorted(((i, j, w if w is None else round(w, 9)) for (i, j), w in want.items()), key=repr)


def test_laplacian_of_unnamed_and_one_way_edges(spark, rows):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0)], "src int, dst int, w double")
    unnamed = edges.union(spark.createDataFrame([(None, 1, 1.0)], edges.schema))
    assert (None, None, 1.0) in rows(gr.laplacian(unnamed))
    with pytest.raises(Exception, match="lacks the other direction"):
        gr.laplacian(edges.union(spark.createDataFrame([(1, 99, 1.0)], edges.schema))).count()


def test_the_laplacian_deals_its_edges_once(spark):
    edges = spark.createDataFrame([(i, (i + k) % 50, 1.0) for i in range(50) for k in (1, 7, 43, 49)], "src int, dst int, w double")
    plan = gr.laplacian(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # its rows are read from blocks


def test_text_nodes_and_many_samples(spark, rows, monkeypatch):
    edges = spark.createDataFrame([("x", "y", 2.0), ("y", "x", 2.0), ("y", "z", 1.0), ("z", "y", 1.0)], "src string, dst string, w double")
    signal = spark.createDataFrame([(1, "x", 1.0), (2, "z", 3.0)], "sample int, node string, value double")
    dense = rows(gr.diffuse(edges, signal, 3))
    monkeypatch.setattr(gr, "DENSE_SAMPLES", 1)
    assert rows(gr.diffuse(edges, signal, 3)) == rows(gr.diffuse(EdgeBlocks(edges), signal, 3)) == dense


def test_a_step_sends_segments_and_no_products_of_edges(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(100), rng.randrange(100)) for _ in range(4000)}
    edges = spark.createDataFrame([(i, j, 1.0) for a, b in pairs for i, j in ((a, b), (b, a))], "src int, dst int, w double")
    scaled = gr.scaled_edges(edges)
    signal = spark.createDataFrame([(0, i, 1.0) for i in range(100)], "sample int, node int, value double")
    vector = scaled.vector(signal)
    # a product sends a row per block to the next shuffle, not one per edge or per pair of a task and a node
    assert scaled.partials(vector).count() <= scaled.groups ** 2 <= 16
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scaled.partials(vector)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = plan.split(":- ")[1].split("+- Sort")[0]
    assert "Bucketed: true" in plan and "Exchange" not in stored  # the blocks are not shuffled again
