import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import experiments as ex
from sparkloom.operators import graph as gr

N = 20


def adjacency(seed=1, bipartite=False):
    rng = random.Random(seed)
    a = np.zeros((N, N))
    for i in range(N):
        for j in range(i + 1, N):
            if rng.random() < .35 and (not bipartite or (i + j) % 2):
                a[i, j] = a[j, i] = rng.randint(1, 4)
    for i in range(N - 1):  # connected
        if not a[i, i + 1]:
            a[i, i + 1] = a[i + 1, i] = 1
    return a


def edges_of(spark, a):
    return spark.createDataFrame(
        [(i, j, float(a[i, j])) for i in range(N) for j in range(N) if a[i, j]], "src bigint, dst bigint, w double")


@pytest.fixture(scope="module")
def a():
    return adjacency()


@pytest.fixture(scope="module")
def edges(spark, a):
    return edges_of(spark, a).cache()


def vector(df, column="value"):
    out = np.zeros(N)
    for r in df.collect():
        out[r["node"]] = r[column]
    return out


def test_degree_and_top(spark, a, edges):
    got = {r["node"]: (r["degree"], r["n"]) for r in gr.degree(edges).collect()}
    assert got == {i: (a[i].sum(), (a[i] > 0).sum()) for i in range(N)}
    top = [r["node"] for r in gr.top_nodes(gr.degree(edges), 4).collect()]
    assert top == sorted(range(N), key=lambda i: (-a[i].sum(), i))[:4]
    groups = spark.createDataFrame([(i, i % 3) for i in range(N)], "node bigint, community int")
    for r in gr.source_nodes(gr.degree(edges), groups).collect():
        members = [i for i in range(N) if i % 3 == r["community"]]
        assert r["node"] == min(members, key=lambda i: (-a[i].sum(), i))


def test_fuse(spark):
    layers = spark.createDataFrame([(1, 2, 1.0), (1, 2, 2.0), (2, 1, 5.0), (2, 3, 4.0)], "src bigint, dst bigint, w double")
    got = {(r["src"], r["dst"]): r["w"] for r in gr.fuse_edges(layers).collect()}
    assert got == {(1, 2): 4.0, (2, 1): 4.0, (2, 3): 2.0, (3, 2): 2.0}
    assert {(r["src"], r["dst"]): r["w"] for r in gr.fuse_edges(layers, undirected=False).collect()}[1, 2] == 3.0


def test_split_and_batches(spark):
    nodes = spark.range(5000).withColumnRenamed("id", "node")
    shares = {r["split"]: r["count"] for r in gr.split(nodes, .7, .2).groupBy("split").count().collect()}
    assert sum(shares.values()) == 5000 and abs(shares["train"] - 3500) < 150
    sizes = {r["batch"]: r["count"] for r in gr.minibatches(nodes, 1024).groupBy("batch").count().collect()}
    assert sizes == {0: 1024, 1: 1024, 2: 1024, 3: 1024, 4: 904}


def test_neighbour_sample(spark, a, edges):
    seeds = spark.createDataFrame([(0,), (7,), (7,)], "node bigint")
    got = [tuple(r) for r in gr.sample_neighbours(edges, seeds, (2, 3), seed=5).collect()]
    assert len(got) == len(set(got))
    frontier = {0, 7}
    for layer, fanout in enumerate((2, 3)):
        chosen = {}
        for lay, dst, src in got:
            if lay == layer:
                assert a[src, dst] > 0
                chosen.setdefault(dst, set()).add(src)
        assert {d: len(s) for d, s in chosen.items()} == {d: min(fanout, (a[:, d] > 0).sum()) for d in frontier}
        frontier |= set().union(*chosen.values())
    salted = gr.sample_neighbours(edges, seeds, (2, 3), seed=5, min_hot_rows=1)
    assert sorted(map(tuple, salted.collect())) == sorted(got)


def test_hot_node_joins_salted_and_whole(spark):
    from sparkloom.operators.skew import SaltedEdges

    star = spark.createDataFrame(
        [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 400)], "src bigint, dst bigint")
    side = SaltedEdges(star, "src", "dst", min_hot_rows=50)
    assert side.hot == [0]
    assert side.edges.where("src = 0").select("__salt").distinct().count() > 20
    nodes = spark.range(400).select(F.col("id").alias("node"), (F.col("id") * 2).alias("value"))
    joined = side.join(nodes)
    assert joined.count() == 798 and joined.where("value <> src * 2").count() == 0


@pytest.mark.parametrize("min_hot_rows", [10**6, 50])
def test_bucketed_edges_are_not_shuffled_again(spark, min_hot_rows):
    from sparkloom.operators.skew import SaltedEdges

    star = spark.createDataFrame([(i % 5 * (i % 3), i) for i in range(400)], "src bigint, dst bigint")
    side = SaltedEdges(star, "src", "dst", min_hot_rows=min_hot_rows, bucket_bytes=0)
    assert bool(side.hot) == (min_hot_rows == 50)
    nodes = spark.range(10).withColumnRenamed("id", "node").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = side.join(nodes)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the node side is shuffled (twice, with the repartition above), the edges are not
    edge_side = plan.split("SortMergeJoin")[1].split(":- ")[1].split("+- Sort")[0]
    assert "Bucketed: true" in plan and "Exchange" not in edge_side


def test_mean_neighbours(spark, a, edges):
    x = np.arange(2.0 * (N + 1)).reshape(-1, 2)
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(N + 1)], "node bigint, x array<double>")
    for options in ({}, {"min_hot_rows": 1}):
        got = {r["node"]: r["m"] for r in gr.mean_neighbours(edges, features, 2, **options).collect()}
        for i in range(N):
            assert np.allclose(got[i], x[:N][a[:, i] > 0].mean(axis=0))
        assert got[N] == [0.0, 0.0]  # no in-edges
    ws, wn, b = np.array([[1., -2.], [-.5, .1]]), np.array([[.5, .5], [1., -1.]]), np.array([.1, -.2])
    layer = {r["node"]: r["x"] for r in gr.sage_layer(edges, features, ws.tolist(), wn.tolist(), b.tolist()).collect()}
    for i in range(N + 1):
        assert np.allclose(layer[i], np.maximum(ws @ x[i] + wn @ np.array(got[i]) + b, 0))


def test_diffusion(spark, a, edges):
    x = np.arange(N) / 7.0
    signal = spark.createDataFrame([(1, i, float(x[i])) for i in range(N)], "sample int, node bigint, value double")
    for options in ({}, {"min_hot_rows": 1}):
        waves = gr.diffuse(edges, signal, 4, **options).cache()
        for t in range(4):
            assert np.allclose(vector(waves.where(F.col("t") == t)), np.linalg.matrix_power(a, t) @ x)
    taps = [.5, .3, .1]
    want = sum(h * np.linalg.matrix_power(a, k) @ x for k, h in enumerate(taps))
    assert np.allclose(vector(gr.filtered(waves, taps)), want)
    assert np.allclose(vector(gr.shift_features(waves, 3), "s2"), a @ a @ x)


def test_local_max(spark, a, edges):
    x = np.array([(i * 7) % 20 for i in range(N)], dtype=float)
    signal = spark.createDataFrame([(i, float(x[i])) for i in range(N)], "node bigint, value double")
    near = np.linalg.matrix_power(np.eye(N) + (a > 0), 2) > 0
    assert np.allclose(vector(gr.local_max(edges, signal, 2)), [x[near[i]].max() for i in range(N)])


@pytest.mark.parametrize("bipartite", [False, True])
def test_spectrum(spark, bipartite):
    a = adjacency(3, bipartite)
    edges = edges_of(spark, a)
    radius = gr.spectral_radius(edges, 1e-8)
    assert radius == pytest.approx(abs(np.linalg.eigvalsh(a)).max(), rel=1e-5)
    d = a.sum(axis=1)
    lap = np.eye(N) - a / np.sqrt(np.outer(d, d))
    got = np.zeros((N, N))
    for r in gr.laplacian(edges).collect():
        got[r["src"], r["dst"]] = r["w"]
    assert np.allclose(got, lap)


@pytest.mark.parametrize("bipartite", [False, True])
def test_lanczos_is_exact_to_its_tolerance(spark, bipartite):
    a = adjacency(11, bipartite)
    edges = edges_of(spark, a)
    want = abs(np.linalg.eigvalsh(a)).max()
    assert gr.spectral_radius(edges) == pytest.approx(want, rel=1e-9)
    assert gr.spectral_radius(edges, method="power") == pytest.approx(want, rel=1e-5)
    pair = spark.createDataFrame([(0, 1, -2.0), (1, 0, -2.0), (2, 2, 0.5)], "src int, dst int, w double")
    assert gr.spectral_radius(pair) == pytest.approx(2.0)
    assert gr.spectral_radius(pair.limit(0)) == 0
    assert gr.spectral_radius(pair.withColumn("w", F.lit(0.0))) == 0


def test_laplacian_spreads_hot_nodes(spark):
    star = np.zeros((N, N))
    star[0, 1:] = star[1:, 0] = np.arange(1, N)
    edges = gr.SaltedEdges(edges_of(spark, star), "src", "dst", min_hot_rows=2)
    assert edges.hot
    d = star.sum(axis=1)
    got = {(r["src"], r["dst"]): r["w"] for r in gr.laplacian(edges).collect()}
    want = np.eye(N) - star / np.sqrt(np.outer(d, d))
    assert got == {(i, j): pytest.approx(want[i, j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(want)))}


def test_rescaled_laplacian_and_scale(spark, a, edges):
    top = gr.spectral_radius(gr.laplacian(edges), 1e-8)
    assert top == pytest.approx(np.linalg.eigvalsh(np.eye(N) - a / np.sqrt(np.outer(a.sum(1), a.sum(1)))).max(), rel=1e-5)
    trace = gr.rescaled_laplacian(edges, 1e-8).where("src = dst").agg(F.sum("w")).first()[0]
    assert trace == pytest.approx(N * (2 / top - 1))
    scaled = gr.spectral_scale(edges, 1e-8).agg(F.sum("w")).first()[0]
    assert scaled == pytest.approx(a.sum() / abs(np.linalg.eigvalsh(a)).max(), rel=1e-5)


def test_source_data_set(spark, a, edges):
    sources = spark.createDataFrame([(3,), (8,)], "node bigint")
    rows = gr.source_data_set(edges, sources, 3, .5, .25).cache()
    assert np.allclose(vector(rows.where("label = 8 and t = 2")), np.linalg.matrix_power(a, 2)[8])
    assert rows.groupBy("label", "t").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1)], "prediction int, label int")
    assert tuple(gr.accuracy(rows).first()) == (.75, .25)
    epochs = spark.createDataFrame([(0, .5), (1, .9), (2, .9)], "epoch int, acc double")
    assert tuple(gr.best_epoch(epochs).first()) == (1, .9)


def test_classification(spark):
    rng = random.Random(1)
    pairs = [(i, j, 1.0) for i in range(60) for j in range(60) if i != j and rng.random() < (.3 if i % 2 == j % 2 else .02)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, w double")
    features = spark.createDataFrame([(i, [float(i % 2) + rng.gauss(0, 1), 1.0]) for i in range(60)], "node bigint, x array<double>")
    labels = gr.split(features.select("node", F.when(F.col("node") % 2 == 0, "even").otherwise("odd").alias("label")), .6, .1)
    scored = gr.classify_nodes(edges, features, labels, 2, rounds=2)
    assert scored.count() == 60
    assert gr.accuracy(scored.where("split <> 'train'")).first()["accuracy"] > .9
    with pytest.warns(RuntimeWarning, match="after 1 iterations"):
        gr.classify_nodes(edges, features, labels, 2, rounds=2, max_iter=1)


def test_a_saved_classifier_predicts_alike_and_needs_no_label(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], "abc"[i % 3], "train") for i in range(30)], "node int, x array<double>, label string, split string")
    gr.fit_classifier(rows).save(str(tmp_path / "classifier"))
    scored = PipelineModel.load(str(tmp_path / "classifier")).transform(gr.with_features(rows.select("node", "x")))
    assert {r["node"]: r["prediction"] for r in scored.collect()} == {i: "abc"[i % 3] for i in range(30)}


def test_experiments(spark):
    runs = spark.createDataFrame([("pickdegG00R03",), ("pickG01R00",), ("other",)], "run string")
    models = spark.createDataFrame([("pick",), ("pickdeg",), ("Agg",)], "model string")
    assert {tuple(r) for r in ex.run_models(runs, models).collect()} == {("pickdegG00R03", "pickdeg"), ("pickG01R00", "pick")}
    assert ex.run_models(runs, spark.createDataFrame([("",), ("x" * 40,), (None,)], "model string")).count() == 0
    rng = random.Random(2)
    data = [("m", g, r, s, rng.random()) for g in range(3) for r in range(g + 1) for s in range(5)]
    results = spark.createDataFrame(data, "model string, graph int, realization int, step int, value double")
    per_graph = {"best": [], "last": []}
    for g in range(3):
        mine = [[v for _, gg, rr, _, v in data if gg == g and rr == r] for r in range(g + 1)]
        per_graph["best"].append(np.mean([min(m) for m in mine]))
        per_graph["last"].append(np.mean([m[-1] for m in mine]))
    for r in ex.summary(results).collect():
        assert r["mean"] == pytest.approx(np.mean(per_graph[r["metric"]]))
        assert r["std"] == pytest.approx(np.std(per_graph[r["metric"]]))
    assert {r["step"] for r in ex.curves(results, every=2).collect()} == {0, 2, 4}


def test_fuse_groups_a_pair_once(spark):
    layers = spark.createDataFrame(
        [(1, 2, 3.0), (2, 1, 1.0), (3, 3, 5.0), (None, 3, 2.0), (3, None, 1.0), (None, None, 7.0), (1, 2, 2.0)], "src int, dst int, w double")
    fused = gr.fuse_edges(layers)
    got = {(r["src"], r["dst"]): r["w"] for r in fused.collect()}
    assert got == {(1, 2): 3.0, (2, 1): 3.0, (3, 3): 5.0, (None, 3): 1.5, (3, None): 1.5, (None, None): 7.0}
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # directions are told apart after the rows are grouped


def test_the_registered_diffusion_reaches_all_times(spark, tmp_path, monkeypatch):
    """The original's tMax is 25: S^t x for every t below it, not only for as many as a filter has taps."""
    from sparkloom.plans import graph_queries

    pairs = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 2)]
    spark.createDataFrame(pairs, "l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 16 * k, 900.0) for k in (1, 2, 3)], "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 8 * k, 100.0) for k in (1, 2)], "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    nodes = [2, 4, 6, 3, 5]
    s = np.zeros((5, 5))
    for part, supplier in pairs:
        i, j = nodes.index(2 * part), nodes.index(2 * supplier + 1)
        s[i, j] += 1
        s[j, i] += 1
    s /= np.abs(np.linalg.eigvalsh(s)).max()
    scaled = [(nodes[i], nodes[j], float(s[i, j])) for i in range(5) for j in range(5) if s[i, j]]
    monkeypatch.setattr(graph_queries, "_scaled", lambda *_: spark.createDataFrame(scaled, "src bigint, dst bigint, w double"))
    got = {(r["t"], r["node"]): r["value"] for r in graph_queries.QUERIES["gr_diffuse"](spark, str(tmp_path)).collect()}
    x = np.array([.25, .5, .75, .25, .5])
    for t in range(25):
        assert [got.pop((t, n)) for n in nodes] == pytest.approx((np.linalg.matrix_power(s, t) @ x).tolist(), abs=2e-6)
    assert not got
