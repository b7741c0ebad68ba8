import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import KMeansJob
from sparkloom.functions import distance
from sparkloom.operators import anomalies as an
from sparkloom.operators import kmeans as km
from sparkloom.operators import silhouette as si
from sparkloom.sources.points import bad_cells, read_csv_points


def blobs(n=90, width=3, seed=1):
    rng = random.Random(seed)
    centres = [[rng.uniform(-9, 9) for _ in range(width)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 1) for c in centres[i % 3]]) for i in range(n)]


@pytest.fixture(scope="module")
def data():
    return blobs()


@pytest.fixture(scope="module")
def points(spark, data):
    return spark.createDataFrame(data, "id bigint, x array<double>").repartition(4).cache()


def test_seeds(spark, data, points):
    seeds = km.far_point_seeds(points, 4, seed=7)
    assert seeds[:3] == km.far_point_seeds(points, 3, seed=7)
    for k in range(1, 4):
        total = {i: sum(math.dist(x, s) for s in seeds[:k]) for i, x in data if x not in seeds[:k]}
        best = max(total.values())
        pick = min(i for i, t in total.items() if t == pytest.approx(best, abs=1e-12))
        assert seeds[k] == data[pick][1]


def test_seeds_with_carried_distances_equal_a_plain_loop(spark, data, points):
    k = 2 * km.CARRY + 4
    got = km.far_point_seeds(points, k, seed=7)
    x, want = dict(data), [got[0]]
    while len(want) < k:
        totals = {i: sum(math.dist(v, s) for s in want) for i, v in data if v not in want}
        best = max(totals.values())
        want.append(x[min(i for i, t in totals.items() if t == pytest.approx(best, abs=1e-9))])
    assert got == want


def test_a_run_that_returns_to_an_earlier_state_ends(points, monkeypatch):
    """Two states in turn, as rounding can cause with points midway between centroids."""
    a, b = [[0.0, 0.0, 0.0]], [[1.0, 0.0, 0.0]]
    turns = iter([b, a, b, a, b, a])

    class Means:
        def collect(self):
            return [{"run": 1, "cid": 0, "c": next(turns)[0]}]

    monkeypatch.setattr(km, "_run_means", lambda *_: Means())
    assert km.lloyd_runs(points, {1: a}) == {1: a}


def test_seeds_skip_equal_points(spark):
    same = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id bigint, x array<double>")
    assert sorted(km.far_point_seeds(same, 2)) == [[0.0], [1.0]]
    with pytest.raises(ValueError):
        km.far_point_seeds(same, 3)


def test_assign_ties_take_lowest(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id bigint, x array<double>")
    got = {r["id"]: (r["cid"], r["dist"]) for r in km.assign(df, [[1.0], [-1.0], [4.0]]).collect()}
    assert got == {1: (0, 1.0), 2: (2, 1.0)}


def test_large_model(spark):
    """3,000 centroids of 1,000 numbers, compared a block at a time."""
    rng = np.random.default_rng(3)
    model = rng.normal(0, 1, (3000, 1000))
    x = model[rng.integers(0, 3000, 24)] + rng.normal(0, 0.1, (24, 1000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>").repartition(2)
    got = {r["id"]: (r["cid"], r["dist"]) for r in km.assign(df, model.tolist()).collect()}
    gaps = np.sqrt(((x[:, None] - model[None]) ** 2).sum(axis=2))
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(gaps.argmin(axis=1)))
    assert all(got[i][1] == pytest.approx(gaps[i].min()) for i in got)


@pytest.mark.parametrize("width", [2, 4])
def test_width_of_points_and_model_must_agree(spark, width):
    df = spark.createDataFrame([(1, [1.0] * width)], "id bigint, x array<double>")
    with pytest.raises(Exception, match="the model has 3"):
        km.assign(df, [[1.0, 1.0, 1.0]]).collect()


def _lloyd(data, centroids, rounds):
    x, c = np.array([p for _, p in data]), np.array(centroids)
    for _ in range(rounds):
        near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def test_lloyd(data, points):
    start = [data[0][1], data[1][1], data[2][1], [1e6, 1e6, 1e6]]  # the last stays empty
    got = km.lloyd_runs(points, {4: start, 2: start[:2]}, rounds=500)
    assert np.allclose(got[4], _lloyd(data, start, 500))
    assert np.allclose(got[2], _lloyd(data, start[:2], 500))
    assert got[4][3] == [1e6, 1e6, 1e6]
    with pytest.raises(RuntimeError, match="still move"):
        km.lloyd_runs(points, {4: start}, rounds=1)
    centroids = km.fit(points, 3)
    assigned = km.assign(points, centroids)
    assert sum(r["n"] for r in km.cluster_sizes(assigned).collect()) == len(data)


def _silhouettes(data, labels, metric):
    x = np.array([p for _, p in data])
    gap = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    gap = gap ** 2 if metric == "squared" else gap
    out = []
    for i in range(len(x)):
        mean = {c: gap[i, labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in set(labels)}
        a = mean.pop(labels[i])
        alone = (labels == labels[i]).sum() == 1
        out.append(0 if alone or not mean else (min(mean.values()) - a) / max(min(mean.values()), a))
    return np.array(out)


@pytest.mark.parametrize("metric", ["squared", "euclidean"])
def test_silhouette(data, points, metric):
    models = {3: [data[0][1], data[1][1], data[2][1]], 1: [[0.0, 0.0, 0.0]], 4: [data[0][1], data[1][1], data[2][1], [50.0, 50.0, 50.0]]}
    x = np.array([p for _, p in data])
    for r, c in models.items():
        labels = ((x[:, None] - np.array(c)) ** 2).sum(axis=2).argmin(axis=1)
        got = {row["id"]: row["sil"] for row in si.silhouette(points, models, metric).where(F.col("run") == r).collect()}
        assert np.allclose([got[i] for i, _ in data], _silhouettes(data, labels, metric))


def test_euclidean_tiles_agree(points, data):
    assigned = km.assign_runs(points, {2: [data[0][1], data[1][1]]})
    small = {r["id"]: r["sil"] for r in si.euclidean_silhouette(assigned, tile_rows=11).collect()}
    whole = {r["id"]: r["sil"] for r in si.euclidean_silhouette(assigned).collect()}
    assert small == pytest.approx(whole)


def test_squared_agrees_with_mllib(points, data):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    models = {3: [data[0][1], data[1][1], data[2][1]]}
    mean = si.mean_silhouette(points, models).first()["sil"]
    frame = km.assign(points, models[3]).select(array_to_vector("x").alias("features"), F.col("cid").alias("prediction"))
    assert mean == pytest.approx(ClusteringEvaluator().evaluate(frame))


def test_singleton_scores_zero(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [9.0])], "id bigint, x array<double>")
    for metric in ("squared", "euclidean"):
        got = {r["id"]: r["sil"] for r in si.silhouette(df, {2: [[0.5], [9.0]]}, metric).collect()}
        assert got[3] == 0 and got[1] > 0
    with pytest.raises(ValueError):
        si.silhouette(df, {1: [[0.0]]}, "cosine")


def test_elbow_and_best(spark):
    def scores(*values):
        return spark.createDataFrame(list(zip(km.SWEEP, map(float, values))), "k int, sil double")

    assert km.elbow(scores(0, .5, .6, .4, .9, .9)).first()["k"] == 8
    assert km.elbow(scores(0, .5, .5, .4, .9, .9)).first()["k"] == 4
    assert km.elbow(scores(0, .1, .2, .3, .4, .5)).first()["k"] == 32
    assert tuple(km.best_k(scores(0, .5, .6, .6, .1, .2)).first()) == (4, .6)


def test_job_finds_the_blobs(points):
    job = KMeansJob()
    report = job.run(points)
    assert job.k == 3
    assert {r["reason"] for r in report.collect()} <= {"small cluster", "outside band"}


def test_anomaly_rules(spark):
    rows = [(i, [float(i % 5), 1.0 * (i % 5)], 0) for i in range(300)]
    rows += [(900, [40.0, 40.0], 0), (901, [-40.0, 2.0], 0), (902, [7.123, 7.987], 2)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, cid int")
    loose = {(r["id"], r["reason"]) for r in an.anomalies(df).collect()}
    assert loose == {(900, "outside band"), (901, "outside band"), (902, "small cluster")}
    strict = {(r["id"], r["reason"]): r["x"] for r in an.anomalies(df, "all_above").collect()}
    assert (900, "outside band") in strict and (901, "outside band") not in strict
    assert strict[902, "small cluster"] == [7.12, 7.99]
    with pytest.raises(ValueError):
        an.anomalies(df, "other")


def test_csv_points(spark, tmp_path):
    good, bad = tmp_path / "good.dat", tmp_path / "bad.dat"
    good.write_text("1,2.5\n3,4\n")
    bad.write_text("1,2.5\n,x\n")
    read = read_csv_points(spark, str(good))
    assert sorted(r["x"] for r in read.collect()) == [[1.0, 2.5], [3.0, 4.0]]
    with pytest.raises(ValueError, match="_c0_null.*_c1_text"):
        read_csv_points(spark, str(bad))
    assert bad_cells(spark.createDataFrame([("1",), ("a",), (None,)], "v string")).first().asDict() == {"v_null": 1, "v_text": 1}


def test_blocks_of_centroids(monkeypatch):
    from sparkloom.functions import distance

    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(50, 3)), rng.normal(size=(40, 3)).round(1)
    c[17] = c[5]  # a tie takes the lower index
    gaps = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
    monkeypatch.setattr(distance, "BLOCK_CELLS", 350)  # seven centroids at a time
    best, at = distance.closest(x, c)
    assert np.array_equal(at, gaps.argmin(axis=1)) and np.allclose(best, gaps.min(axis=1))
    total, near = distance.totals(x, c, np.zeros(50), np.full(50, np.inf))
    assert np.allclose(total, gaps.sum(axis=1)) and np.allclose(near, gaps.min(axis=1))


def test_a_saved_model_predicts_alike(spark, points, tmp_path):
    job = km.KMeansJob()
    job.centroids = km.fit(points, 3)
    for _ in range(2):  # a second save takes the place of the first
        job.save(spark, str(tmp_path / "model"))
    again = km.KMeansJob.load(spark, str(tmp_path / "model"))
    assert again.k == 3 and np.array_equal(again.centroids, job.centroids)
    assert sorted(again.predict(points).collect()) == sorted(km.assign(points, job.centroids).collect())


def test_closest_index_is_that_of_measured_distances():
    rng = np.random.default_rng(3)
    model = rng.normal(size=(7, 5)) + 1e6
    between = (model[0] + model[1]) / 2 + rng.normal(size=(50, 5)) * 1e-9
    x = np.concatenate([rng.normal(size=(500, 5)) + 1e6, model, between])
    assert distance.closest_index(x, model).tolist() == distance.closest(x, model)[1].tolist()
    count, total = distance.cluster_sums(x, np.arange(len(x)) % 3, 4)
    assert count.tolist() == [186, 186, 185, 0] and np.allclose(total[1], x[1::3].sum(axis=0)) and not total[3].any()


def test_rounds_read_packed_vectors_once(points, monkeypatch):
    """A round is one job without a shuffle, whatever the number of models."""
    models = {2: [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]], 1: [[0.0, 0.0, 0.0]]}
    means = km._run_means(km._packed(points), models)
    assert "Exchange" not in means.parts._jdf.queryExecution().executedPlan().toString()
    few = {(r["run"], r["cid"]): r["c"] for r in means.collect()}
    monkeypatch.setattr(km, "COLLECTED_NUMBERS", 0)
    shuffled = km._run_means(km._packed(points), models)
    assert "Exchange" in shuffled.parts._jdf.queryExecution().executedPlan().toString()
    for r in shuffled.collect():
        assert r["c"] == pytest.approx(few[r["run"], r["cid"]], rel=1e-12)


def test_tile_distances_of_near_points_far_from_the_origin():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 6)) + 1e7
    b = np.concatenate([a[:10], a[10:20] + 1e-6, rng.normal(size=(20, 6)) + 1e7])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(si._distances(a, b), want, rtol=1e-9, atol=0)


def test_tiles_measure_a_pair_once(spark, monkeypatch):
    """Blocks follow the rows, and so do the rows that move: no more than rows times blocks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(i, 8, v.tolist(), i % 3) for i, v in enumerate(x)], "id int, run int, x array<double>, cid int")
    one = {r["id"]: r["sil"] for r in si.euclidean_silhouette(rows).collect()}
    monkeypatch.setattr(si, "TILE_NUMBERS", 80)
    many = {r["id"]: r["sil"] for r in si.euclidean_silhouette(rows).collect()}
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(0, 300, 37):
        means = [gaps[i, c::3].sum() / (100 - (c == i % 3)) for c in range(3)]
        a, b = means[i % 3], min(m for c, m in enumerate(means) if c != i % 3)
        assert one[i] == pytest.approx((b - a) / max(a, b), rel=1e-9) == pytest.approx(many[i], rel=1e-9)


def _plain_lloyd(x, c, tol=km.TOLERANCE):
    """States of rounds over all rows until none moves."""
    states = [c]
    while len(states) < 2 or np.abs(states[-1] - states[-2]).max() > tol * max(1.0, np.abs(states[-1]).max()):
        near = ((x[:, None] - states[-1]) ** 2).sum(axis=2).argmin(axis=1)
        states.append(np.array([x[near == k].mean(axis=0) if (near == k).any() else states[-1][k] for k in range(len(c))]))
    return states


def test_late_rounds_read_few_rows(spark, monkeypatch):
    """Points without clusters move for many rounds; most need no scan, and the states are those of plain rounds."""
    x = np.random.default_rng(8).normal(size=(4000, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(4)
    models = {k: np.vstack([x[: k - 1], [[1e3, 0.0, 0.0]]]) for k in (3, 6)}  # the last stays empty
    want = {k: _plain_lloyd(x, c) for k, c in models.items()}
    scans, run_means = [], km._run_means
    monkeypatch.setattr(km, "_run_means", lambda *a: scans.append(1) or run_means(*a))
    monkeypatch.setattr(km, "NARROW_NUMBERS", 2400)  # a fifth of the rows
    got = km.lloyd_runs(df, {k: c.tolist() for k, c in models.items()})
    assert len(scans) < max(map(len, want.values())) / 2
    for k, states in want.items():
        assert np.allclose(got[k], states[-1], rtol=0, atol=1e-9)
    with pytest.raises(RuntimeError, match="still move"):
        km.lloyd_runs(df, {6: models[6].tolist()}, rounds=len(want[6]) - 2)
    assert np.allclose(km.lloyd_runs(df, {6: models[6].tolist()}, rounds=len(want[6]) - 1)[6], want[6][-1])


def test_margins_are_safe():
    """A row keeps its centroid while none moves by half of its margin."""
    rng = np.random.default_rng(9)
    for offset in (0.0, 1e6):
        x, c = rng.normal(size=(3000, 5)) + offset, rng.normal(size=(7, 5)) + offset
        at, margin = distance.closest_margin(x, c)
        gaps = np.sort(np.sqrt(((x[:, None] - c) ** 2).sum(axis=2)), axis=1)
        assert (margin <= gaps[:, 1] - gaps[:, 0]).all() and (margin > 0).mean() > 0.5
        step = rng.normal(size=c.shape)
        step *= 0.05 / np.sqrt((step**2).sum(axis=1, keepdims=True))
        kept = margin > 0.1
        assert kept.any() and (distance.closest_index(x, c + step)[kept] == at[kept]).all()


def test_mean_scores_do_not_repeat_vectors(points, data, monkeypatch):
    """Models are compared in the same two scans; no row per point and model is made."""
    models = {3: [data[0][1], data[1][1], data[2][1]], 1: [[0.0, 0.0, 0.0]], 4: [data[0][1], data[1][1], data[2][1], [50.0, 50.0, 50.0]]}
    monkeypatch.setattr(si, "assign_runs", None)
    got = {r["k"]: r["sil"] for r in si.mean_silhouette(points, models).collect()}
    x = np.array([p for _, p in data])
    for k, c in models.items():
        labels = ((x[:, None] - np.array(c)) ** 2).sum(axis=2).argmin(axis=1)
        assert got.pop(k) == pytest.approx(_silhouettes(data, labels, "squared").mean(), abs=1e-12)
    assert not got
