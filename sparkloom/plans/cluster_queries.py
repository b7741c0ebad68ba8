"""Clustering queries over embeddings and line items, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import anomalies as an
from sparkloom.operators import kmeans as km
from sparkloom.operators import silhouette as si
from sparkloom.plans.inputs import (
    EMBEDDING_SQL, EVENT_POINTS_SQL, LINE_POINTS_SQL, LINE_WIDTH, embedding_points, event_points, line_points,
)
from sparkloom.sources.points import bad_cells
from sparkloom.sources.tables import table

SEED, K = 42, 8


def _long(df, column: str, *keys: str):
    """Vector column as rows (keys, pos, value)."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def validate(spark, root):
    lines = table(spark, root, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return bad_cells(lines)


def seeds(spark, root):
    rows = km.far_point_seeds(km.stored_points(embedding_points(spark, root)), K, SEED)
    frame = spark.createDataFrame(list(enumerate(rows)), "seed bigint, x array<double>")
    return _long(frame, "x", "seed")


def _seeded_lines(spark, root):
    """Line points assigned to their far-point seeds."""
    points = km.stored_points(line_points(spark, root))
    return km.assign(points, km.far_point_seeds(points, K, SEED))


def assign_lines(spark, root):
    assigned = _seeded_lines(spark, root)
    return assigned.select("id", F.col("cid").cast("bigint").alias("cid"), F.round("dist", 9).alias("dist"))


def update_lines(spark, root):
    assigned = _seeded_lines(spark, root)
    return _long(km.cluster_means(assigned, LINE_WIDTH).withColumn("cid", F.col("cid").cast("bigint")), "c", "cid")


def lloyd(spark, root):
    centroids = km.fit(embedding_points(spark, root), K, seed=SEED)
    frame = spark.createDataFrame(list(enumerate(centroids)), "cid bigint, c array<double>")
    return _long(frame, "c", "cid")


def lloyd_lines(spark, root):
    centroids = km.fit(line_points(spark, root), K, seed=SEED)
    frame = spark.createDataFrame(list(enumerate(centroids)), "cid bigint, c array<double>")
    return _long(frame, "c", "cid")


def _fitted(spark, root):
    points = embedding_points(spark, root)
    return km.assign(points, km.fit(points, K, seed=SEED)).withColumn("cid", F.col("cid").cast("int"))


def _silhouette(metric):
    def run(spark, root):
        points = embedding_points(spark, root)
        models = {K: km.fit(points, K, seed=SEED)}
        return si.silhouette(points, models, metric).select(
            "id", F.col("cid").cast("bigint").alias("cid"), F.round("sil", 6).alias("sil"))
    return run


def bands(spark, root):
    rows = an.bands(_fitted(spark, root)).withColumn("cid", F.col("cid").cast("bigint"))
    both = rows.select("cid", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "b"))
    return both.select("cid", F.col("pos").cast("bigint").alias("pos"),
                       F.round("b.lo", 6).alias("lo"), F.round("b.hi", 6).alias("hi"))


def _anomalies(rule):
    def run(spark, root):
        rows = an.anomalies(_fitted(spark, root), rule).withColumn("cid", F.col("cid").cast("bigint"))
        return _long(rows, "x", "id", "cid", "reason")
    return run


def line_anomalies(spark, root):
    points = line_points(spark, root)
    rows = an.anomalies(km.assign(points, km.fit(points, K, seed=SEED)), "any")
    return _long(rows.withColumn("cid", F.col("cid").cast("bigint")), "x", "id", "cid", "reason")


def value_anomalies(spark, root):
    """Event values as one cluster of one-dimensional points, strict rule."""
    points = event_points(spark, root)
    rows = an.anomalies(km.assign(points, km.fit(points, 1, seed=SEED)), "all_above")
    return _long(rows.withColumn("cid", F.col("cid").cast("bigint")), "x", "id", "cid", "reason")


def sizes(spark, root):
    return km.cluster_sizes(_fitted(spark, root)).select(F.col("cid").cast("bigint").alias("cid"), "n")


def select_k(spark, root):
    return km.select_k(embedding_points(spark, root), seed=SEED).select(
        "phase", F.col("k").cast("bigint").alias("k"), F.round("sil", 6).alias("sil"))


def best_k(spark, root):
    scores = km.select_k(embedding_points(spark, root), seed=SEED)
    return km.best_k(scores.where(F.col("phase") == "refine")).select(
        F.col("k").cast("bigint").alias("k"), F.round("sil", 6).alias("sil"))


QUERIES = {
    "km_validate": validate,
    "km_seed": seeds,
    "km_assign": assign_lines,
    "km_update": update_lines,
    "km_lloyd": lloyd,
    "km_lloyd_lines": lloyd_lines,
    "km_cluster_sizes": sizes,
    "km_silhouette": _silhouette("squared"),
    "km_silhouette_euclidean": _silhouette("euclidean"),
    "km_select_k": select_k,
    "km_best_k": best_k,
    "km_bands": bands,
    "km_anomalies": _anomalies("any"),
    "km_anomalies_all_above": value_anomalies,
    "km_line_anomalies": line_anomalies,
}

# --- SQL -------------------------------------------------------------------


def _seed_walk(source: str, k: int) -> str:
    """Every row carries its distance sum; each step adds the distance to the newest seed."""
    pick = "first_value(x) OVER (ORDER BY near > 0 DESC, total DESC, id) AS nx"
    return f"""{source},
    origin AS MATERIALIZED (SELECT x AS x0 FROM pts ORDER BY md5('{SEED}:' || id), id LIMIT 1),
    walk AS (
      SELECT 1 AS step, id, x, total, near, {pick} FROM (
        SELECT id, x, list_distance(x, x0) AS total, list_distance(x, x0) AS near FROM pts, origin)
      UNION ALL
      SELECT *, {pick} FROM (
        SELECT step + 1 AS step, id, x, total + list_distance(x, nx) AS total,
               least(near, list_distance(x, nx)) AS near FROM walk WHERE step < {k - 1})),
    seeds AS MATERIALIZED (
      SELECT 0 AS seed, x0 AS x FROM origin
      UNION ALL SELECT step, any_value(nx) FROM walk GROUP BY step)"""


def _assigned(prefix: str, centroids: str) -> str:
    """CTE <prefix>_fit: every point with its nearest centroid, for all k."""
    return (f"{prefix}_fit AS MATERIALIZED (SELECT k, id, x, b.c AS cid, b.d AS dist FROM ("
            f"SELECT k, id, any_value(x) AS x, min({{'d': list_distance(x, c), 'c': cid}}) AS b "
            f"FROM pts, {centroids} GROUP BY k, id))")


def _seeded(prefix: str) -> str:
    return f"{prefix}_c AS (SELECT k, seed AS cid, x AS c FROM one JOIN seeds ON seed < k), {_assigned(prefix, f'{prefix}_c')}"


def _means(relation: str) -> str:
    return (f"SELECT k, cid, list(v ORDER BY pos) AS c FROM (SELECT k, cid, pos, avg(v) AS v FROM ("
            f"SELECT k, cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM {relation}) "
            f"GROUP BY k, cid, pos) GROUP BY k, cid")


def _converged(prefix: str, ks: str) -> str:
    """Rounds for all k of ``ks`` until no model moves: centroids <prefix>_c and assignment <prefix>_fit."""
    near = (f"SELECT k, x, b.c AS cid FROM (SELECT k, id, any_value(x) AS x, "
            f"min({{'d': list_distance(x, c), 'c': cid}}) AS b FROM pts, (SELECT * FROM {prefix}_walk WHERE moved) GROUP BY k, id)")
    return f"""{prefix}_walk AS (
      SELECT 0 AS round, k, seed AS cid, x AS c, true AS moved FROM {ks} JOIN seeds ON seed < k
      UNION ALL
      SELECT round + 1, k, cid, c, max(shift) OVER (PARTITION BY k)
             > {km.TOLERANCE} * greatest(1, max(top) OVER (PARTITION BY k)) AS moved FROM (
        SELECT *, list_max(list_transform(range(1, len(c) + 1), lambda i: abs(c[i] - old[i]))) AS shift,
               list_max(list_transform(c, lambda v: abs(v))) AS top FROM (
          SELECT o.round, o.k, o.cid, o.c AS old, coalesce(m.c, o.c) AS c
          FROM (SELECT * FROM {prefix}_walk WHERE moved) o
          LEFT JOIN ({_means(f'({near})')}) m ON m.k = o.k AND m.cid = o.cid))),
    {prefix}_c AS MATERIALIZED (SELECT k, cid, arg_max(c, round) AS c FROM {prefix}_walk GROUP BY k, cid),
    {_assigned(prefix, f'{prefix}_c')}"""


def _sil(prefix: str, squared: bool) -> str:
    """CTE <prefix>_sil(k, id, cid, sil) by brute force over all pairs."""
    gap = "pow(list_distance(a.x, b.x), 2)" if squared else "list_distance(a.x, b.x)"
    return f"""{prefix}_gap AS MATERIALIZED (SELECT a.id, b.id AS other_id, {gap} AS g FROM pts a, pts b),
    {prefix}_sum AS (SELECT f.k, f.id, f.cid, o.cid AS oc, sum(g) AS t, count(*) AS n
      FROM {prefix}_fit f JOIN {prefix}_gap g ON g.id = f.id JOIN {prefix}_fit o ON o.id = g.other_id AND o.k = f.k
      GROUP BY ALL),
    {prefix}_ab AS (SELECT k, id, cid, max(CASE WHEN oc = cid THEN n END) AS n,
      max(CASE WHEN oc = cid THEN t END) AS t, min(CASE WHEN oc <> cid THEN t / n END) AS b
      FROM {prefix}_sum GROUP BY ALL),
    {prefix}_sil AS MATERIALIZED (SELECT k, id, cid, CASE WHEN n > 1 AND b IS NOT NULL THEN
      (b - t / (n - 1)) / greatest(b, t / (n - 1)) ELSE 0 END AS sil FROM {prefix}_ab)"""


def _posed(relation: str, keys: str, vector: str) -> str:
    return (f"SELECT {keys}, pos - 1 AS pos, round(value, 6) AS value FROM (SELECT {keys}, "
            f"unnest({vector}) AS value, generate_subscripts({vector}, 1) AS pos FROM {relation})")


_ONE = f"one AS (SELECT {K} AS k)"
_EMB = f"WITH RECURSIVE {_seed_walk(EMBEDDING_SQL, K)}, {_ONE}, {_converged('r', 'one')}"
_LINE = f"WITH RECURSIVE {_seed_walk(LINE_POINTS_SQL, K)}, {_ONE}, {_converged('r', 'one')}"
_EVENT = f"WITH RECURSIVE {_seed_walk(EVENT_POINTS_SQL, 2)}, one AS (SELECT 1 AS k), {_converged('r', 'one')}"
_LINE0 = f"WITH RECURSIVE {_seed_walk(LINE_POINTS_SQL, K)}, {_ONE}, {_seeded('r')}"

_BANDS = """feats AS (SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM r_fit),
    bands AS MATERIALIZED (SELECT cid, pos, avg(v) - 2 * stddev_pop(v) AS lo, avg(v) + 2 * stddev_pop(v) AS hi
      FROM feats GROUP BY cid, pos),
    sizes AS (SELECT cid, count(*) AS n FROM r_fit GROUP BY cid),
    tests AS (SELECT f.id, count(*) FILTER (v > hi OR v < lo) AS out, count(*) FILTER (v >= hi) AS above, count(*) AS d
      FROM (SELECT id, cid, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM r_fit) f
      JOIN bands USING (cid, pos) GROUP BY f.id),
    hits AS (SELECT id, cid, 'small cluster' AS reason, x FROM r_fit JOIN sizes USING (cid)
        WHERE n = 1 OR n < CAST(floor(0.01 * (SELECT count(*) FROM pts)) AS BIGINT)
      UNION ALL SELECT id, cid, 'outside band', x FROM r_fit JOIN tests USING (id) WHERE {rule})"""


def _anomaly_sql(base: str, rule: str) -> str:
    return (f"{base}, {_BANDS.format(rule=rule)} SELECT id, cid, reason, pos - 1 AS pos, round(value, 2) AS value FROM "
            "(SELECT id, cid, reason, unnest(x) AS value, generate_subscripts(x, 1) AS pos FROM hits)")


_SWEEP_LIST = ", ".join(f"({k})" for k in km.SWEEP)
_SELECT = f"""WITH RECURSIVE {_seed_walk(EMBEDDING_SQL, max(km.SWEEP))},
    ks(k) AS (VALUES {_SWEEP_LIST}),
    {_converged('r', 'ks')}, {_sil('r', True)},
    coarse AS MATERIALIZED (SELECT k, avg(sil) AS sil FROM r_sil GROUP BY k),
    ahead AS (SELECT *, lead(k) OVER (ORDER BY k) AS next_k, lead(sil) OVER (ORDER BY k) AS next_sil FROM coarse),
    top AS MATERIALIZED (SELECT coalesce((SELECT next_k FROM ahead WHERE k > 1 AND next_sil <= sil ORDER BY k LIMIT 1),
        (SELECT max(k) FROM coarse)) AS k),
    fine_ks AS MATERIALIZED (SELECT unnest(range(greatest(k // 4, 1), k + 1)) AS k FROM top),
    {_converged('f', 'fine_ks')}, {_sil('f', True)},
    fine AS MATERIALIZED (SELECT k, avg(sil) AS sil FROM f_sil GROUP BY k)"""

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")

SQL = {
    "km_validate": "SELECT " + ", ".join(
        f"count(*) FILTER ({c} IS NULL) AS {c}_null, "
        f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS {c}_text"
        for c in _NUMBERS) + " FROM lineitem",
    "km_seed": f"WITH RECURSIVE {_seed_walk(EMBEDDING_SQL, K)} {_posed('seeds', 'seed', 'x')}",
    "km_assign": f"{_LINE0} SELECT id, cid, round(dist, 9) AS dist FROM r_fit",
    "km_update": f"{_LINE0}, r_m AS ({_means('r_fit')}) {_posed('r_m', 'cid', 'c')}",
    "km_lloyd": f"{_EMB} {_posed('r_c', 'cid', 'c')}",
    "km_lloyd_lines": f"{_LINE} {_posed('r_c', 'cid', 'c')}",
    "km_cluster_sizes": f"{_EMB} SELECT cid, count(*) AS n FROM r_fit GROUP BY cid",
    "km_silhouette": f"{_EMB}, {_sil('r', True)} SELECT id, cid, round(sil, 6) AS sil FROM r_sil",
    "km_silhouette_euclidean": f"{_EMB}, {_sil('r', False)} SELECT id, cid, round(sil, 6) AS sil FROM r_sil",
    "km_select_k": f"""{_SELECT} SELECT 'sweep' AS phase, k, round(sil, 6) AS sil FROM coarse
        UNION ALL SELECT 'refine', k, round(sil, 6) FROM fine""",
    "km_best_k": f"{_SELECT} SELECT k, round(sil, 6) AS sil FROM fine ORDER BY fine.sil DESC, k LIMIT 1",
    "km_bands": f"{_EMB}, {_BANDS.format(rule='out > 0')} SELECT cid, pos - 1 AS pos, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bands",
    "km_anomalies": _anomaly_sql(_EMB, "out > 0"),
    "km_anomalies_all_above": _anomaly_sql(_EVENT, "above = d"),
    "km_line_anomalies": _anomaly_sql(_LINE, "out > 0"),
}
