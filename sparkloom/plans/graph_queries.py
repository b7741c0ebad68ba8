"""Graph and experiment queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.times import epoch_micros
from sparkloom.functions.uniform import uniform_sql
from sparkloom.operators import experiments as ex
from sparkloom.operators import graph as gr
from sparkloom.operators.forest import components, largest_component
from sparkloom.plans.inputs import TRADE_SQL, trade_edges
from sparkloom.sources.tables import table

SEED = 42
TRAIN, VALID = 0.8, 0.1
FANOUTS = (4, 4, 4)
BATCH = 1024
TAPS = (0.5, 0.25, 0.125, 0.0625, 0.03125)
HOPS, STEPS, SMOOTHING = (6, 8), 25, 3
WIDTH = 2
W_SELF = ((0.5, -0.25), (0.125, 0.75), (-0.5, 0.5))
W_NEIGH = ((0.25, 0.5), (-0.75, 0.375), (0.5, -0.125))
BIAS = (0.01, -0.02, 0.03)


def node_features(spark, root):
    """(node, x): two numbers for every part (even) and supplier (odd).

    Scales are powers of two, so that sums of features are exact in every engine.
    """
    part = table(spark, root, "part").select(
        (F.col("p_partkey") * 2).alias("node"),
        F.array(F.col("p_size") / 64.0, F.floor("p_retailprice") / 2048.0).alias("x"))
    supplier = table(spark, root, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("node"),
        F.array(F.col("s_nationkey") / 32.0, F.floor("s_acctbal") / 16384.0).alias("x"))
    return part.union(supplier)


def part_labels(spark, root):
    nodes = table(spark, root, "part").select(
        (F.col("p_partkey") * 2).alias("node"), F.col("p_type").alias("label"))
    return gr.split(nodes, TRAIN, VALID, SEED)


def dataset_stats(spark, root):
    return gr.dataset_stats(trade_edges(spark, root), node_features(spark, root), part_labels(spark, root))


def minibatch(spark, root):
    return gr.minibatches(part_labels(spark, root).select("node"), BATCH, SEED)


def neighbour_sample(spark, root):
    seeds = part_labels(spark, root).where(F.col("split") == "train")
    return gr.sample_neighbours(trade_edges(spark, root), seeds, FANOUTS, SEED)


def _long(df, column="x"):
    return df.select("node", F.posexplode(column).alias("pos", "value")).select(
        "node", F.col("pos").cast("bigint").alias("pos"), F.round("value", 9).alias("value"))


def mean_agg(spark, root):
    return _long(gr.mean_neighbours(trade_edges(spark, root), node_features(spark, root), WIDTH), "m")


def sage(spark, root):
    return _long(gr.sage_layer(trade_edges(spark, root), node_features(spark, root), W_SELF, W_NEIGH, BIAS))


def _degree(spark, root):
    return gr.degree(trade_edges(spark, root))


def sources(spark, root):
    """The busiest supplier of each region."""
    nation = table(spark, root, "nation")
    community = table(spark, root, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (F.col("s_suppkey") * 2 + 1).alias("node"), F.col("n_regionkey").cast("bigint").alias("community"))
    return gr.source_nodes(_degree(spark, root), community)


def fuse(spark, root):
    """One directed part → supplier layer per order priority, fused and made undirected."""
    orders = table(spark, root, "orders")
    lines = table(spark, root, "lineitem")
    layers = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "o_orderpriority", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    return gr.fuse_edges(layers.select(
        (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "w"))


def _scaled(spark, root, method="lanczos"):
    return gr.scaled_edges(trade_edges(spark, root), seed=SEED, method=method)


def _rounded(df, column="w", digits=6):
    return df.withColumn(column, F.round(column, digits))


def _signal(spark, root):
    return node_features(spark, root).select(
        F.lit(0).cast("bigint").alias("sample"), "node", F.col("x")[0].alias("value"))


def _diffused(spark, root, steps=len(TAPS)):
    return gr.diffuse(_scaled(spark, root), _signal(spark, root), steps)


def shift(spark, root):
    wide = gr.shift_features(_diffused(spark, root), len(TAPS))
    return wide.select("node", *[F.round(f"s{k}", 6).alias(f"s{k}") for k in range(len(TAPS))])


def source_data_set(spark, root):
    # nine digits are kept, so the radius is found by the same iteration as in the SQL
    rows = gr.source_data_set(_scaled(spark, root, "power"), sources(spark, root), STEPS, TRAIN, VALID, SEED)
    return _rounded(rows, "value", 9)


def local_max(spark, root):
    """Maxima over both distances; the longer walk goes on from the shorter one."""
    edges = gr.SaltedEdges.of(trade_edges(spark, root), ["src", "dst"], "src", "dst")
    near = gr.local_max(edges, _signal(spark, root), HOPS[0])
    far = gr.local_max(edges, near, HOPS[1] - HOPS[0])
    hops = [F.lit(h).cast("bigint").alias("hops") for h in HOPS]
    return near.select(hops[0], "node", "value").union(far.select(hops[1], "node", "value"))


def page_links(spark, root):
    """Pages and the targets they link to, as an undirected graph of names."""
    target = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h")
    return table(spark, root, "pages").select("page_id", target).select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("u"), F.concat(F.lit("h"), "h").alias("v")
    ).distinct()


def page_names(spark, root):
    """Node names of all pages, also of those without a link."""
    return table(spark, root, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("node"))


def page_components(spark, root, isolated: bool = False):
    """Components of pages and link targets. Their SQL knows linked nodes only; ``isolated`` adds pages without a link."""
    return components(page_links(spark, root), nodes=page_names(spark, root) if isolated else None)


def smoothed(spark, root):
    return _long(gr.smoothed_features(trade_edges(spark, root), node_features(spark, root), WIDTH, SMOOTHING))


def label_accuracy(spark, root):
    rows = table(spark, root, "labels").select(F.col("quality").alias("prediction"), F.col("toxic").alias("label"))
    return gr.accuracy(rows).select(F.round("accuracy", 6).alias("accuracy"), F.round("error_rate", 6).alias("error_rate"))


def best_epoch(spark, root):
    """Hours as epochs, share of events that are not errors as accuracy."""
    events = table(spark, root, "events")
    hours = events.select(F.floor(epoch_micros(events, "ts") / 3600000000).alias("epoch"), "event_type")
    scores = hours.groupBy("epoch").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("acc"))
    return gr.best_epoch(scores).select("epoch", F.round("acc", 6).alias("acc"))


def sgc(spark, root):
    return gr.classify_nodes(trade_edges(spark, root), node_features(spark, root), part_labels(spark, root), WIDTH)


def results(spark, root):
    return table(spark, root, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 10).alias("graph"),
        (F.col("event_id") % 10).alias("realization"), F.floor(F.col("event_id") / 100).alias("step"),
        "event_id", "value")


def run_model(spark, root):
    rows = results(spark, root)
    name = F.concat("model", F.lit("G"), F.lpad(F.col("graph").cast("string"), 2, "0"),
                    F.lit("R"), F.lpad(F.col("realization").cast("string"), 2, "0"))
    return ex.run_models(rows.select(name.alias("run")).distinct(), rows.select("model").distinct())


def _stats(df, *keys):
    return df.select(*keys, F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


QUERIES = {
    "gr_dataset_stats": dataset_stats,
    "gr_split": part_labels,
    "gr_minibatch": minibatch,
    "gr_neighbor_sample": neighbour_sample,
    "gr_mean_agg": mean_agg,
    "gr_sage_layer": sage,
    "gr_degree": lambda s, d: _degree(s, d),
    "gr_top_degree": lambda s, d: gr.top_nodes(_degree(s, d), 10),
    "gr_source_nodes": sources,
    "gr_fuse_edges": lambda s, d: _rounded(fuse(s, d)),
    "gr_spectral_scale": lambda s, d: _rounded(gr.spectral_scale(trade_edges(s, d), seed=SEED), digits=9),
    "gr_laplacian": lambda s, d: _rounded(gr.rescaled_laplacian(trade_edges(s, d), seed=SEED), digits=9),
    "gr_diffuse": lambda s, d: _rounded(_diffused(s, d, STEPS).drop("sample"), "value"),
    "gr_shift_features": shift,
    "gr_filter": lambda s, d: _rounded(gr.filtered(_diffused(s, d), TAPS).drop("sample"), "value"),
    "gr_source_dataset": source_data_set,
    "gr_local_max": local_max,
    "gr_components": lambda s, d: page_components(s, d),
    "gr_largest_component": lambda s, d: largest_component(page_links(s, d)),
    "gr_sgc_features": smoothed,
    "gr_accuracy": label_accuracy,
    "gr_best_epoch": best_epoch,
    "gr_sgc_predict": sgc,
    "exp_run_model": run_model,
    "exp_summary": lambda s, d: _stats(ex.summary(results(s, d), ("step", "event_id")), "model", "metric"),
    "exp_curves": lambda s, d: _stats(ex.curves(results(s, d)), "model", "step"),
    "exp_curve_ticks": lambda s, d: _stats(ex.curves(results(s, d), every=10), "model", "step"),
}

# --- SQL -------------------------------------------------------------------

_SPLIT_U = uniform_sql(SEED, "node", "'split'")


def _split_case(u: str) -> str:
    return f"CASE WHEN {u} < {TRAIN} THEN 'train' WHEN {u} < {TRAIN + VALID} THEN 'valid' ELSE 'test' END"


_FEATURES = """features AS MATERIALIZED (
  SELECT p_partkey * 2 AS node, p_size / 64.0::DOUBLE AS x0, floor(p_retailprice) / 2048.0::DOUBLE AS x1 FROM part
  UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey / 32.0::DOUBLE, floor(s_acctbal) / 16384.0::DOUBLE FROM supplier)"""
_PARTS = f"""parts AS MATERIALIZED (SELECT node, label, {_split_case(_SPLIT_U)} AS split
  FROM (SELECT p_partkey * 2 AS node, p_type AS label FROM part))"""
_MEANS = """means AS MATERIALIZED (SELECT f.node, f.x0, f.x1, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1 FROM features f
  LEFT JOIN (SELECT dst AS node, avg(x0) AS m0, avg(x1) AS m1 FROM edges JOIN features ON node = src GROUP BY dst) USING (node))"""
_DEGREE = "degrees AS MATERIALIZED (SELECT src AS node, sum(w) AS degree, count(*) AS n FROM edges GROUP BY src)"
_SOURCES = f"""{_DEGREE}, sources AS MATERIALIZED (SELECT community, node, degree FROM (
  SELECT n_regionkey::BIGINT AS community, node, degree,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY degree DESC, node) AS rn
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN degrees ON node = s_suppkey * 2 + 1) WHERE rn = 1)"""


def _power(edges: str, name: str) -> str:
    """CTE ``name``(radius): a unit vector is multiplied until its length stands still."""
    u = uniform_sql(SEED, "node", "'power'")
    length = "sqrt(sum(value * value) OVER ())"
    return f"""{name}_walk AS (
      SELECT 0 AS round, node, value, NULL::DOUBLE AS before, {length} AS norm
      FROM (SELECT node, {u} - 0.5 AS value FROM (SELECT DISTINCT src AS node FROM {edges}))
      UNION ALL
      SELECT round, node, value, before, {length} AS norm FROM (
        SELECT p.round + 1 AS round, e.dst AS node, sum(p.value * e.w / p.norm) AS value, any_value(p.norm) AS before
        FROM {edges} e JOIN {name}_walk p ON p.node = e.src
        WHERE p.before IS NULL OR abs(p.norm - p.before) > {gr.POWER_TOLERANCE} * p.norm GROUP BY p.round, e.dst)),
    {name} AS MATERIALIZED (SELECT arg_max(norm, round) AS radius FROM {name}_walk)"""


_SCALED = f"WITH RECURSIVE {TRADE_SQL}, {_power('edges', 'pw')}, scaled AS MATERIALIZED (SELECT src, dst, w / radius AS w FROM edges, pw)"


def _steps(start: str, steps: int) -> str:
    """CTEs z0 … and ``diffused``(sample, t, node, value)."""
    ctes = [f"z0 AS MATERIALIZED ({start})"]
    for t in range(1, steps):
        ctes.append(f"z{t} AS MATERIALIZED (SELECT sample, dst AS node, sum(value * w) AS value "
                    f"FROM z{t - 1} JOIN scaled ON src = node GROUP BY sample, dst)")
    every = " UNION ALL ".join(f"SELECT sample, {t}::BIGINT AS t, node, value FROM z{t}" for t in range(steps))
    return ", ".join(ctes) + f", diffused AS ({every})"


_SIGNAL = "SELECT 0 AS sample, node, x0 AS value FROM features"
_DIFFUSED = f"{_SCALED}, {_FEATURES}, {_steps(_SIGNAL, len(TAPS))}"
_TAP_CASE = "CASE t " + " ".join(f"WHEN {k} THEN {h}" for k, h in enumerate(TAPS)) + " END"


def _layer_sql(i: int) -> str:
    terms = " + ".join([f"x0 * {W_SELF[i][0]}", f"x1 * {W_SELF[i][1]}", f"m0 * {W_NEIGH[i][0]}", f"m1 * {W_NEIGH[i][1]}"])
    return f"SELECT node, {i}::BIGINT AS pos, round(greatest({terms} + {BIAS[i]}, 0)::DOUBLE, 9) AS value FROM means"


def _sample_sql() -> str:
    ctes = ["f0 AS MATERIALIZED (SELECT node FROM parts WHERE split = 'train')"]
    for i, fanout in enumerate(FANOUTS):
        ctes.append(f"layer{i} AS MATERIALIZED (SELECT dst, src FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst "
                    f"ORDER BY md5('{SEED}:{i}:' || dst || ':' || src), src) AS rn FROM edges JOIN f{i} ON node = dst) WHERE rn <= {fanout})")
        ctes.append(f"f{i + 1} AS MATERIALIZED (SELECT node FROM f{i} UNION SELECT src FROM layer{i})")
    every = " UNION ALL ".join(f"SELECT {i}::BIGINT AS layer, dst, src FROM layer{i}" for i in range(len(FANOUTS)))
    return f"WITH {TRADE_SQL}, {_PARTS}, {', '.join(ctes)} {every}"


def _hops_sql() -> str:
    ctes = ["h0 AS MATERIALIZED (SELECT node, x0 AS value FROM features)"]
    for i in range(max(HOPS)):
        ctes.append(f"h{i + 1} AS MATERIALIZED (SELECT node, max(value) AS value FROM (SELECT * FROM h{i} "
                    f"UNION ALL SELECT dst, value FROM edges JOIN h{i} ON node = src) GROUP BY node)")
    every = " UNION ALL ".join(f"SELECT {h}::BIGINT AS hops, node, value FROM h{h}" for h in HOPS)
    return f"WITH {TRADE_SQL}, {_FEATURES}, {', '.join(ctes)} {every}"


def _smooth_sql() -> str:
    ctes = ["s0 AS MATERIALIZED (SELECT node, x0, x1 FROM features)"]
    for i in range(SMOOTHING):
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT s{i}.node, coalesce(m0, 0) AS x0, coalesce(m1, 0) AS x1 FROM s{i} LEFT JOIN ("
                    f"SELECT dst AS node, avg(x0) AS m0, avg(x1) AS m1 FROM edges JOIN s{i} ON node = src GROUP BY dst) USING (node))")
    return (f"WITH {TRADE_SQL}, {_FEATURES}, {', '.join(ctes)} SELECT node, 0::BIGINT AS pos, round(x0, 9) AS value "
            f"FROM s{SMOOTHING} UNION ALL SELECT node, 1, round(x1, 9) FROM s{SMOOTHING}")


_RESULTS = """results AS MATERIALIZED (SELECT event_type AS model, user_id % 10 AS graph, event_id % 10 AS realization,
  event_id // 100 AS step, event_id, value FROM events)"""
_CURVES = """SELECT model, step, round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std FROM (
  SELECT model, step, graph, avg(value) AS m FROM results {where} GROUP BY ALL) GROUP BY model, step"""

_COMPONENTS = """WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT 'p' || page_id AS u,
        'h' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS v FROM pages),
        both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT DISTINCT u AS node, u AS spot FROM both_ways
                  UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON e.u = r.spot),
        parts_of AS MATERIALIZED (SELECT node, min(spot) AS component FROM reach GROUP BY node)"""

SQL = {
    "gr_dataset_stats": f"""WITH {TRADE_SQL}, {_PARTS} SELECT count(*) AS n_nodes, count(DISTINCT label) AS n_classes,
        count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'valid') AS n_valid,
        count(*) FILTER (split = 'test') AS n_test, {WIDTH}::BIGINT AS n_features,
        (SELECT count(*) FROM edges) AS n_edges FROM parts""",
    "gr_split": f"WITH {_PARTS} SELECT node, label, split FROM parts",
    "gr_minibatch": f"""WITH {_PARTS} SELECT node, (row_number() OVER (ORDER BY md5('{SEED}:' || node || ':batch'), node) - 1)
        // {BATCH} AS batch FROM parts""",
    "gr_neighbor_sample": _sample_sql(),
    "gr_mean_agg": f"""WITH {TRADE_SQL}, {_FEATURES}, {_MEANS} SELECT node, 0::BIGINT AS pos, round(m0, 9) AS value FROM means
        UNION ALL SELECT node, 1, round(m1, 9) FROM means""",
    "gr_sage_layer": f"WITH {TRADE_SQL}, {_FEATURES}, {_MEANS} " + " UNION ALL ".join(_layer_sql(i) for i in range(len(BIAS))),
    "gr_degree": f"WITH {TRADE_SQL}, {_DEGREE} SELECT node, degree, n FROM degrees",
    "gr_top_degree": f"WITH {TRADE_SQL}, {_DEGREE} SELECT node, degree, n FROM degrees ORDER BY degree DESC, node LIMIT 10",
    "gr_source_nodes": f"WITH {TRADE_SQL}, {_SOURCES} SELECT * FROM sources",
    "gr_fuse_edges": """WITH layers AS (SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, sum(l_quantity) AS w
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, l_partkey, l_suppkey)
        SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, w / 2 AS w FROM layers
        UNION ALL SELECT dst, src, w / 2 FROM layers) GROUP BY src, dst""",
    "gr_spectral_scale": f"{_SCALED} SELECT src, dst, round(w, 9) AS w FROM scaled",
    "gr_laplacian": f"""WITH RECURSIVE {TRADE_SQL}, {_DEGREE}, lap AS MATERIALIZED (
        SELECT src, dst, -w / sqrt(a.degree * b.degree) AS w FROM edges JOIN degrees a ON a.node = src JOIN degrees b ON b.node = dst
        UNION ALL SELECT node, node, 1.0 FROM degrees), {_power('lap', 'pw')}
        SELECT src, dst, round(w * 2 / radius - CASE WHEN src = dst THEN 1 ELSE 0 END, 9) AS w FROM lap, pw""",
    "gr_diffuse": f"{_SCALED}, {_FEATURES}, {_steps(_SIGNAL, STEPS)} SELECT t, node, round(value, 6) AS value FROM diffused",
    "gr_shift_features": f"{_DIFFUSED} SELECT node, " + ", ".join(
        f"round(coalesce(sum(value) FILTER (t = {k}), 0), 6) AS s{k}" for k in range(len(TAPS))) + " FROM diffused GROUP BY node",
    "gr_filter": f"{_DIFFUSED} SELECT node, round(sum(value * {_TAP_CASE}), 6) AS value FROM diffused GROUP BY node",
    "gr_source_dataset": f"""{_SCALED}, {_SOURCES}, {_steps('SELECT node AS sample, node, 1.0::DOUBLE AS value FROM sources', STEPS)}
        SELECT sample AS label, t, {_split_case(uniform_sql(SEED, 'sample', 't', "'split'"))} AS split, node,
        round(value, 9) AS value FROM diffused""",
    "gr_local_max": _hops_sql(),
    "gr_components": f"{_COMPONENTS} SELECT node, component FROM parts_of",
    "gr_largest_component": f"""{_COMPONENTS} SELECT u, v FROM links JOIN parts_of ON node = u WHERE component = (
        SELECT component FROM parts_of GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""",
    "gr_sgc_features": _smooth_sql(),
    "gr_accuracy": """SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, round(1 - avg((quality = toxic)::INT), 6) AS error_rate
        FROM labels""",
    "gr_best_epoch": """SELECT epoch, round(acc, 6) AS acc FROM (SELECT epoch_us(ts) // 3600000000 AS epoch,
        avg((event_type <> 'error')::INT) AS acc FROM events GROUP BY 1) ORDER BY acc DESC, epoch LIMIT 1""",
    "exp_run_model": f"""WITH {_RESULTS}, runs AS (SELECT DISTINCT model || 'G' || lpad(graph::VARCHAR, 2, '0') || 'R' ||
        lpad(realization::VARCHAR, 2, '0') AS run FROM results), models AS (SELECT DISTINCT model FROM results)
        SELECT run, arg_max(model, {{'n': length(model), 'm': model}}) AS model FROM runs JOIN models ON contains(run, model)
        GROUP BY run""",
    "exp_summary": f"""WITH {_RESULTS}, ends AS (SELECT model, graph, realization, min(value) AS best,
        arg_max(value, {{'s': step, 'e': event_id}}) AS last FROM results GROUP BY ALL),
        per AS (SELECT model, 'best' AS metric, graph, avg(best) AS m FROM ends GROUP BY ALL
                UNION ALL SELECT model, 'last', graph, avg(last) FROM ends GROUP BY ALL)
        SELECT model, metric, round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std FROM per GROUP BY model, metric""",
    "exp_curves": f"WITH {_RESULTS} {_CURVES.format(where='')}",
    "exp_curve_ticks": f"WITH {_RESULTS} {_CURVES.format(where='WHERE step % 10 = 0')}",
}
