"""Network queries over orders, customers and line items, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.uniform import uniform_sql
from sparkloom.operators import factors as fx
from sparkloom.operators import sampling
from sparkloom.operators.bayes import BeliefNetwork
from sparkloom.operators.network import Network
from sparkloom.plans.inputs import (
    OBS_EDGES, OBS_SQL, WIDE_EDGES, WIDE_SQL, observations, wide_observations,
)
from sparkloom.streaming.counts import fit_stream
from sparkloom.sources.tables import table

SEED = 42
SPLIT_YEAR = 1998
DEAR, CHEAP = 350000, 100000


def _r(col: str = "p"):
    return F.round(F.col(col), 6).alias(col)


def _rounded(df, col: str = "p"):
    return df.select(*[c for c in df.columns if c != col], _r(col))


def _obs_net(spark, root) -> BeliefNetwork:
    return BeliefNetwork(*OBS_EDGES).fit(observations(spark, root))


def _wide_net(spark, root) -> BeliefNetwork:
    return BeliefNetwork(*WIDE_EDGES).fit(wide_observations(spark, root))


def flagship(spark, root):
    """P(order status | market segment BUILDING)."""
    return _rounded(_obs_net(spark, root).query("st", event={"seg": "BUILDING"}))


def _batches(spark, root):
    obs = observations(spark, root)
    return obs.where(F.col("year") < SPLIT_YEAR), obs.where(F.col("year") >= SPLIT_YEAR)


def partial_fit(spark, root):
    old, new = _batches(spark, root)
    return _rounded(BeliefNetwork(*OBS_EDGES).fit(old).partial_fit(new).tables())


def fit_prior(spark, root):
    net = BeliefNetwork(*OBS_EDGES, prior_count=1).fit(observations(spark, root))
    return _rounded(net.tables())


def partial_fit_stream(spark, root):
    """Counts merged batch by batch from a stream of order files."""
    segments = table(spark, root, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))

    def label(batch):
        return batch.join(segments, F.col("o_custkey") == F.col("c_custkey")).select(
            "seg", F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"))

    net = BeliefNetwork(*OBS_EDGES)
    counts = fit_stream(spark, f"{root}/orders.parquet", label, net)
    return _rounded(net.with_counts(counts).tables())


def cdf(spark, root):
    return _obs_net(spark, root).cdf("st").select("pri", "seg", "st", "lo", "hi", "total")


def factor_product(spark, root):
    net = _obs_net(spark, root)
    return _rounded(fx.product(net.cpt("st"), net.cpt("seg")).select("pri", "seg", "st", "p"))


def factor_cross(spark, root):
    net = _obs_net(spark, root)
    return _rounded(fx.product(net.cpt("pri"), net.cpt("seg")))


def sum_out(spark, root):
    net = _obs_net(spark, root)
    return _rounded(fx.sum_out(fx.product(net.cpt("st"), net.cpt("seg")), "seg"))


def full_joint(spark, root):
    return _rounded(_wide_net(spark, root).full_joint())


def query_joint2(spark, root):
    return _rounded(_wide_net(spark, root).query("rf", "pri", event={"ls": "O"}))


def predict_proba(spark, root):
    net = _obs_net(spark, root)
    rows = observations(spark, root).select("id", "pri", "seg", "st")
    return net.predict_proba(rows).select("id", _r())


def predict_log_proba(spark, root):
    net = _obs_net(spark, root)
    rows = observations(spark, root).select("id", "pri", "seg", "st")
    return net.predict_log_proba(rows).select("id", _r("log_p"))


def impute(spark, root):
    """Orders above or below a price lose their status or priority label."""
    net = _obs_net(spark, root)
    rows = observations(spark, root).select(
        "id", "seg",
        F.when(F.col("year") != SPLIT_YEAR, F.col("pri")).alias("pri"),
        F.when(F.col("price").between(CHEAP, DEAR), F.col("st")).alias("st"),
    )
    return net.impute(rows)


def sample(spark, root):
    return _obs_net(spark, root).sample(observations(spark, root).select("id"), seed=SEED)


def _sampled(algorithm):
    def run(spark, root):
        net = _obs_net(spark, root)
        answer = net.query("seg", event={"st": "F"}, algorithm=algorithm,
                           rows=observations(spark, root).select("id"), seed=SEED)
        return _rounded(answer)
    return run


def gibbs_conditional(spark, root):
    net = _wide_net(spark, root)
    return _rounded(sampling.full_conditional(net, "st").select("ls", "pri", "rf", "seg", "st", "p"))


QUERIES = {
    "bn_query_exact": flagship,
    "bn_query_joint2": query_joint2,
    "bn_fit": lambda s, d: _rounded(_obs_net(s, d).tables()),
    "bn_partial_fit": partial_fit,
    "bn_partial_fit_stream": partial_fit_stream,
    "bn_fit_prior": fit_prior,
    "bn_cdf": cdf,
    "bn_factor_product": factor_product,
    "bn_factor_cross": factor_cross,
    "bn_sum_out": sum_out,
    "bn_full_joint": full_joint,
    "bn_predict_proba": predict_proba,
    "bn_predict_log_proba": predict_log_proba,
    "bn_impute": impute,
    "bn_sample": sample,
    "bn_rejection": _sampled("rejection"),
    "bn_likelihood_weighting": _sampled("likelihood"),
    "bn_gibbs": _sampled("gibbs"),
    "bn_gibbs_conditional": gibbs_conditional,
}

# --- SQL -------------------------------------------------------------------


def _cpt(net: Network, node: str, source: str, prior: bool = False) -> str:
    """CTE ``cpt_<node>`` with the family columns, n and p."""
    fam, given = net.family(node), net.parents[node]
    cols = ", ".join(fam)
    rows = f"SELECT {cols}, count(*) AS n FROM {source} GROUP BY {cols}"
    if prior and given:
        grid = ", ".join(f"(SELECT DISTINCT {v} FROM {source})" for v in fam)
        rows = (f"SELECT {cols}, sum(n) AS n FROM ({rows} UNION ALL SELECT {cols}, 1 FROM {grid}) "
                f"GROUP BY {cols}")
    over = f"PARTITION BY {', '.join(given)}" if given else ""
    return (f"cpt_{node} AS MATERIALIZED (SELECT *, n::DOUBLE / sum(n) OVER ({over}) AS p "
            f"FROM ({rows}))")


def _cpts(net: Network, source: str, prior: bool = False) -> str:
    return ",\n".join(_cpt(net, n, source, prior) for n in net.nodes)


_OBS_NET, _WIDE_NET = Network(*OBS_EDGES), Network(*WIDE_EDGES)
_OBS = f"WITH RECURSIVE {OBS_SQL},\n{_cpts(_OBS_NET, 'obs')}"
_WIDE = f"WITH RECURSIVE {WIDE_SQL},\n{_cpts(_WIDE_NET, 'wide')}"


def _tables(net: Network) -> str:
    parts = []
    for node in net.nodes:
        cols = ", ".join(v if v in net.family(node) else f"CAST(NULL AS VARCHAR) AS {v}"
                         for v in sorted(net.nodes))
        parts.append(f"SELECT '{net.factor_name(node)}' AS factor, {cols}, round(p, 6) AS p FROM cpt_{node}")
    return " UNION ALL ".join(parts)


_TABLES = f"{_OBS} {_tables(_OBS_NET)}"


def _intervals(net: Network) -> str:
    parts = []
    for node in net.nodes:
        given = net.parents[node]
        by = f"PARTITION BY {', '.join(given)} " if given else ""
        parts.append(
            f"cdf_{node} AS MATERIALIZED (SELECT {', '.join(net.family(node))}, hi - n AS lo, hi, total FROM "
            f"(SELECT *, CAST(sum(n) OVER ({by}ORDER BY {node}) AS BIGINT) AS hi, "
            f"CAST(sum(n) OVER ({by}) AS BIGINT) AS total FROM cpt_{node}))")
    return ",\n".join(parts)


def _forward(net: Network, event: dict | None = None) -> str:
    """CTEs d0, d1, … that draw one variable each; the last holds the samples."""
    event = event or {}
    ctes, last = ["d0 AS (SELECT id, 1.0::DOUBLE AS weight FROM obs)"], "d0"
    for i, node in enumerate(net.nodes, 1):
        same = " AND ".join(f"s.{p} = t.{p}" for p in net.parents[node])
        if node in event:
            on = " AND ".join(filter(None, [same, f"t.{node} = '{event[node]}'"]))
            body = (f"SELECT s.* REPLACE (s.weight * coalesce(t.p, 0) AS weight), '{event[node]}' AS {node} "
                    f"FROM {last} s LEFT JOIN cpt_{node} t ON {on}")
        else:
            pick = f"floor({uniform_sql(SEED, 's.id', chr(39) + node + chr(39))} * t.total)"
            on = " AND ".join(filter(None, [same, f"t.lo <= {pick} AND {pick} < t.hi"]))
            body = f"SELECT s.*, t.{node} FROM {last} s JOIN cdf_{node} t ON {on}"
        last = f"d{i}"
        ctes.append(f"{last} AS MATERIALIZED ({body})")
    return ",\n".join(ctes)


_LAST = f"d{len(_OBS_NET.nodes)}"
_DRAWN = f"{_OBS},\n{_intervals(_OBS_NET)},\n{_forward(_OBS_NET)}"
_CLAMPED = f"{_OBS},\n{_intervals(_OBS_NET)},\n{_forward(_OBS_NET, {'st': 'F'})}"


def _gibbs_sql(sweeps: int = 2) -> str:
    ctes, last, step, states = [], f"(SELECT id, weight, pri, seg, st FROM {_LAST})", 0, []
    for var, other in (("pri", "seg"), ("seg", "pri")):
        ctes.append(
            f"full_{var} AS (SELECT {other}, st, {var}, q / sum(q) OVER (PARTITION BY {other}, st) AS p "
            f"FROM (SELECT c.pri, c.seg, c.st, c.p * r.p AS q FROM cpt_st c JOIN cpt_{var} r USING ({var})))")
        ctes.append(
            f"iv_{var} AS MATERIALIZED (SELECT *, coalesce(sum(p) OVER (PARTITION BY {other}, st ORDER BY {var} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, "
            f"CASE WHEN lead({var}) OVER (PARTITION BY {other}, st ORDER BY {var}) IS NULL THEN 2.0 ELSE "
            f"sum(p) OVER (PARTITION BY {other}, st ORDER BY {var}) END AS hi FROM full_{var})")
    for _ in range(sweeps):
        for var, other in (("pri", "seg"), ("seg", "pri")):
            step += 1
            u = uniform_sql(SEED, "s.id", f"'{var}'", str(step))
            ctes.append(
                f"g{step} AS MATERIALIZED (SELECT s.* REPLACE (coalesce(t.{var}, s.{var}) AS {var}) FROM {last} s "
                f"LEFT JOIN iv_{var} t ON s.{other} = t.{other} AND s.st = t.st AND t.lo <= {u} AND {u} < t.hi)")
            last = f"g{step}"
            states.append(f"SELECT seg, weight FROM {last}")
    shares = " UNION ALL ".join(states)
    return (f"{_CLAMPED},\n" + ",\n".join(ctes) +
            f" SELECT seg, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS p FROM ({shares}) GROUP BY seg")


_JOINT_OBS = "(SELECT pri, seg, st, a.p * b.p * c.p AS p FROM cpt_st c JOIN cpt_pri a USING (pri) JOIN cpt_seg b USING (seg))"
_JOINT_WIDE = ("(SELECT ls, pri, rf, seg, st, c.p * a.p * b.p * d.p * e.p AS p FROM cpt_st c "
               "JOIN cpt_pri a USING (pri) JOIN cpt_seg b USING (seg) JOIN cpt_rf d USING (st) JOIN cpt_ls e USING (st))")


def _impute_sql() -> str:
    best = []
    for key, by, miss in (("b_st", "pri, seg", ["st"]), ("b_pri", "seg, st", ["pri"]), ("b_both", "seg", ["pri", "st"])):
        cols = f"{by}, {', '.join(miss)}"
        best.append(
            f"{key} AS (SELECT {cols} FROM (SELECT {cols}, row_number() OVER (PARTITION BY {by} "
            f"ORDER BY p DESC, {', '.join(miss)}) AS rn FROM (SELECT {cols}, sum(p) AS p FROM {_JOINT_OBS} "
            f"GROUP BY {cols})) WHERE rn = 1)")
    return (f"{_OBS},\ngaps AS (SELECT id, seg, CASE WHEN year <> {SPLIT_YEAR} THEN pri END AS pri, "
            f"CASE WHEN price BETWEEN {CHEAP} AND {DEAR} THEN st END AS st FROM obs),\n" + ",\n".join(best) +
            " SELECT g.id, coalesce(g.pri, b.pri, c.pri) AS pri, g.seg, coalesce(g.st, a.st, c.st) AS st FROM gaps g "
            "LEFT JOIN b_st a ON g.st IS NULL AND g.pri = a.pri AND g.seg = a.seg "
            "LEFT JOIN b_pri b ON g.pri IS NULL AND g.st = b.st AND g.seg = b.seg "
            "LEFT JOIN b_both c ON g.st IS NULL AND g.pri IS NULL AND g.seg = c.seg")


_SCORED = (f"{_OBS} SELECT id, {{value}} FROM obs LEFT JOIN {_JOINT_OBS} j USING (pri, seg, st)")

SQL = {
    "bn_query_exact": f"""{_OBS} SELECT st, round(sum(p) / sum(sum(p)) OVER (), 6) AS p
        FROM {_JOINT_OBS} WHERE seg = 'BUILDING' GROUP BY st""",
    "bn_query_joint2": f"""{_WIDE} SELECT pri, rf, round(sum(p) / sum(sum(p)) OVER (), 6) AS p
        FROM {_JOINT_WIDE} WHERE ls = 'O' GROUP BY pri, rf""",
    "bn_fit": _TABLES,
    "bn_partial_fit": _TABLES,
    "bn_partial_fit_stream": _TABLES,
    "bn_fit_prior": f"WITH {OBS_SQL},\n{_cpts(_OBS_NET, 'obs', prior=True)} {_tables(_OBS_NET)}",
    "bn_cdf": f"{_OBS},\n{_intervals(_OBS_NET)} SELECT pri, seg, st, lo, hi, total FROM cdf_st",
    "bn_factor_product": f"""{_OBS} SELECT c.pri, c.seg, c.st, round(c.p * b.p, 6) AS p
        FROM cpt_st c JOIN cpt_seg b USING (seg)""",
    "bn_factor_cross": f"{_OBS} SELECT pri, seg, round(a.p * b.p, 6) AS p FROM cpt_pri a, cpt_seg b",
    "bn_sum_out": f"""{_OBS} SELECT c.pri, c.st, round(sum(c.p * b.p), 6) AS p
        FROM cpt_st c JOIN cpt_seg b USING (seg) GROUP BY c.pri, c.st""",
    "bn_full_joint": f"{_WIDE} SELECT ls, pri, rf, seg, st, round(p / sum(p) OVER (), 6) AS p FROM {_JOINT_WIDE}",
    "bn_predict_proba": _SCORED.format(
        value=f"round(coalesce(j.p, 0) / (SELECT sum(p) FROM {_JOINT_OBS}), 6) AS p"),
    "bn_predict_log_proba": _SCORED.format(
        value=f"round(ln(coalesce(j.p, 0) / (SELECT sum(p) FROM {_JOINT_OBS})), 6) AS log_p"),
    "bn_impute": _impute_sql(),
    "bn_sample": f"{_DRAWN} SELECT id, pri, seg, st FROM {_LAST}",
    "bn_rejection": f"""{_DRAWN} SELECT seg, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS p
        FROM {_LAST} WHERE st = 'F' GROUP BY seg""",
    "bn_likelihood_weighting": f"""{_CLAMPED} SELECT seg, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS p
        FROM {_LAST} GROUP BY seg""",
    "bn_gibbs": _gibbs_sql(),
    "bn_gibbs_conditional": f"""{_WIDE} SELECT ls, pri, rf, seg, st,
        round(q / sum(q) OVER (PARTITION BY ls, pri, rf, seg), 6) AS p
        FROM (SELECT ls, c.pri, rf, c.seg, st, c.p * d.p * e.p AS q FROM cpt_st c
              JOIN cpt_rf d USING (st) JOIN cpt_ls e USING (st))""",
}
