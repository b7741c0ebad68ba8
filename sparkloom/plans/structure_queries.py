"""Structure learning and DAG queries, with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparkloom.operators import chowliu, dag
from sparkloom.operators.forest import spanning_tree
from sparkloom.plans.inputs import LINKS_SQL, WIDE_SQL, supply_links, wide_observations
from sparkloom.sources.tables import table

COLUMNS = ["seg", "pri", "st", "rf", "ls", "ln"]


def _mi(spark, root):
    return chowliu.mutual_information(wide_observations(spark, root), COLUMNS)


def _suppliers(spark, root):
    """Every supplier, as the targets of the relevance query."""
    return table(spark, root, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


def _edge_lists(spark, root):
    """Rows of parents and children: each order below its customer, and for each line item
    below its customer and supplier together."""
    orders = table(spark, root, "orders")
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey")

    def name(kind, col):
        return F.concat(F.lit(kind), F.col(col).cast("string"))

    child = F.array(name("O", "o_orderkey")).alias("children")
    customer, supplier = name("C", "o_custkey"), name("S", "l_suppkey")
    pairs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.array(customer).alias("parents"), child).union(
        pairs.select(F.array(customer, supplier).alias("parents"), child))


def _rounded_mi(df):
    return df.select("u", "v", F.round("mi", 9).alias("mi"))


QUERIES = {
    "cl_mutual_info": lambda s, d: _rounded_mi(_mi(s, d)),
    "cl_edges_ranked": lambda s, d: _rounded_mi(chowliu.ranked_edges(_mi(s, d))),
    "cl_spanning_tree": lambda s, d: _rounded_mi(spanning_tree(_mi(s, d), "mi")),
    "cl_oriented_tree": lambda s, d: chowliu.chow_liu(wide_observations(s, d), columns=COLUMNS),
    "dag_edges": lambda s, d: dag.edges_from_lists(_edge_lists(s, d)),
    "dag_roots": lambda s, d: dag.roots(supply_links(s, d)),
    "dag_ancestors": lambda s, d: dag.ancestors(supply_links(s, d)),
    "dag_relevant": lambda s, d: dag.relevant(supply_links(s, d), _suppliers(s, d)),
    "dag_markov_boundary": lambda s, d: dag.markov_boundary(supply_links(s, d)),
    "dag_topo_level": lambda s, d: dag.topological_order(supply_links(s, d)),
    "dag_is_tree": lambda s, d: dag.is_tree(supply_links(s, d)),
    "dag_dfs_order": lambda s, d: dag.depth_first_order(supply_links(s, d)),
}


def _mi_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{u}' AS u, '{v}' AS v, {u} AS a, {v} AS b, count(*) AS n FROM wide GROUP BY ALL"
        for u, v in combinations(sorted(COLUMNS), 2))
    return f"""WITH RECURSIVE {WIDE_SQL}, cells AS ({cells}),
        full_cells AS (SELECT u, v, n::DOUBLE AS n, sum(n) OVER (PARTITION BY u, v) AS t,
            sum(n) OVER (PARTITION BY u, v, a) AS na, sum(n) OVER (PARTITION BY u, v, b) AS nb FROM cells),
        mis AS MATERIALIZED (SELECT u, v, sum(n / t * ln(n * t / (na * nb))) AS mi FROM full_cells GROUP BY u, v)"""


# An edge is in the tree iff strictly better edges do not already connect its ends.
_TREE_SQL = _mi_sql() + """,
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY mi DESC, u, v) AS rk FROM mis),
    reach AS (
        SELECT rk, u AS at FROM ranked
        UNION
        SELECT r.rk, CASE WHEN e.u = r.at THEN e.v ELSE e.u END
        FROM reach r JOIN ranked e ON e.rk < r.rk AND r.at IN (e.u, e.v)),
    tree AS MATERIALIZED (
        SELECT u, v, mi FROM ranked k
        WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.rk = k.rk AND r.at = k.v))"""

_CLOSURE_SQL = f"""WITH RECURSIVE {LINKS_SQL},
    up AS (SELECT child AS node, parent AS ancestor FROM links
           UNION SELECT up.node, l.parent FROM up JOIN links l ON l.child = up.ancestor)"""

SQL = {
    "cl_mutual_info": f"{_mi_sql()} SELECT u, v, round(mi, 9) AS mi FROM mis",
    "cl_edges_ranked": f"{_mi_sql()} SELECT u, v, round(mi, 9) AS mi FROM mis ORDER BY mi DESC, u, v",
    "cl_spanning_tree": f"{_TREE_SQL} SELECT u, v, round(mi, 9) AS mi FROM tree",
    "cl_oriented_tree": f"""{_TREE_SQL},
        both_ways AS (SELECT u AS a, v AS b FROM tree UNION ALL SELECT v, u FROM tree),
        walk AS (SELECT a AS parent, b AS child FROM both_ways WHERE a = '{COLUMNS[0]}'
                 UNION ALL SELECT w.child, e.b FROM walk w JOIN both_ways e ON e.a = w.child AND e.b <> w.parent)
        SELECT parent, child FROM walk""",
    "dag_edges": """SELECT DISTINCT 'C' || o_custkey AS parent, 'O' || o_orderkey AS child FROM orders
        UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'O' || o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "dag_roots": f"WITH {LINKS_SQL} SELECT DISTINCT parent AS node FROM links WHERE parent NOT IN (SELECT child FROM links)",
    "dag_ancestors": f"{_CLOSURE_SQL} SELECT node, ancestor FROM up",
    "dag_relevant": f"""{_CLOSURE_SQL} SELECT 'S' || s_suppkey AS node FROM supplier
        UNION SELECT ancestor FROM up WHERE node IN (SELECT 'S' || s_suppkey FROM supplier)""",
    "dag_markov_boundary": f"""WITH {LINKS_SQL}
        SELECT child AS node, parent AS member FROM links
        UNION SELECT parent, child FROM links
        UNION SELECT a.parent, b.parent FROM links a JOIN links b ON a.child = b.child WHERE a.parent <> b.parent""",
    "dag_topo_level": f"""WITH RECURSIVE {LINKS_SQL},
        walk AS (SELECT DISTINCT parent AS node, CAST(0 AS BIGINT) AS level FROM links
                 WHERE parent NOT IN (SELECT child FROM links)
                 UNION SELECT l.child, w.level + 1 FROM walk w JOIN links l ON l.parent = w.node)
        SELECT node, max(level) AS level, row_number() OVER (ORDER BY max(level), node) AS position
        FROM walk GROUP BY node""",
    "dag_is_tree": f"""WITH {LINKS_SQL} SELECT max(n) <= 1 AS is_tree
        FROM (SELECT count(DISTINCT parent) AS n FROM links GROUP BY child)""",
    "dag_dfs_order": f"""WITH RECURSIVE {LINKS_SQL},
        walk AS (SELECT DISTINCT parent AS node, [parent] AS path FROM links
                 WHERE parent NOT IN (SELECT child FROM links)
                 UNION ALL SELECT l.child, list_append(w.path, l.child) FROM walk w JOIN links l ON l.parent = w.node)
        SELECT node, row_number() OVER (ORDER BY min(path)) AS position FROM walk GROUP BY node""",
}
