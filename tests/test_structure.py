import itertools
import math
import random
from collections import Counter

import pytest

from sparkloom import chow_liu
from sparkloom.operators import chowliu, dag, forest
from sparkloom.operators.network import Network
from sparkloom.operators.ranking import global_rank
from sparkloom.plans import graph_queries


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def random_dag(n=14, p=0.25, seed=2):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    rng.shuffle(names)
    return [(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


@pytest.fixture(params=[2, 3])
def graph(request, spark):
    pairs = random_dag(seed=request.param)
    return Network(*pairs), edges_df(spark, pairs + pairs[:2])


def test_roots_and_tree_test(spark, graph):
    net, edges = graph
    assert sorted(r["node"] for r in dag.roots(edges).collect()) == net.roots
    assert dag.is_tree(edges).first()["is_tree"] == net.is_tree
    assert dag.is_tree(edges_df(spark, [("a", "b"), ("a", "c")])).first()["is_tree"]


def test_ancestors(spark, graph):
    net, edges = graph
    got = {}
    for node, up in dag.ancestors(edges).collect():
        got.setdefault(node, set()).add(up)
    assert got == {n: net.ancestors(n) for n in net.nodes if net.parents[n]}
    target = net.nodes[-1]
    few = dag.relevant(edges, spark.createDataFrame([(target,)], "node string"))
    assert {r["node"] for r in few.collect()} == {target} | net.ancestors(target)


def test_markov_boundary(graph):
    net, edges = graph
    got = {}
    for node, member in dag.markov_boundary(edges).collect():
        got.setdefault(node, []).append(member)
    assert {n: sorted(m) for n, m in got.items()} == {n: net.markov_boundary(n) for n in net.nodes}


def test_orders(graph):
    net, edges = graph
    place = {r["node"]: r["position"] for r in dag.topological_order(edges).collect()}
    assert sorted(place.values()) == list(range(1, len(net.nodes) + 1))
    assert all(place[p] < place[c] for p, c in net.edges)
    walk = sorted((r["position"], r["node"]) for r in dag.depth_first_order(edges).collect())
    want = Network(*net.edges)
    assert [n for _, n in walk] == _preorder(want)


def _preorder(net):
    order, seen = [], set()

    def visit(node):
        if node not in seen:
            seen.add(node)
            order.append(node)
            for child in net.children[node]:
                visit(child)

    for root in sorted(net.roots):
        visit(root)
    return order


def test_cycles_are_refused(spark):
    loop = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    with pytest.raises(ValueError):
        dag.ancestors(loop)
    with pytest.raises(ValueError):
        dag.topological_level(edges_df(spark, [("a", "b"), ("b", "a")]))


def test_depth_first_order_refuses_cycles(spark):
    for links in (
        [("a", "b"), ("b", "a")],  # no root
        [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a")],  # below a root
        [("r", "s"), ("a", "b"), ("b", "a")],  # beside one
        [("r", "z"), ("z", "a"), ("a", "z")], [("r", "a"), ("a", "a")],
    ):
        with pytest.raises(ValueError):
            dag.depth_first_order(edges_df(spark, links))
    crossing = [("r", "b"), ("b", "a"), ("r", "c"), ("c", "a"), ("c", "b"), ("r", "a")]
    walk = dag.depth_first_order(edges_df(spark, crossing)).orderBy("position").collect()
    assert [r["node"] for r in walk] == _preorder(Network(*crossing))


@pytest.mark.parametrize("rounds", [2, 16])
def test_levels_of_a_deep_graph(spark, monkeypatch, rounds):
    monkeypatch.setattr(dag, "MERGE_ROUNDS", rounds)
    links = [(f"n{i:02}", f"n{i + 1:02}") for i in range(11)] + [("n00", "n07"), ("m", "n09"), ("n03", "x"), ("m", "x"), ("m", "y")]
    level = {}
    for node in ["n00", "m", *(f"n{i:02}" for i in range(1, 12)), "x", "y"]:
        level[node] = max((level[p] + 1 for p, c in links if c == node), default=0)
    assert {r["node"]: r["level"] for r in dag.topological_level(edges_df(spark, links)).collect()} == level
    assert dag.topological_level(edges_df(spark, links[:1]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        dag.topological_level(edges_df(spark, [*links, ("n11", "n08")]))


def test_edges_from_lists(spark):
    spec = spark.createDataFrame([(["a", "b"], ["c"]), (["a"], ["c", "d"])], "parents array<string>, children array<string>")
    assert sorted(map(tuple, dag.edges_from_lists(spec).collect())) == [("a", "c"), ("a", "d"), ("b", "c")]


@pytest.mark.parametrize("one_hot", [48, 3, 0])
def test_two_hundred_columns(spark, monkeypatch, one_hot):
    from sparkloom.operators import labelsets

    rng = random.Random(9)
    names, n = [f"x{i:03d}" for i in range(200)], 500
    columns = [[str(rng.randrange(2 + i % 6)) for _ in range(n)] for i in range(200)]
    for i in range(1, 200):  # each column mostly follows an earlier one
        columns[i] = [(columns[i // 3][r] if rng.random() < 0.7 else v) for r, v in enumerate(columns[i])]
    for i in range(0, 200, 9):
        columns[i] = [None if rng.random() < 0.1 else v for v in columns[i]]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{c} string" for c in names)).repartition(4)
    monkeypatch.setattr(labelsets, "ONE_HOT_LABELS", one_hot)
    monkeypatch.setattr(labelsets, "ONE_HOT_ROWS", 50)
    monkeypatch.setattr(labelsets, "HELD", 20_000)
    want = {}
    for i, j in itertools.combinations(range(200), 2):
        pairs = [(a, b) for a, b in zip(columns[i], columns[j]) if a is not None and b is not None]
        joint, left, right = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
        want[names[i], names[j]] = sum(c / len(pairs) * math.log(c * len(pairs) / left[a] / right[b]) for (a, b), c in joint.items())
    got = {(r["u"], r["v"]): r["mi"] for r in chowliu.mutual_information(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if one_hot == 48:
        group = {c: c for c in names}

        def top(c):
            while group[c] != c:
                c = group[c]
            return c

        tree = set()
        for u, v in sorted(want, key=lambda k: (-round(want[k], 12), k)):
            if top(u) != top(v):
                group[top(u)] = top(v)
                tree.add(frozenset((u, v)))
        assert {frozenset((r["parent"], r["child"])) for r in chow_liu(df).collect()} == tree


def test_mutual_information(spark):
    rng = random.Random(4)
    data = []
    for _ in range(300):
        a = rng.choice("xy")
        data.append((a, rng.choice("xy") if rng.random() < .3 else a, rng.choice("uvw")))
    df = spark.createDataFrame(data, "a string, b string, c string")
    got = {(r["u"], r["v"]): r["mi"] for r in chowliu.mutual_information(df).collect()}
    for i, j in itertools.combinations(range(3), 2):
        pair, left, right = Counter((r[i], r[j]) for r in data), Counter(r[i] for r in data), Counter(r[j] for r in data)
        want = sum(n / 300 * math.log(n * 300 / (left[x] * right[y])) for (x, y), n in pair.items())
        assert got["abc"[i], "abc"[j]] == pytest.approx(want)
    edges = [(r["parent"], r["child"]) for r in chow_liu(df, root="b").collect()]
    assert ("b", "a") in edges and len(edges) == 2
    assert {r["parent"] for r in chow_liu(df).collect()} >= {"a"}


def _kruskal(pairs):
    label, kept = {}, []
    for u, v, w in sorted(pairs, key=lambda e: (-e[2], e[0], e[1])):
        a, b = label.setdefault(u, {u}), label.setdefault(v, {v})
        if a is not b:
            kept.append((u, v, w))
            a |= b
            for n in b:
                label[n] = a
    return sorted(kept)


@pytest.mark.parametrize("seed,weights", [(1, 3), (2, 1000)])
def test_spanning_tree(spark, seed, weights):
    rng = random.Random(seed)
    pairs = [(f"n{i:02d}", f"n{j:02d}", float(rng.randrange(weights)))
             for i in range(25) for j in range(i + 1, 25) if rng.random() < .2 and (i < 20) == (j < 20)]
    tree = forest.spanning_tree(spark.createDataFrame(pairs, "u string, v string, w double"), "w")
    assert sorted(map(tuple, tree.collect())) == _kruskal(pairs)


def test_components(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    random.Random(1).shuffle(path)
    star = [("zz", f"s{i}") for i in range(5)] + [("solo", "solo")]
    df = spark.createDataFrame(path + star, "u string, v string")
    got = {r["node"]: r["component"] for r in forest.components(df).collect()}
    assert len(got) == 121 + 6 + 1
    assert {got[f"p{i:03d}"] for i in range(121)} == {"p000"}
    assert got["zz"] == "s0" and got["solo"] == "solo"
    assert forest.largest_component(df).count() == 120


def test_components_with_nodes_that_have_no_edge(spark):
    df = spark.createDataFrame([("a", "b")], "u string, v string")
    nodes = spark.createDataFrame([("a",), ("alone",)], "node string")
    got = sorted(map(tuple, forest.components(df, nodes=nodes).collect()))
    assert got == [("a", "a"), ("alone", "alone"), ("b", "a")]


def test_page_components_can_keep_pages_without_links(spark, tmp_path):
    pages = [(1, 'x <a href="t">'), (2, "no link"), (3, None), (4, 'y <a href="t">')]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    linked = {("p1", "ht"), ("p4", "ht"), ("ht", "ht")}
    assert set(map(tuple, graph_queries.page_components(spark, str(tmp_path)).collect())) == linked
    got = set(map(tuple, graph_queries.page_components(spark, str(tmp_path), isolated=True).collect()))
    assert got == linked | {("p2", "p2"), ("p3", "p3")}


def test_orient(spark):
    tree = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "u string, v string")
    assert sorted(map(tuple, forest.orient(tree, "d").collect())) == [("b", "a"), ("c", "b"), ("d", "c")]


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as k")
    got = sorted((r["k"], r["rank"]) for r in global_rank(df, ["k"]).collect())
    assert [r for _, r in got] == list(range(1, 1001))
    assert [k for k, _ in got] == sorted(k for k, _ in got)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_markov_boundary_groups_a_pair_once(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), (None, "c"), ("c", None), ("e", "e"), ("a", "b")]
    edges = spark.createDataFrame(links, "parent string, child string")
    got = dag.markov_boundary(edges)
    near = [(a, b) for a, b in links] + [("a", "d"), ("b", "d"), ("a", "b")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted({p for a, b in near for p in ((a, b), (b, a))}, key=str)
    plan = plan_of(got)
    assert plan.index("Generate") < plan.index("Aggregate")  # directions are told apart after the rows are grouped


def test_ancestors_are_grouped_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(dag, "PART_ROWS", 10)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(11)], "parent string, child string")
    got = dag.ancestors(chain)
    assert "RepartitionByExpression [node" in plan_of(got) and ", 7" in plan_of(got).split("RepartitionByExpression")[1].split("\n")[0]
    assert got.count() == 66 and got.distinct().count() == 66
