import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import BeliefNetwork
from sparkloom.operators import sampling
from sparkloom.operators.network import Network

EDGES = [("a", "c"), ("b", "c"), ("c", "d")]


def make_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice("xxy"), rng.choice("uvw")
        c = rng.choice("mn" if a == "x" else "mmmn")
        d = rng.choice("pq" if c == "m" else "pppq")
        rows.append((i, a, b, c, d))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(make_rows(), "id bigint, a string, b string, c string, d string").cache()


@pytest.fixture(scope="module")
def net(data):
    return BeliefNetwork(*EDGES).fit(data)


def joint(net):
    """Full joint by brute force from the collected tables."""
    tables = {n: {tuple(r[v] for v in net.family(n)): r["p"] for r in net.cpt(n).collect()} for n in net.nodes}
    labels = {n: sorted({k[-1] for k in tables[n]}) for n in net.nodes}
    out = {}
    for combo in itertools.product(*[labels[n] for n in net.nodes]):
        state = dict(zip(net.nodes, combo))
        p = math.prod(tables[n].get(tuple(state[v] for v in net.family(n)), 0) for n in net.nodes)
        out[tuple(state[n] for n in sorted(net.nodes))] = p
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def posterior(full, names, query, event):
    at = {n: i for i, n in enumerate(names)}
    kept = {k: p for k, p in full.items() if all(k[at[v]] == x for v, x in event.items())}
    out = {}
    for k, p in kept.items():
        key = tuple(k[at[q]] for q in sorted(query))
        out[key] = out.get(key, 0) + p
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_structure():
    net = Network("e", ("a", "b"), (["a", "b"], ["c", "d"]), ("c", "d"))
    assert net.edges == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert net.nodes == ["a", "e", "b", "c", "d"]
    assert net.roots == ["a", "e"]
    assert not net.is_tree and Network(("a", "b"), ("a", "c")).is_tree
    assert net.ancestors("d") == {"a", "b", "c"}
    assert net.markov_boundary("b") == ["a", "c", "d"]
    assert net.depth_first() == ["a", "b", "c", "d", "e"]
    assert net.factor_name("d") == "P(d | a, b, c)" and net.factor_name("a") == "P(a)"
    with pytest.raises(ValueError):
        Network(("a", "b"), ("b", "a"))


def test_reserved_names():
    with pytest.raises(ValueError, match="rename"):
        BeliefNetwork(("a", "p"))


def test_tables_sum_to_one(net):
    for node in net.nodes:
        sums = {}
        for r in net.cpt(node).collect():
            key = tuple(r[v] for v in net.parents[node])
            sums[key] = sums.get(key, 0) + r["p"]
        assert all(abs(s - 1) < 1e-12 for s in sums.values())


def test_fit_counts(net):
    rows = make_rows()
    for r in net.cpt("c").collect():
        given = [x for x in rows if x[1] == r["a"] and x[2] == r["b"]]
        assert r["p"] == pytest.approx(sum(x[3] == r["c"] for x in given) / len(given))
    assert [r["factor"] for r in net.tables().collect()] == sorted(r["factor"] for r in net.tables().collect())


def test_partial_fit_equals_fit(spark, data, net, rows):
    first, second = data.where("id < 150"), data.where("id >= 150")
    split = BeliefNetwork(*EDGES).fit(first).partial_fit(second)
    assert rows(split.tables()) == rows(net.tables())


def test_nulls_are_left_out_per_family(spark):
    df = spark.createDataFrame([("x", "p"), ("x", None), (None, "p"), ("y", "q")], "a string, b string")
    net = BeliefNetwork(("a", "b")).fit(df)
    assert {r["a"]: round(r["p"], 6) for r in net.cpt("a").collect()} == {"x": 0.666667, "y": 0.333333}
    assert {(r["a"], r["b"]): r["p"] for r in net.cpt("b").collect()} == {("x", "p"): 1.0, ("y", "q"): 1.0}


def test_prior_counts(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "q")], "a string, b string")
    net = BeliefNetwork(("a", "b"), prior_count=1).fit(df)
    got = {(r["a"], r["b"]): round(r["p"], 6) for r in net.cpt("b").collect()}
    assert got == {("x", "p"): 0.75, ("x", "q"): 0.25, ("y", "p"): 0.333333, ("y", "q"): 0.666667}
    assert {r["a"]: round(r["p"], 6) for r in net.cpt("a").collect()} == {"x": 0.666667, "y": 0.333333}
    again = net.partial_fit(df)  # no second prior
    assert {(r["a"], r["b"]): round(r["p"], 6) for r in again.cpt("b").collect()}[("x", "q")] == round(1 / 6, 6)


def test_two_hundred_variables(spark, monkeypatch):
    from sparkloom.operators import labelsets

    rng = np.random.default_rng(6)
    names = [f"v{i:03d}" for i in range(200)]
    table = [[None if rng.random() < 0.05 else f"l{rng.integers(2 + i % 7)}" for i in range(200)] for _ in range(700)]
    df = spark.createDataFrame(table, ", ".join(f"{n} string" for n in names)).repartition(3)
    links = [([names[i // 2], names[max(0, i - 7)]], names[i]) for i in range(1, 200)]
    monkeypatch.setattr(labelsets, "HELD", 500)  # tasks emit several times
    net = BeliefNetwork(*links).fit(df)
    want = {}
    for node in net.nodes:
        at = [names.index(v) for v in net.family(node)]
        for key, n in Counter(tuple(r[k] for k in at) for r in table).items():
            if None not in key:
                want[node, key] = n
    got = {(r["node"], tuple(r[v] for v in net.family(r["node"]))): r["n"] for r in net.counts.collect()}
    assert got == want and net.counts.columns == ["node", *names, "n"]


def test_guide_tables_of_many_labels(spark):
    """A root with 100,000 labels and a child with labels of very unequal number by parent."""
    from sparkloom.functions.uniform import uniform

    rng = random.Random(4)
    table = [(f"r{i:06d}", f"c{rng.randrange(1 if i % 3 else 3000):04d}") for i in range(100_000)]
    df = spark.createDataFrame(table, "r string, c string").withColumn("c", F.when(F.col("r") < "r050000", F.col("c")).otherwise("c0000"))
    df = df.withColumn("g", F.substring("r", 6, 2))
    net = BeliefNetwork("r", ("g", "c")).fit(df.repartition(4))
    for node in ("r", "c"):
        cdf, given = net.cdf(node), net.parents[node]
        guide, _ = sampling._guide(cdf, given, F.expr("(total + __m - 1) div __m"), F.expr("lo div __step"), F.expr("(hi - 1) div __step"))
        labels = cdf.count()
        assert labels <= guide.count() <= 2 * labels
    ids = spark.range(3000)
    got = {r["id"]: (r["r"], r["g"], r["c"]) for r in sampling.forward(net, ids, "id", 5).collect()}
    draws = {r["id"]: r for r in ids.select("id", *[uniform(5, F.col("id"), v).alias(v) for v in "rgc"]).collect()}
    bounds = {}
    for node in "rgc":
        for r in net.cdf(node).orderBy("lo").collect():
            bounds.setdefault((node, r["g"] if node == "c" else None), []).append((r["hi"], r[node], r["total"]))
    upper = {k: np.array([hi for hi, *_ in own]) for k, own in bounds.items()}
    for i, (r, g, c) in got.items():
        for node, key, label in (("r", None, r), ("g", None, g), ("c", g, c)):
            own = bounds[node, key]
            at = np.searchsorted(upper[node, key], math.floor(draws[i][node] * own[0][2]), "right")
            assert own[at][1] == label
    assert len(got) == 3000


def test_families_beyond_packed_codes(spark, monkeypatch):
    from sparkloom.operators import labelsets

    rows = [(f"a{i % 3}", f"b{i % 5}", None if i % 7 == 0 else f"c{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    read = lambda: sorted(tuple(r) for r in labelsets.count_sets(df, [["a", "b", "c"], ["c", "a"]]).select("at", F.concat_ws(",", "labels"), "n").collect())
    want = read()
    for name in ("DENSE", "PACKED"):
        monkeypatch.setattr(labelsets, name, 1)
        assert read() == want
    assert sum(n for at, _, n in want if at == 0) == sum(c is not None for *_, c in rows)


@pytest.mark.parametrize("query,event", [
    (["a"], {}), (["c"], {"a": "x"}), (["a"], {"d": "q"}), (["a", "b"], {"d": "p"}), (["d"], {"a": "y", "b": "u"}),
])
def test_exact_posterior(net, query, event):
    want = posterior(joint(net), sorted(net.nodes), query, event)
    answer = net.query(*query, event=event)
    assert answer.columns == [*sorted(query), "p"]
    got = {tuple(r[q] for q in sorted(query)): r["p"] for r in answer.collect()}
    assert got == pytest.approx(want)


def test_full_joint(net):
    got = {tuple(r[n] for n in sorted(net.nodes)): r["p"] for r in net.full_joint().collect()}
    assert got == pytest.approx({k: p for k, p in joint(net).items() if p > 0})


def test_query_errors(net):
    with pytest.raises(ValueError):
        net.query(event={})
    with pytest.raises(ValueError):
        net.query("a", event={"a": "x"})
    with pytest.raises(ValueError):
        net.query("a", event={}, algorithm="magic")


@pytest.mark.parametrize("algorithm,ids", [("rejection", 20000), ("likelihood", 8000), ("gibbs", 8000)])
def test_sampled_posteriors(spark, net, algorithm, ids):
    want = posterior(joint(net), sorted(net.nodes), ["a"], {"d": "q"})
    draw = net.query("a", event={"d": "q"}, algorithm=algorithm, rows=spark.range(ids), seed=3)
    got = {(r["a"],): r["p"] for r in draw.collect()}
    # the effective sample size is smaller than the number of draws
    tolerance = 4 * math.sqrt(0.25 / (ids / 4))
    assert got == pytest.approx(want, abs=tolerance)


@pytest.mark.parametrize("sweeps,burn_in", [(2, 0), (4, 1)])
def test_gibbs_on_a_strongly_coupled_chain(spark, sweeps, burn_in):
    """Short chains hardly move here, so only right starting weights give the posterior."""
    rows = [(f"{a}", f"{b}", f"{c}") for a in (0, 1) for b in (0, 1) for c in (0, 1)
            for _ in range(round(1000 * (0.1 if a else 0.9) * (0.99 if a == b else 0.01) * (0.99 if b == c else 0.01)) + 1)]
    net = BeliefNetwork(("a", "b"), ("b", "c")).fit(spark.createDataFrame(rows, "a string, b string, c string"))
    want = {r["a"]: r["p"] for r in net.query("a", event={"c": "1"}).collect()}
    draw = net.query("a", event={"c": "1"}, algorithm="gibbs", rows=spark.range(8000), seed=5, sweeps=sweeps, burn_in=burn_in)
    # about a tenth of the draws carry the weight
    assert {r["a"]: r["p"] for r in draw.collect()} == pytest.approx(want, abs=4 * math.sqrt(0.25 / 800))
    with pytest.raises(ValueError):
        net.query("a", event={"c": "1"}, algorithm="gibbs", sweeps=1, burn_in=1)


def test_default_number_of_draws(net):
    answer = net.query("c", event={}, algorithm="rejection", n_iterations=50)
    assert sum(r["p"] for r in answer.collect()) == pytest.approx(1)


def test_sample_follows_tables(spark, net):
    drawn = net.sample(spark.range(20000), seed=5)
    assert drawn.columns == ["id", "a", "b", "c", "d"] and drawn.count() == 20000
    share = {r["c"]: r["count"] / 20000 for r in drawn.groupBy("c").count().collect()}
    want = posterior(joint(net), sorted(net.nodes), ["c"], {})
    assert share["m"] == pytest.approx(want[("m",)], abs=0.015)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, net.sample(spark.range(20000), seed=5).collect()))


def test_gibbs_chain_moves_one_variable_per_step(spark, net):
    chains = sampling.gibbs_chains(net, {"d": "q"}, spark.range(50), "id", 1, sweeps=2)
    steps = {}
    for r in chains.collect():
        steps.setdefault(r["id"], {})[r["step"]] = (r["a"], r["b"], r["c"], r["d"])
    assert len(steps) == 50
    for states in steps.values():
        assert sorted(states) == [1, 2, 3, 4, 5, 6]
        for k in range(2, 7):
            moved = [i for i in range(4) if states[k][i] != states[k - 1][i]]
            assert moved in ([], [(k - 1) % 3])
            assert states[k][3] == "q"


def test_impute(spark, net):
    full, names = joint(net), ["a", "b", "c", "d"]
    cases = [(1, None, "u", "m", "q"), (2, "x", None, None, "p"), (3, "y", "v", "n", "q"), (4, None, None, None, None)]
    got = {r["id"]: tuple(r[n] for n in names) for r in net.impute(
        spark.createDataFrame(cases, "id bigint, a string, b string, c string, d string")).collect()}
    for case in cases:
        event = {n: v for n, v in zip(names, case[1:]) if v is not None}
        missing = [n for n in names if n not in event]
        filled = dict(event)
        if missing:
            answer = posterior(full, names, missing, event)
            best = min(answer, key=lambda k: (-answer[k], k))
            filled.update(zip(sorted(missing), best))
        assert got[case[0]] == tuple(filled[n] for n in names)


def test_impute_repeated_rows_impossible_evidence_and_empty_table(spark):
    seen = [("x", "u"), ("x", "u"), ("y", "v"), ("y", "w")]
    net = BeliefNetwork(("a", "b")).fit(spark.createDataFrame(seen, "a string, b string"))
    cases = [(1, "x", None), (2, "x", None), (3, "?", None), (4, "y", None), (5, None, "w"), (6, "y", "u"), (None, None, None), (None, None, None)]
    frame = spark.createDataFrame(cases, "id bigint, a string, b string")
    got = sorted(net.impute(frame).collect(), key=str)
    want = [(1, "x", "u"), (2, "x", "u"), (3, "?", None), (4, "y", "v"), (5, "y", "w"), (6, "y", "u"), (None, "x", "u"), (None, "x", "u")]
    assert [tuple(r) for r in got] == want
    assert net.impute(frame.limit(0)).collect() == []


def test_impute_keeps_the_best_label_early(spark):
    """A chain of seven variables: labels of the first are settled before the last are bound."""
    rng = random.Random(4)
    names = "abcdefg"
    data = []
    for _ in range(300):
        row = [rng.choice("012")]
        while len(row) < len(names):
            row.append(row[-1] if rng.random() < 0.6 else rng.choice("012"))
        data.append(tuple(row))
    schema = ", ".join(f"{n} string" for n in names)
    net = BeliefNetwork(*zip(names, names[1:])).fit(spark.createDataFrame(data, schema))
    full, cases = joint(net), []
    for i in range(40):
        row = [v if rng.random() < 0.5 else None for v in rng.choice(data)]
        cases.append((i, *row))
    got = {r[0]: tuple(r[1:]) for r in net.impute(spark.createDataFrame(cases, f"id bigint, {schema}")).collect()}
    for i, *row in cases:
        fits = {k: p for k, p in full.items() if all(v is None or v == w for v, w in zip(row, k))}
        assert full[got[i]] == pytest.approx(max(fits.values())) and got[i] in fits


def test_predict_proba(spark, net):
    full = joint(net)
    cases = spark.createDataFrame([("x", "u", "m", "p"), ("y", "w", "n", "q"), ("x", "u", "m", "?")], "a string, b string, c string, d string")
    for r in net.predict_proba(cases).collect():
        assert r["p"] == pytest.approx(full.get((r["a"], r["b"], r["c"], r["d"]), 0))
    logs = {r["d"]: r["log_p"] for r in net.predict_log_proba(cases).collect()}
    assert logs["?"] == float("-inf") and logs["p"] == pytest.approx(math.log(full[("x", "u", "m", "p")]))


def test_save_and_load(spark, net, rows, tmp_path):
    net.save(str(tmp_path / "net"))
    again = BeliefNetwork.load(spark, str(tmp_path / "net"))
    assert again.parents == net.parents and rows(again.tables()) == rows(net.tables())


def test_unseen_parents_renormalise(spark):
    df = spark.createDataFrame([("x", "u", "m"), ("y", "v", "n")], "a string, b string, c string")
    net = BeliefNetwork(("a", "c"), ("b", "c")).fit(df)
    assert net.mass().first()["z"] == pytest.approx(0.5)
    assert [r["p"] for r in net.predict_proba(df).collect()] == pytest.approx([0.5, 0.5])
