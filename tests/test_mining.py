import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowmine.functions.arrays import contains_in_order
from flowmine.operators import graph, temporal, windows


def seqs(spark, data):
    return spark.createDataFrame([(i, s) for i, s in enumerate(data)], "session_id int, events array<string>")


def test_itemsets(spark):
    t = temporal.frequent_itemsets(seqs(spark, [["a", "b"], ["a", "b"], ["a", "c"], ["d"]]), 0.5)
    assert {tuple(r["items"]): r["support"] for r in t.collect()} == {("a",): 0.75, ("b",): 0.5, ("a", "b"): 0.5}


def test_patterns(spark):
    t = temporal.frequent_patterns(seqs(spark, [list("abc"), list("abd"), list("abe"), list("xy")]), 0.6)
    assert {tuple(r["items"]) for r in t.collect()} == {("a",), ("b",), ("a", "b")}


def test_subsequence_and_support(spark):
    d = seqs(spark, [["a", "x", "b"], ["c"], ["z"]])
    got = d.select("session_id", temporal.pattern_support(F.col("events"), [(["a", "b"], 0.8), (["c"], 0.4)]).alias("sp"),
                   contains_in_order(F.col("events"), F.array(F.lit("b"), F.lit("a"))).alias("ba"),
                   contains_in_order(F.col("events"), F.array().cast("array<string>")).alias("none"))
    assert rows(got, "session_id") == [(0, 1.0, False, True), (1, 0.5, False, True), (2, 0.0, False, True)]


def test_transitions(spark):
    g = temporal.fit_transitions(seqs(spark, [["a", "b", "c"], ["a", "b"], ["q"]]), ["a", "z"])
    grid = g.grid()
    assert g.n_states == 5 and grid.count() == 25 and grid.filter("prob <= 0").count() == 0
    for r in grid.groupBy("src").agg(F.sum("prob").alias("p")).collect():
        assert r["p"] == pytest.approx(1.0)
    look = g.look_up(spark.createDataFrame([("a", "b"), ("a", "new"), ("new", "a")], "p string, n string"), "p", "n")
    got = {(r["p"], r["n"]): r["prob"] for r in look.collect()}
    assert got[("a", "b")] == pytest.approx(2.1 / 2.5) and got[("a", "new")] == got[("new", "a")] == 0.2
    none = temporal.fit_transitions(seqs(spark, [["a", "a", "b"]]), self_loops=False)
    assert rows(none.edges) == [("a", "b", 1)]
    tc = {r["session_id"]: r for r in temporal.path_consistency(seqs(spark, [["a"], ["a", "b"]]), "session_id", g).collect()}
    assert tc[0]["tc"] == 0.0 and tc[0]["availability"] == 0.0 and tc[1]["availability"] == 1.0


def test_windows_pad_and_do_not_cross(spark):
    d = spark.range(12).select("id", F.timestamp_seconds("id").alias("ts"),
                               F.when(F.col("id") < 7, "a").otherwise("b").alias("s"), F.col("id").cast("double").alias("x"))
    for slice_rows in (1, 3, 1000):
        w = windows.session_windows(d, "s", "ts", ["id"], ["x"], 4, slice_rows=slice_rows)
        got = {r["id"]: [v[0] for v in r["window"]] for r in w.collect()}
        assert len(got) == 12 and got[0] == [0, 0, 0, 0] and got[6] == [3, 4, 5, 6]
        assert got[7] == [0, 0, 0, 7] and got[9] == [0, 7, 8, 9]


def brute_edges(nodes, k, gap):
    out = set()
    for h in {n[1] for n in nodes}:
        ordered = sorted({(t, s) for s, hh, t in nodes if hh == h})
        for i, (t, s) in enumerate(ordered):
            out |= {(p, s) for tp, p in ordered[max(0, i - k):i] if t - tp <= gap}
    return out


def test_edges_match_a_loop(spark):
    data = [(f"s{i:02d}", f"h{i % 2}", (i * 37) % 100) for i in range(30)]
    d = spark.createDataFrame(data, "session_id string, host string, t long").withColumn("ts", F.timestamp_seconds("t"))
    e = graph.session_edges(d, "session_id", "ts", "host", 3, 20.0, 5)
    assert {(r["src"], r["dst"]) for r in e.collect()} == brute_edges(data, 3, 20)
    assert graph.limit_edges(e, 5, 5).count() == 5 and graph.limit_edges(e, 10**6, 5).count() == e.count()


def test_itemsets_equal_all_subsets_and_stop_at_their_length(spark):
    from itertools import combinations

    baskets = [["a", "b", "c"], ["b", "a"], ["a", "c", "a"], ["d"], ["a", "b", "c", "d", "e"], [], ["b", None], ["a", "b"]]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "session_id long, events array<string>")
    for support, longest in ((0.25, 4), (0.125, 3), (0.5, 2), (0.0, 1)):
        counts = {}
        for b in baskets:
            items = sorted({x for x in b if x is not None})
            for k in range(1, longest + 1):
                for s in combinations(items, k):
                    counts[s] = counts.get(s, 0) + 1
        least = max(1, math.ceil(support * len(baskets)))
        got = {tuple(r["items"]): (r["cnt"], r["support"]) for r in temporal.frequent_itemsets(d, support, longest).collect()}
        assert got == {s: (n, n / len(baskets)) for s, n in counts.items() if n >= least}
    clique = [f"e{i:02d}" for i in range(40)]
    d = spark.createDataFrame([(i, clique) for i in range(50)], "session_id long, events array<string>")
    assert temporal.frequent_itemsets(d, 0.5, 4).count() == 40 + 780 + 9880 + 91390
    assert temporal.frequent_itemsets(d.limit(0), 0.5, 4).count() == 0


def test_a_task_of_edges_holds_no_more_than_its_slice(spark):
    """A host is sliced well below a task's memory, and pairs are not gathered before their shuffle."""
    import inspect
    d = spark.range(50).select(F.col("id").cast("string").alias("s"), F.lit("h").alias("host"), F.timestamp_seconds("id").alias("ts"))
    assert inspect.signature(graph.session_edges).parameters["slice_rows"].default <= 250_000
    e = graph.session_edges(d, "s", "ts", "host", 3, 20.0)
    plan = e._jdf.queryExecution().sparkPlan().toString().splitlines()
    shuffle = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line or "Exchange hashpartitioning(src" in line)
    explode = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert shuffle < explode and not any("Aggregate" in line for line in plan[shuffle:explode])
    assert e.count() == 3 * 50 - 6


def test_propagation_shuffles_messages_twice_and_equals_matrices(spark):
    """Repeated and looping edges count once; both directions and two hops equal the matrix product."""
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("a", "d"), ("d", "a")]
    names, x = "abcde", np.arange(1.0, 6.0)
    nodes = spark.createDataFrame(list(zip(names, x.tolist())), "n string, v double")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for way in ("causal", "both"):
        m = np.eye(5)
        for a, b in pairs:
            m[names.index(b), names.index(a)] = 1
            if way == "both":
                m[names.index(a), names.index(b)] = 1
        deg = m.sum(1)
        w = m / np.sqrt(np.outer(deg, deg))
        out = graph.propagate(nodes, edges, "n", ["v"], 2, way)
        got = {r["n"]: r["v"] for r in out.collect()}
        assert [got[c] for c in names] == pytest.approx(list(w @ w @ x))
    one = graph.propagate(nodes, edges, "n", ["v"], 1)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_graph_features_travel_by_number(spark):
    """Numbered edges are the named ones, sliced or not, and features along them equal the matrix product."""
    from flowmine.operators.models import graph_features
    from flowmine.session import cut_lineage
    data = [(f"s{i % 20:02d}", f"h{i % 3}" if i % 5 else None, (i * 37) % 100 // 4, float(i)) for i in range(60)] + [(None, "h0", 1, 9.0)]
    d = spark.createDataFrame(data, "session_id string, host string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    nodes = graph.numbered(graph.session_nodes(d, "session_id", "ts", ["v"]), "session_id")
    names = {r["number"]: r["session_id"] for r in nodes.collect()}
    assert len(names) == 20 and None not in names.values()
    known = d.filter("session_id IS NOT NULL")
    want = {(r["src"], r["dst"]) for r in graph.session_edges(known, "session_id", "ts", "host", 4, 9.0).collect()}
    for rows in (5, 1000):
        e = graph.numbered_edges(d, nodes, "session_id", "host", 4, 9.0, slice_rows=rows)
        assert dict(e.dtypes) == {"src": "bigint", "dst": "bigint"}
        got = [(names[r["src"]], names[r["dst"]]) for r in e.collect()]
        assert set(got) == want and len(got) == len(want) > 20
    plan = graph.propagate(nodes, cut_lineage(e), "number", ["v"], 2, folded=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 3
    order = sorted(names.values())
    x = np.array([np.mean([v for s, _, _, v in data if s == n]) for n in order])
    m = np.eye(20)
    for a, b in want:
        m[order.index(b), order.index(a)] = 1
    w = m / np.sqrt(np.outer(m.sum(1), m.sum(1)))
    for budget in (None, 10**6):
        f = graph_features(d, ["v"], "session_id", "ts", "host", 2, 4, 9.0, budget)
        got = {r["session_id"]: r["features"].toArray().tolist() for r in f.collect()}
        assert [got[n] for n in order] == [pytest.approx(p) for p in zip(x, w @ w @ x)] and len(got) == 20


def test_lookups_read_staged_states_and_edges(spark):
    seqs = spark.createDataFrame([("u", ["a", "b", "a"]), ("v", ["b"])], "unit string, events array<string>")
    g = temporal.fit_transitions(seqs, ["a"])
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b", 1), ("b", "a", 1)] and g.n_states == 2
    for small in (g.edges, g.states):
        assert small.inputFiles() and all("/cut-" in f for f in small.inputFiles())
