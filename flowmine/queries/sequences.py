"""Windows, sequences, patterns, transitions and the session graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmine.functions.arrays import contains_in_order
from flowmine.operators import graph, temporal, windows
from flowmine.queries.common import SESSIONS_SQL, query, sessions_of
from flowmine.session import cut_lineage
from flowmine.sources.files import observed_edges

STATES = ["view", "click", "login"]


def seqs_of(spark, sf, max_len=50):
    return windows.event_sequences(sessions_of(spark, sf), "session_id", "ts", ["row_id"], F.col("label"), max_len)


_WINDOW_SQL = f"""
WITH {SESSIONS_SQL},
w AS (SELECT row_id, list(CAST(k AS INTEGER)) OVER x AS a, list(CAST(hour AS INTEGER)) OVER x AS b, label
  FROM s WINDOW x AS (PARTITION BY session_id ORDER BY us, row_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT row_id, label, repeat('0:0,', CAST(4 - len(a) AS BIGINT)) ||
  array_to_string([a[i] || ':' || b[i] for i in generate_series(1, len(a))], ',') AS win FROM w"""


@query("session_windows", _WINDOW_SQL)
def _windows(spark, sf):
    w = windows.session_windows(sessions_of(spark, sf), "session_id", "ts", ["row_id"], ["k", "hour"], 4)
    return w.select("row_id", "label", F.array_join(F.transform(
        "window", lambda r: F.concat_ws(":", r[0].cast("int").cast("string"), r[1].cast("int").cast("string"))),
        ",").alias("win"))


@query("previous_state", f"""
WITH {SESSIONS_SQL}
SELECT row_id, lag(label) OVER (PARTITION BY session_id ORDER BY us, row_id) AS prev_state FROM s""")
def _prev(spark, sf):
    return windows.previous_state(sessions_of(spark, sf), "session_id", "ts", ["row_id"], F.col("label")).select(
        "row_id", "prev_state")


@query("event_sequences", f"""
WITH {SESSIONS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, row_id DESC) AS rk FROM s)
SELECT session_id, string_agg(label, '>' ORDER BY us, row_id) AS events FROM r WHERE rk <= 3 GROUP BY session_id""")
def _seq(spark, sf):
    return seqs_of(spark, sf, 3).select("session_id", F.array_join("events", ">").alias("events"))


@query("host_sequences", """
SELECT 'u' || user_id AS host, string_agg(event_type, '>' ORDER BY ts, event_id) AS events FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events)
WHERE rk <= 50 GROUP BY user_id""")
def _hseq(spark, sf):
    from flowmine.sources.views import event_flows
    f = event_flows(spark, sf).withColumn("host", F.concat(F.lit("u"), F.col("user_id")))
    return windows.event_sequences(f, "host", "ts", ["row_id"], F.col("label"), 50).select(
        "host", F.array_join("events", ">").alias("events"))


_SEQ_SQL = SESSIONS_SQL + """,
ev AS (SELECT session_id, label AS e, row_number() OVER (PARTITION BY session_id ORDER BY us, row_id) AS pos FROM s),
d AS (SELECT DISTINCT session_id, e FROM ev),
tot AS (SELECT count(DISTINCT session_id) AS n FROM ev)
"""


@query("frequent_itemsets", f"""
WITH {_SEQ_SQL},
i AS (
  SELECT e AS items, 1 AS length, count(*) AS cnt FROM d GROUP BY e
  UNION ALL SELECT a.e || ',' || b.e, 2, count(*) FROM d a JOIN d b ON a.session_id = b.session_id AND a.e < b.e GROUP BY a.e, b.e
  UNION ALL SELECT a.e || ',' || b.e || ',' || c.e, 3, count(*) FROM d a JOIN d b ON a.session_id = b.session_id AND a.e < b.e
    JOIN d c ON c.session_id = b.session_id AND b.e < c.e GROUP BY a.e, b.e, c.e
  UNION ALL SELECT a.e || ',' || b.e || ',' || c.e || ',' || g.e, 4, count(*) FROM d a JOIN d b ON a.session_id = b.session_id AND a.e < b.e
    JOIN d c ON c.session_id = b.session_id AND b.e < c.e JOIN d g ON g.session_id = c.session_id AND c.e < g.e GROUP BY a.e, b.e, c.e, g.e)
SELECT items, cnt, round(cnt / n, 6) AS support FROM i, tot WHERE cnt >= ceil(0.002 * n)""")
def _items(spark, sf):
    return temporal.frequent_itemsets(seqs_of(spark, sf), 0.002, 4).select(
        F.array_join("items", ",").alias("items"), "cnt", F.round("support", 6).alias("support"))


_PATTERN_SQL = _SEQ_SQL + """,
p1 AS (SELECT DISTINCT session_id, e AS pattern, pos AS last FROM ev),
p2 AS (SELECT DISTINCT p.session_id, p.pattern || ' -> ' || ev.e AS pattern, ev.pos AS last FROM p1 p JOIN ev ON ev.session_id = p.session_id AND ev.pos > p.last),
p3 AS (SELECT DISTINCT p.session_id, p.pattern || ' -> ' || ev.e AS pattern, ev.pos AS last FROM p2 p JOIN ev ON ev.session_id = p.session_id AND ev.pos > p.last),
p4 AS (SELECT DISTINCT p.session_id, p.pattern || ' -> ' || ev.e AS pattern, ev.pos AS last FROM p3 p JOIN ev ON ev.session_id = p.session_id AND ev.pos > p.last),
p5 AS (SELECT DISTINCT p.session_id, p.pattern || ' -> ' || ev.e AS pattern, ev.pos AS last FROM p4 p JOIN ev ON ev.session_id = p.session_id AND ev.pos > p.last),
allp AS (SELECT session_id, pattern, 1 AS length FROM p1 UNION SELECT session_id, pattern, 2 FROM p2
  UNION SELECT session_id, pattern, 3 FROM p3 UNION SELECT session_id, pattern, 4 FROM p4 UNION SELECT session_id, pattern, 5 FROM p5),
pats AS (SELECT pattern, CAST(length AS INTEGER) AS length, count(*) AS cnt, count(*) / any_value(n) AS support
  FROM allp, tot GROUP BY pattern, length HAVING count(*) >= ceil(0.001 * any_value(n))
  ORDER BY cnt DESC, length, pattern LIMIT 60)
"""


@query("frequent_patterns", f"""
WITH {_PATTERN_SQL} SELECT pattern, length, cnt, round(support, 6) AS support FROM pats""")
def _patterns(spark, sf):
    return temporal.frequent_patterns(seqs_of(spark, sf), 0.001, 5, 60).select(
        "pattern", "length", "cnt", F.round("support", 6).alias("support"))


@query("subsequence_test", f"""
WITH {_SEQ_SQL}
SELECT t.session_id, EXISTS (SELECT 1 FROM ev a JOIN ev b ON a.session_id = b.session_id AND a.pos < b.pos
  WHERE a.session_id = t.session_id AND a.e = 'view' AND b.e = 'click') AS hit
FROM (SELECT DISTINCT session_id FROM ev) t""")
def _subseq(spark, sf):
    return seqs_of(spark, sf).select("session_id", contains_in_order(
        F.col("events"), F.array(F.lit("view"), F.lit("click"))).alias("hit"))


def _mined(seqs):
    rows = temporal.frequent_patterns(seqs, 0.001, 5, 60).collect()
    return [(list(r["items"]), float(r["support"])) for r in rows]


@query("pattern_support", f"""
WITH {_PATTERN_SQL}
SELECT t.session_id, round(least(1, coalesce(max(p.support), 0) / (SELECT max(support) FROM pats)), 6) AS sp
FROM (SELECT DISTINCT session_id FROM ev) t LEFT JOIN allp a USING (session_id) LEFT JOIN pats p USING (pattern)
GROUP BY t.session_id""")
def _sp(spark, sf):
    from flowmine.session import cut_lineage
    s = cut_lineage(seqs_of(spark, sf))
    return s.select("session_id", F.round(temporal.pattern_support(F.col("events"), _mined(s)), 6).alias("sp"))


_TRANS_SQL = _SEQ_SQL + """,
pr AS (SELECT a.session_id, a.e AS src, b.e AS dst FROM ev a JOIN ev b ON a.session_id = b.session_id AND b.pos = a.pos + 1),
ec AS (SELECT src, dst, count(*) AS cnt FROM pr GROUP BY src, dst),
sts AS (SELECT DISTINCT e AS state FROM ev UNION SELECT unnest(['view','click','login'])),
ns AS (SELECT count(*) AS n_states FROM sts),
grid AS (SELECT a.state AS src, b.state AS dst, coalesce(cnt, 0) AS cnt,
    (coalesce(cnt, 0) + CAST(0.1 AS DOUBLE)) / (coalesce(sum(cnt) OVER (PARTITION BY a.state), 0) + CAST(0.1 AS DOUBLE) * n_states) AS prob
  FROM sts a CROSS JOIN sts b CROSS JOIN ns LEFT JOIN ec ON ec.src = a.state AND ec.dst = b.state)
"""


@query("transition_graph", f"""
WITH {_TRANS_SQL} SELECT src, dst, cnt, round(prob, 6) AS prob FROM grid""")
def _graph(spark, sf):
    return temporal.fit_transitions(seqs_of(spark, sf), STATES).grid().withColumn("prob", F.round("prob", 6))


@query("transition_edges", f"""
WITH {_TRANS_SQL} SELECT src, dst, cnt, round(prob, 5) AS weight FROM grid WHERE cnt > 0 AND prob > 0.15""")
def _edges(spark, sf):
    return observed_edges(temporal.fit_transitions(seqs_of(spark, sf), STATES).observed(), 0.15)


@query("transition_lookup", f"""
WITH {_TRANS_SQL},
pv AS (SELECT row_id, coalesce(lag(label) OVER (PARTITION BY session_id ORDER BY us, row_id), 'start') AS a, label AS b FROM s)
SELECT row_id, round(coalesce(prob, 1.0 / n_states), 6) AS prob
FROM pv CROSS JOIN ns LEFT JOIN grid ON a = src AND b = dst""")
def _lookup(spark, sf):
    g = temporal.fit_transitions(seqs_of(spark, sf), STATES)
    p = windows.previous_state(sessions_of(spark, sf), "session_id", "ts", ["row_id"], F.col("label"), "a")
    p = p.select("row_id", F.coalesce("a", F.lit("start")).alias("a"), F.col("label").alias("b"))
    return g.look_up(p, "a", "b").select("row_id", F.round("prob", 6).alias("prob"))


@query("path_consistency", f"""
WITH {_TRANS_SQL},
m AS (SELECT session_id, avg(prob) AS mean FROM pr JOIN grid USING (src, dst) GROUP BY session_id)
SELECT t.session_id, round(CASE WHEN mean IS NULL THEN 0 ELSE least(mean * n_states, 1) END, 6) AS tc,
  CASE WHEN c >= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS availability
FROM (SELECT session_id, count(*) AS c FROM ev GROUP BY session_id) t CROSS JOIN ns LEFT JOIN m USING (session_id)""")
def _tc(spark, sf):
    s = seqs_of(spark, sf)
    return temporal.path_consistency(s, "session_id", temporal.fit_transitions(s, STATES)).withColumn(
        "tc", F.round("tc", 6))


EVIDENCE_SQL = _PATTERN_SQL.replace("WITH ", "") + _TRANS_SQL[len(_SEQ_SQL):] + """,
tcs AS (SELECT t.session_id, CASE WHEN mean IS NULL THEN 0 ELSE least(mean * n_states, 1) END AS tc,
    CASE WHEN c >= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS availability
  FROM (SELECT session_id, count(*) AS c FROM ev GROUP BY session_id) t CROSS JOIN ns
  LEFT JOIN (SELECT session_id, avg(prob) AS mean FROM pr JOIN grid USING (src, dst) GROUP BY session_id) m USING (session_id)),
sps AS (SELECT t.session_id, least(1, coalesce(max(p.support), 0) / (SELECT max(support) FROM pats)) AS sp
  FROM (SELECT DISTINCT session_id FROM ev) t LEFT JOIN allp a USING (session_id) LEFT JOIN pats p USING (pattern) GROUP BY t.session_id)
"""


@query("temporal_evidence", f"""
WITH {EVIDENCE_SQL}
SELECT row_id, round(sp, 6) AS sp, round(tc, 6) AS tc, availability
FROM s JOIN sps USING (session_id) JOIN tcs USING (session_id)""")
def _evidence(spark, sf):
    from flowmine.session import cut_lineage
    s = sessions_of(spark, sf)
    q = cut_lineage(windows.event_sequences(s, "session_id", "ts", ["row_id"], F.col("label"), 50))
    out = temporal.attach_evidence(s, "session_id", q, _mined(q), temporal.fit_transitions(q, STATES))
    return out.select("row_id", F.round("sp", 6).alias("sp"), F.round("tc", 6).alias("tc"), "availability")


@query("evidence_histogram", f"""
WITH {EVIDENCE_SQL},
r AS (SELECT coalesce(mean, 0) AS tc, availability FROM s JOIN tcs USING (session_id)
  LEFT JOIN (SELECT session_id, avg(prob) AS mean FROM pr JOIN grid USING (src, dst) GROUP BY session_id) USING (session_id))
SELECT CAST(least(floor(tc * 30), 29) AS INTEGER) AS bin, count(*) AS n, round(avg(availability), 6) AS available FROM r GROUP BY 1""")
def _hist(spark, sf):
    from flowmine.operators.reports import histogram
    s = sessions_of(spark, sf)
    q = windows.event_sequences(s, "session_id", "ts", ["row_id"], F.col("label"), 50)
    tc = temporal.path_consistency(q, "session_id", temporal.fit_transitions(q, STATES), scale="none")
    rows = s.select("session_id").join(tc, "session_id")
    return histogram(rows, "tc", 30, F.round(F.avg("availability"), 6).alias("available"))


_NODE_SQL = SESSIONS_SQL + """,
nodes AS (SELECT session_id, min(us) AS t0, avg(value) AS value, avg(k) AS k FROM s GROUP BY session_id),
mv AS (SELECT session_id, label, count(*) AS n, min(us) AS t FROM s GROUP BY session_id, label),
maj AS (SELECT session_id, arg_min(label, (-n, t, label)) AS node_label FROM mv GROUP BY session_id)
"""


@query("session_nodes", f"""
WITH {_NODE_SQL}
SELECT session_id, t0, round(value, 6) AS value, round(k, 6) AS k, node_label FROM nodes JOIN maj USING (session_id)""")
def _nodes(spark, sf):
    n = graph.session_nodes(sessions_of(spark, sf), "session_id", "ts", ["value", "k"], "label")
    return n.withColumn("value", F.round("value", 6)).withColumn("k", F.round("k", 6))


# Hosts are the source addresses; a third of the rows shares one of three servers.
_EDGE_SQL = _NODE_SQL + """,
seen AS (SELECT DISTINCT src_ip AS host, session_id FROM s),
rk AS (SELECT host, session_id, t0, row_number() OVER (PARTITION BY host ORDER BY t0, session_id) AS pos
  FROM seen JOIN nodes USING (session_id)),
edges AS (SELECT DISTINCT a.session_id AS src, b.session_id AS dst, b.t0 AS t_dst
  FROM rk a JOIN rk b ON a.host = b.host AND a.pos >= b.pos - 5 AND a.pos < b.pos WHERE (b.t0 - a.t0) / 1e6 <= 7200)
"""


def edges_of(spark, sf):
    return graph.session_edges(sessions_of(spark, sf), "session_id", "ts", "src_ip", 5, 7200.0)


@query("session_edges", f"WITH {_EDGE_SQL} SELECT src, dst, t_dst FROM edges")
def _sedges(spark, sf):
    return edges_of(spark, sf)


@query("edge_budget", f"WITH {_EDGE_SQL} SELECT src, dst FROM edges ORDER BY t_dst, src, dst LIMIT 1000")
def _budget(spark, sf):
    return graph.limit_edges(edges_of(spark, sf), 1000).select("src", "dst")


def _prop_sql(both: bool, hops: int) -> str:
    back = "UNION SELECT dst, src FROM edges" if both else ""
    step = "".join(f""",
h{i} AS (SELECT dst AS session_id, sum(w * value) AS value, sum(w * k) AS k FROM wt JOIN {'nodes' if i == 1 else f'h{i - 1}'} h
  ON h.session_id = wt.src GROUP BY dst)""" for i in range(1, hops + 1))
    return f"""
WITH {_EDGE_SQL},
m AS (SELECT src, dst FROM edges UNION SELECT session_id, session_id FROM nodes {back}),
dg AS (SELECT dst, count(*) AS deg FROM m GROUP BY dst),
wt AS (SELECT m.src, m.dst, 1.0 / sqrt(a.deg * b.deg) AS w FROM m JOIN dg a ON a.dst = m.dst JOIN dg b ON b.dst = m.src){step}
SELECT session_id, round(value / 3, 6) AS value, round(k / 3, 6) AS k FROM h{hops}"""


for _dir, _hops in (("both", 1), ("causal", 2)):
    @query(f"graph_propagation_{_dir}", _prop_sql(_dir == "both", _hops))
    def _prop(spark, sf, direction=_dir, hops=_hops):
        s = cut_lineage(sessions_of(spark, sf).select("session_id", "ts", "src_ip", "value", "k"))
        nodes = graph.session_nodes(s, "session_id", "ts", ["value", "k"])
        edges = graph.session_edges(s, "session_id", "ts", "src_ip", 5, 7200.0)
        h = graph.propagate(nodes, edges, "session_id", ["value", "k"], hops, direction)
        return h.select("session_id", F.round(F.col("value") / 3, 6).alias("value"),
                        F.round(F.col("k") / 3, 6).alias("k"))


@query("node_to_rows", f"""
WITH {_NODE_SQL} SELECT row_id, node_label, round(nodes.value, 6) AS mean_value
FROM s JOIN nodes USING (session_id) JOIN maj USING (session_id)""")
def _rows(spark, sf):
    s = sessions_of(spark, sf)
    n = graph.session_nodes(s, "session_id", "ts", ["value"], "label").select(
        "session_id", "node_label", F.round("value", 6).alias("mean_value"))
    return graph.to_rows(s, n, "session_id").select("row_id", "node_label", "mean_value")
