"""Sessions, splits, samples and guards over ``events``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from flowmine.operators import guards, sampling, sessions, splits
from flowmine.queries.common import (
    HALF_DAY, KEYED_SQL, SESSION_TABLE_SQL, SESSIONS_SQL, TIME_BLOCKS_SQL, event_split, query,
    sessions_of, with_key)
from flowmine.sources.views import EVENT_CLASSES, EVENT_FLOWS_SQL, event_flows

FLOW_ARGS = dict(session="session_id", ts="ts", label="label", row_id="row_id", classes=EVENT_CLASSES)

for _mode, _key in {
    "five_tuple": "least(src_port, dst_port) || '|' || greatest(src_port, dst_port) || '|' || protocol",
    "service_port": "least(src_port, dst_port) || '|' || protocol",
    "host_pair": None,
}.items():
    _tail = f" || '|' || {_key}" if _key else ""

    @query(f"session_key_{_mode}", f"""
WITH {EVENT_FLOWS_SQL}
SELECT row_id, least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip){_tail} AS skey FROM flows""")
    def _keys(spark, sf, mode=_mode):
        return with_key(event_flows(spark, sf), mode).select("row_id", "skey")


@query("session_timeout", f"WITH {SESSIONS_SQL} SELECT row_id, session_id FROM s")
def _timeout(spark, sf):
    return sessions_of(spark, sf).select("row_id", "session_id")


@query("session_timeout_missing_time", f"""
WITH {KEYED_SQL},
m AS (SELECT row_id, skey, CASE WHEN row_id % 7 <> 0 THEN us END AS us FROM keyed),
b AS (SELECT *, CASE WHEN row_number() OVER k = 1 OR (us - lag(us) OVER k) / 1e6 > 43200 THEN 1 ELSE 0 END AS brk
  FROM m WINDOW k AS (PARTITION BY skey ORDER BY us NULLS LAST, row_id))
SELECT row_id, skey || '#' || CAST(sum(brk) OVER (PARTITION BY skey ORDER BY us NULLS LAST, row_id) AS BIGINT) AS session_id
FROM b""")
def _timeout_missing(spark, sf):
    flows = with_key(event_flows(spark, sf)).withColumn("ts", F.when(F.col("row_id") % 7 != 0, F.col("ts")))
    return sessions.sessionize(flows, "skey", "ts", ["row_id"], HALF_DAY).select("row_id", "session_id")


def _capped_sql(new: str) -> str:
    return f"""
WITH {SESSIONS_SQL},
pos AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, row_id) - 1 AS p FROM s),
fl AS (SELECT *, CASE WHEN p = 0 OR {new} THEN 1 ELSE 0 END AS nw FROM pos)
SELECT row_id, skey || '#' || CAST(sum(nw) OVER (PARTITION BY skey ORDER BY us, row_id) AS BIGINT) AS session_id
FROM fl"""


@query("session_cap_block", _capped_sql("p % 3 = 0"))
def _cap_block(spark, sf):
    return sessions_of(spark, sf, replace(HALF_DAY, max_flows=3)).select("row_id", "session_id")


@query("session_cap_singleton", _capped_sql("p >= 3"))
def _cap_single(spark, sf):
    return sessions_of(spark, sf, replace(HALF_DAY, max_flows=3, cap_mode="singleton")).select(
        "row_id", "session_id")


@query("session_run_length", f"""
WITH {EVENT_FLOWS_SQL},
f AS (SELECT row_id, strftime(ts, '%Y-%m-%d') AS day, CAST(label AS VARCHAR) AS k FROM flows),
m AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL OR lag(k) OVER w <> k THEN 1 ELSE 0 END AS c
      FROM f WINDOW w AS (PARTITION BY day ORDER BY row_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY day ORDER BY row_id) AS run FROM m)
SELECT row_id, day || '|S' || CAST(run - 1 AS BIGINT) || '_' ||
  CAST((row_number() OVER (PARTITION BY day, run ORDER BY row_id) - 1) // 2 AS BIGINT) AS session_id FROM r""")
def _run_length(spark, sf):
    f = event_flows(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sessions.run_length_sessions(f, "day", "row_id", [F.col("label")], 2, 64).select(
        "row_id", "session_id")


@query("session_table", f"""
WITH {SESSION_TABLE_SQL}
SELECT session_id, start_us, end_us, n_flows, primary_class FROM st""")
def _table(spark, sf):
    return sessions.session_table(sessions_of(spark, sf), "session_id", "ts", "label", EVENT_CLASSES).drop(
        "n_own", "class_counts")


@query("session_quality", f"""
WITH {KEYED_SQL}, c AS (
  SELECT count(DISTINCT least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) || '|' ||
    least(src_port, dst_port) || '|' || greatest(src_port, dst_port) || '|' || protocol) AS sessions,
    count(*) AS flows FROM keyed)
SELECT sessions, flows, sessions > CAST(0.9 AS DOUBLE) * flows AS degenerate FROM c""")
def _quality(spark, sf):
    return sessions.session_quality(with_key(event_flows(spark, sf), "five_tuple"), "skey")


@query("time_blocked_split", f"WITH {TIME_BLOCKS_SQL} SELECT row_id, split, assign_group FROM rows_split")
def _tb(spark, sf):
    return event_split(spark, sf).select("row_id", "split", "assign_group")


@query("split_distribution", f"""
WITH {TIME_BLOCKS_SQL}
SELECT label AS class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'gap') AS gap, count(*) AS total
FROM rows_split GROUP BY label""")
def _dist(spark, sf):
    from flowmine.operators.reports import split_distribution
    return split_distribution(event_split(spark, sf), "label", EVENT_CLASSES)


@query("boundary_report", f"""
WITH {TIME_BLOCKS_SQL},
n AS (SELECT label, count(*) AS n_flows FROM s GROUP BY label)
SELECT p.primary_class AS class, any_value(n.n_flows) AS n_flows, count(*) AS n_units,
  max(end_us) FILTER (split = 'train') AS train_end_us, max(end_us) FILTER (split = 'val') AS val_end_us,
  max(end_us) FILTER (split = 'test') AS test_end_us, round(any_value(gap) / 1e6, 3) AS gap_s,
  count(*) FILTER (split = 'gap') AS gap_units_dropped, false AS flow_level, '' AS absent_from
FROM placed p JOIN bounds USING (primary_class) JOIN n ON n.label = p.primary_class GROUP BY p.primary_class""")
def _bounds(spark, sf):
    s = sessions_of(spark, sf)
    blocks, st = splits.fit_time_blocks(s, "session_id", "ts", "label", "row_id", EVENT_CLASSES)
    return splits.boundary_report(splits.apply_time_blocks(s, st, blocks, "session_id", "ts"), blocks,
                                  "session_id", "ts")


# Fallback: one session per user, so no session lies inside a block and every
# class has to be cut row by row.
@query("time_block_fallback", f"""
WITH {EVENT_FLOWS_SQL},
s AS (SELECT *, 'u' || user_id AS session_id FROM flows),
ranks AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC,
    list_position(['view','click','signup','purchase','error'], label)) - 1 AS rk
  FROM s GROUP BY label),
own AS (SELECT session_id, arg_max(label, rk) AS cls FROM s JOIN ranks USING (label) GROUP BY session_id),
u AS (SELECT row_id, us, label, cls FROM s JOIN own USING (session_id)),
cum AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY us, row_id) AS c,
          count(*) OVER (PARTITION BY cls) AS total FROM u),
b AS (SELECT cls, min(us) FILTER (c >= greatest(1.0, total * CAST(0.7 AS DOUBLE))) AS t1,
        min(us) FILTER (c >= greatest(1.0, total * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)))) AS t2,
        (max(us) - min(us)) * CAST(0.005 AS DOUBLE) AS gap FROM cum GROUP BY cls)
SELECT row_id, CASE WHEN us <= t1 THEN 'train' WHEN us > t1 + gap AND us <= t2 THEN 'val'
  WHEN us > t2 + gap THEN 'test' ELSE 'gap' END AS split FROM u JOIN b USING (cls)""")
def _fallback(spark, sf):
    s = event_flows(spark, sf).withColumn("session_id", F.concat(F.lit("u"), F.col("user_id")))
    return splits.time_blocked_split(s, "session_id", "ts", "label", "row_id", EVENT_CLASSES).select(
        "row_id", "split")


@query("stratified_session_split", f"""
WITH {SESSION_TABLE_SQL},
o AS (SELECT *, md5('42:' || session_id) AS d FROM st),
c AS (SELECT *, coalesce(sum(n_flows) OVER (PARTITION BY primary_class ORDER BY d, session_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
        sum(n_flows) OVER (PARTITION BY primary_class) AS total FROM o)
SELECT s.row_id, CASE WHEN prev < total * CAST(0.7 AS DOUBLE) THEN 'train'
  WHEN prev < total * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM s JOIN c USING (session_id)""")
def _strat(spark, sf):
    return splits.stratified_session_split(
        sessions_of(spark, sf), "session_id", "ts", "label", EVENT_CLASSES).select("row_id", "split")


@query("stratified_flow_split", f"""
WITH {EVENT_FLOWS_SQL},
r AS (SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM flows)
SELECT row_id, CASE WHEN n < 3 OR rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN rn <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM r""")
def _strat_flow(spark, sf):
    return splits.stratified_flow_split(event_flows(spark, sf), "row_id", "label").select("row_id", "split")


_FAMILY_SQL = (TIME_BLOCKS_SQL
               .replace("\nranks AS (", "\nheld AS (SELECT DISTINCT session_id FROM s WHERE label = 'error'),\n"
                        "kept AS (SELECT * FROM s ANTI JOIN held USING (session_id)),\nranks AS (")
               .replace("FROM s GROUP BY label)", "FROM kept GROUP BY label)")
               .replace("FROM s JOIN ranks", "FROM kept JOIN ranks")
               .replace("FROM s JOIN placed", "FROM kept s JOIN placed"))


@query("leave_family_out_split", f"""
WITH {_FAMILY_SQL}
SELECT row_id, split FROM rows_split
UNION ALL SELECT row_id, 'test' FROM s SEMI JOIN held USING (session_id)""")
def _family(spark, sf):
    return splits.make_split(sessions_of(spark, sf), "leave_family_out", held_out="error",
                             **FLOW_ARGS).select("row_id", "split")


@query("session_subsample", f"""
WITH {SESSION_TABLE_SQL},
c AS (SELECT *, coalesce(sum(n_flows) OVER (PARTITION BY primary_class ORDER BY start_us, session_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
        greatest(40, floor(sum(n_flows) OVER (PARTITION BY primary_class) * CAST(0.05 AS DOUBLE))) AS target FROM st)
SELECT s.row_id, s.session_id FROM s JOIN c USING (session_id) WHERE prev < target""")
def _sub(spark, sf):
    return sampling.subsample_sessions(sessions_of(spark, sf), "session_id", "ts", "label", EVENT_CLASSES,
                                       0.05, 40).select("row_id", "session_id")


@query("stratified_allocation", f"""
WITH {EVENT_FLOWS_SQL},
n AS (SELECT label, count(*) AS n FROM flows GROUP BY label),
t AS (SELECT *, sum(n) OVER () AS tot FROM n),
a AS (SELECT *, least(greatest(least(n, 60), CAST(floor(n / tot * 200) AS BIGINT)), n) AS a0 FROM t),
o AS (SELECT *, greatest(sum(a0) OVER () - 200, 0) AS over_, greatest(a0 - 60, 0) AS room FROM a),
p AS (SELECT *, coalesce(sum(room) OVER (ORDER BY a0 DESC, label
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM o)
SELECT label, n, CAST(CASE WHEN tot <= 200 THEN n
  ELSE a0 - greatest(least(over_ - before_, room), 0) END AS BIGINT) AS alloc FROM p""")
def _alloc(spark, sf):
    return sampling.stratified_allocation(
        sampling.class_counts(event_flows(spark, sf), "label"), "label", 200, 60)


@query("stratified_sample", f"""
WITH {EVENT_FLOWS_SQL},
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS tot FROM flows)
SELECT row_id, label FROM r
WHERE rn <= CASE WHEN tot <= 500 THEN n ELSE greatest(least(n, 1), CAST(floor(n / tot * 500) AS BIGINT)) END""")
def _ssample(spark, sf):
    return sampling.stratified_sample(event_flows(spark, sf), "label", 500, 42, ["row_id"]).select(
        "row_id", "label")


@query("row_sample", f"""
WITH {EVENT_FLOWS_SQL} SELECT row_id FROM flows ORDER BY md5('7:' || row_id) LIMIT 700""")
def _rows(spark, sf):
    return sampling.sample_rows(event_flows(spark, sf), 700, 7, "row_id").select("row_id")


@query("majority_cap", f"""
WITH {EVENT_FLOWS_SQL},
c AS (SELECT label, count(*) AS n FROM flows GROUP BY label),
m AS (SELECT label FROM c ORDER BY n DESC, label LIMIT 1),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM flows)
SELECT row_id, label FROM r WHERE rn <= 300 OR label NOT IN (SELECT label FROM m)""")
def _cap(spark, sf):
    return sampling.cap_class(event_flows(spark, sf), "label", 300, 42, ["row_id"]).select("row_id", "label")


@query("train_holdout", f"""
WITH {TIME_BLOCKS_SQL},
r AS (SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM rows_split WHERE split = 'train')
SELECT row_id, rn <= floor(n * CAST(0.3 AS DOUBLE)) AS holdout FROM r""")
def _holdout(spark, sf):
    train = event_split(spark, sf).filter("split = 'train'")
    return sampling.holdout(train, "label", 0.3, 42, ["row_id"]).select("row_id", "holdout")


def _leaky(spark, sf):
    """Rows split at random (so sessions tear) plus a second copy of test rows as train."""
    f = splits.stratified_flow_split(sessions_of(spark, sf), "row_id", "label").withColumn(
        "assign_group", F.col("label"))
    return f.unionByName(f.filter("split = 'test'").withColumn("split", F.lit("train")))


_LEAKY_SQL = f"""
WITH {SESSIONS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM s),
p AS (SELECT *, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN rn <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM r),
d AS (SELECT * FROM p UNION ALL SELECT * REPLACE ('train' AS split) FROM p WHERE split = 'test')
"""


@query("guard_disjoint", _LEAKY_SQL + """, b AS (
  SELECT row_id FROM d GROUP BY row_id HAVING count(DISTINCT split) > 1)
SELECT 'splits_disjoint' AS guard, count(*) AS n, min(CAST(row_id AS VARCHAR)) AS example FROM b HAVING count(*) > 0""")
def _g1(spark, sf):
    return guards.disjoint(_leaky(spark, sf), "row_id")


@query("guard_sessions_whole", _LEAKY_SQL + """, b AS (
  SELECT session_id FROM d GROUP BY session_id HAVING count(DISTINCT split) > 1)
SELECT 'sessions_whole' AS guard, count(*) AS n, min(session_id) AS example FROM b HAVING count(*) > 0""")
def _g2(spark, sf):
    return guards.sessions_whole(_leaky(spark, sf), "session_id", exempt=None)


@query("guard_time_order", _LEAKY_SQL + """, g AS (
  SELECT label, max(us) FILTER (split = 'train') AS a, min(us) FILTER (split = 'val') AS b,
    max(us) FILTER (split = 'val') AS c, min(us) FILTER (split = 'test') AS e FROM d GROUP BY label)
SELECT 'time_ordering' AS guard, count(*) AS n, min(label) AS example FROM g
WHERE e < a OR b < a OR e < c HAVING count(*) > 0""")
def _g3(spark, sf):
    return guards.time_ordered(_leaky(spark, sf), "ts")


@query("guard_fitted_on_train", f"""
WITH {TIME_BLOCKS_SQL}
SELECT 'fit_on_train_only' AS guard, count(*) AS n, min(CAST(row_id AS VARCHAR)) AS example
FROM rows_split WHERE split <> 'train' HAVING count(*) > 0""")
def _g4(spark, sf):
    d = event_split(spark, sf)
    return guards.fitted_on_train(d.select("row_id"), d, "row_id")


@query("guard_not_resampled", f"""
WITH {TIME_BLOCKS_SQL}, c AS (
  SELECT count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') AS a FROM rows_split)
SELECT 'eval_not_resampled' AS guard, CAST(abs(a - b) AS BIGINT) AS n, b || '->' || a AS example
FROM c WHERE a <> b""")
def _g5(spark, sf):
    d = event_split(spark, sf)
    return guards.not_resampled(d.filter("split = 'val'"), d.filter("split = 'test'"))


_TORN = "b AS (SELECT session_id FROM d GROUP BY session_id HAVING count(DISTINCT split) > 1)"


@query("guard_report_of_a_leak", _LEAKY_SQL + f""",
a AS (SELECT row_id FROM d GROUP BY row_id HAVING count(DISTINCT split) > 1), {_TORN},
g AS (
  SELECT label, max(us) FILTER (split = 'train') AS a, min(us) FILTER (split = 'val') AS b,
    max(us) FILTER (split = 'val') AS c, min(us) FILTER (split = 'test') AS e FROM d GROUP BY label)
SELECT 'splits_disjoint' AS guard, count(*) AS n, min(CAST(row_id AS VARCHAR)) AS example FROM a HAVING count(*) > 0
UNION ALL SELECT 'sessions_whole', count(*), min(session_id) FROM b HAVING count(*) > 0
UNION ALL SELECT 'time_ordering', count(*), min(label) FROM g WHERE e < a OR b < a OR e < c HAVING count(*) > 0""")
def _g10(spark, sf):
    d = _leaky(spark, sf).withColumn("exempt", F.lit(False))
    return guards.split_guards(d, "row_id", "session_id", "ts")


@query("guard_report", f"""
WITH {TIME_BLOCKS_SQL}, b AS (
  SELECT session_id FROM rows_split GROUP BY session_id HAVING count(DISTINCT split) > 1)
SELECT 'sessions_whole' AS guard, count(*) AS n, min(session_id) AS example FROM b HAVING count(*) > 0""")
def _g9(spark, sf):
    return guards.split_guards(event_split(spark, sf), "row_id", "session_id", "ts")
