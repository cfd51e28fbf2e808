"""Class weights and resampling over ``events`` with an uneven class mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmine.operators import imbalance
from flowmine.queries.common import query
from flowmine.settings import ImbalanceSettings
from flowmine.sources.views import EVENT_FLOWS_SQL, event_flows

# Classes from the value: most rows are class 0, the last class is tiny.
UNEVEN = "CASE WHEN value < 40 THEN 0 WHEN value < 100 THEN 1 WHEN value < 200 THEN 2 WHEN value < 350 THEN 3 ELSE 4 END"
SET = ImbalanceSettings(min_samples_for_smote=6, max_oversample_ratio=3)


def uneven(spark, sf):
    e = event_flows(spark, sf)
    return e.select("row_id", F.expr(UNEVEN).alias("y"), F.array(
        F.col("k") / 100.0, F.col("hour") / 24.0).alias("x"))


_U = f"""u AS (SELECT event_id AS row_id, CAST({UNEVEN} AS INTEGER) AS y FROM events),
c AS (SELECT y, count(*) AS n FROM u GROUP BY y)"""
_PLAN = f"""{_U},
g AS (SELECT y, n, CAST(least(max(n) OVER (), greatest(n, ceil(n * 3.0))) AS BIGINT) AS target, n >= 6 AS big FROM c),
pl AS (SELECT y, n, target, CAST(CASE WHEN big THEN least(5, n - 1) END AS INTEGER) AS k,
  CAST(greatest(1, least(5, min(CASE WHEN big THEN least(5, n - 1) END) OVER ())) AS INTEGER) AS k_eff,
  CASE WHEN big AND count(*) FILTER (big) OVER () >= 2 AND n < target THEN 'smote' WHEN NOT big AND n < target THEN 'random_oversample' ELSE 'none' END AS method FROM g)"""


@query("class_weights", f"""
WITH {_U}, g AS (SELECT CAST(i AS INTEGER) AS y, coalesce(n, 0) AS n FROM range(6) t(i) LEFT JOIN c ON c.y = i)
SELECT y, n, round(CASE WHEN n > 0 THEN sum(n) OVER () / (6 * n) ELSE 0 END, 6) AS weight FROM g""")
def _weights(spark, sf):
    return imbalance.class_weights(uneven(spark, sf), "y", list(range(6))).withColumn("weight", F.round("weight", 6))


@query("row_weights", f"""
WITH {_U}, w AS (SELECT y, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c)
SELECT row_id, round(coalesce(CASE WHEN y <> 2 THEN w END, 1), 6) AS weight FROM u JOIN w USING (y)""")
def _rweights(spark, sf):
    d = uneven(spark, sf)
    return imbalance.row_weights(d, "y", imbalance.class_weights(d, "y").filter("y <> 2")).select(
        "row_id", F.round("weight", 6).alias("weight"))


@query("oversampling_plan", f"WITH {_PLAN} SELECT y, n, target, k, k_eff, method FROM pl")
def _plan(spark, sf):
    return imbalance.oversampling_plan(uneven(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", SET)


@query("random_oversample", f"""
WITH {_PLAN},
r AS (SELECT u.*, n, target, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rn FROM u JOIN pl USING (y)
  WHERE n < target)
SELECT row_id || '+' || copy AS row_id, y FROM (
  SELECT row_id, y, unnest(generate_series(1, CAST((target - n) // n + CASE WHEN rn <= (target - n) % n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM r)""")
def _random(spark, sf):
    d = uneven(spark, sf)
    plan = imbalance.oversampling_plan(d.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", SET).withColumn(
        "method", F.when(F.col("n") < F.col("target"), "random_oversample").otherwise("none"))
    return imbalance.random_oversample(d, "y", "row_id", plan).select("row_id", "y")


@query("smote_counts", f"""
WITH {_PLAN} SELECT y, target - n AS n_new FROM pl WHERE method = 'smote'""")
def _smote(spark, sf):
    d = uneven(spark, sf).withColumn("row_id", F.col("row_id").cast("string"))
    plan = imbalance.oversampling_plan(d.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", SET)
    return imbalance.smote(d, "y", "row_id", "x", plan, 5).groupBy("y").agg(F.count(F.lit(1)).alias("n_new"))


@query("edited_neighbours", f"""
WITH {EVENT_FLOWS_SQL},
u AS (SELECT row_id, CAST({UNEVEN} AS INTEGER) AS y, k / 100.0::DOUBLE AS a, hour / 24.0::DOUBLE AS b,
  row_number() OVER (ORDER BY CAST(row_id AS VARCHAR)) AS at FROM flows),
near AS (
  SELECT p.row_id, p.y, min_by(q.y, {{'d': sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), 'at': q.at}}, 3) AS ys
  FROM u p JOIN u q ON p.row_id <> q.row_id GROUP BY p.row_id, p.y),
least AS (SELECT y FROM u GROUP BY y ORDER BY count(*), y LIMIT 1)
SELECT CAST(row_id AS VARCHAR) AS row_id, y FROM near WHERE y = (SELECT y FROM least) OR len(list_filter(ys, lambda v: v <> y)) = 0""")
def _enn(spark, sf):
    d = uneven(spark, sf).withColumn("row_id", F.col("row_id").cast("string"))
    return imbalance.edited_neighbours(d, "y", "row_id", "x").select("row_id", "y")


@query("restore_lost_classes", f"WITH {_U} SELECT row_id, y FROM u WHERE y IN (3, 4)")
def _restore(spark, sf):
    d = uneven(spark, sf).drop("x")
    return imbalance.restore_lost(d, d.filter("y < 3"), "y").select("row_id", "y")


@query("resample_report", f"""
WITH {_PLAN} SELECT y, n AS before, CASE WHEN y < 3 THEN n ELSE 0 END AS after, CASE WHEN y >= 3 THEN n ELSE 0 END AS restored,
  method, k, target FROM pl""")
def _report(spark, sf):
    d = uneven(spark, sf)
    plan = imbalance.oversampling_plan(d.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y", SET)
    return imbalance.resample_report(d, d.filter("y < 3"), plan, d.filter("y >= 3"), "y")


@query("smote_enn_report")
def _full(spark, sf):
    return imbalance.smote_enn(uneven(spark, sf), "y", "row_id", "x", SET).report
