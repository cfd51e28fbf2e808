"""Metrics, calibration and fusion over three integer-made scorers on events."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from flowmine.functions import arrays
from flowmine.operators import fusion, guards, isotonic, metrics, reports, temporal, windows
from flowmine.queries.common import query
from flowmine.session import cut_lineage
from flowmine.sources.views import EVENT_CLASSES, event_flows

MODELS = {"alpha": (7, 13, 3, 14), "beta": (11, 5, 1, 9), "gamma": (3, 8, 6, 5)}
N = len(EVENT_CLASSES)
RARE = ["error", "purchase"]


def scores(spark, sf):
    """One probability array per scorer; integers, so equal in every engine."""
    e = event_flows(spark, sf)
    y = F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("label")).cast("int") - 1
    cols = []
    for m, (a, b, d, boost) in MODELS.items():
        w = F.array(*[((F.col("row_id") * a + c * b + d) % 17 + 1
                       + F.when(F.col("y") == c, boost).otherwise(0)).cast("double") for c in range(N)])
        cols.append(w.alias(f"w_{m}"))
    base = e.select("row_id", "ts", "us", "user_id", "label", "k", "hour", "value", y.alias("y"))
    raw = base.select("*", *cols)
    return raw.select(*base.columns, *[arrays.share_of_sum(F.col(f"w_{m}")).alias(f"p_{m}") for m in MODELS])


def _w(m):
    a, b, d, boost = MODELS[m]
    return (f"[CAST((row_id * {a} + c * {b} + {d}) % 17 + 1 + (CASE WHEN y = c THEN {boost} ELSE 0 END) AS DOUBLE) "
            f"FOR c IN [0,1,2,3,4]]")


SCORES_SQL = f"""
e AS (SELECT event_id AS row_id, epoch_us(ts) AS us, ts, user_id, event_type AS label, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS hour,
    CAST(list_position(['view','click','signup','purchase','error'], event_type) - 1 AS INTEGER) AS y FROM events),
w AS (SELECT *, {', '.join(f'{_w(m)} AS w_{m}' for m in MODELS)} FROM e),
sc AS (SELECT row_id, us, ts, user_id, label, value, k, hour, y,
    {', '.join(f'[x / list_sum(w_{m}) FOR x IN w_{m}] AS p_{m}' for m in MODELS)} FROM w),
lg AS ({' UNION ALL '.join(f"SELECT row_id, us, y, '{m}' AS model, p_{m} AS p FROM sc" for m in MODELS)}),
pr AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred FROM lg)
"""


def f1_tables(src: str, keys: str) -> str:
    """CTEs ``pc`` (per class) and ``sm`` (summary) from rows (keys, y, pred)."""
    return f""",
sd AS (SELECT {keys}, y AS cls, 1 AS s, 0 AS p, CASE WHEN y = pred THEN 1 ELSE 0 END AS t FROM {src}
  UNION ALL SELECT {keys}, pred, 0, 1, 0 FROM {src}),
pc AS (SELECT {keys}, cls, sum(s) AS support, sum(t) AS hits,
    CASE WHEN sum(p) > 0 THEN sum(t) / sum(p) ELSE 0 END AS prec,
    CASE WHEN sum(s) > 0 THEN sum(t) / sum(s) ELSE 0 END AS rec, 2.0 * sum(t) / sum(s + p) AS f1 FROM sd GROUP BY {keys}, cls),
sm AS (SELECT {keys}, CAST(sum(support) AS BIGINT) AS n_samples, sum(hits) / sum(support) AS accuracy, avg(prec) AS precision_macro,
    avg(rec) AS recall_macro, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
    sum(prec * support) / sum(support) AS precision_weighted, sum(rec * support) / sum(support) AS recall_weighted
  FROM pc GROUP BY {keys})
"""


METRICS = ["accuracy", "precision_macro", "recall_macro", "macro_f1", "weighted_f1", "precision_weighted",
           "recall_weighted"]


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def long_scores(spark, sf):
    s = scores(spark, sf)
    x = s.select("row_id", "us", "y", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in MODELS])).alias("x"))
    return x.select("row_id", "us", "y", "x.model", "x.p").withColumn("pred", arrays.argmax(F.col("p")))


@query("argmax_prediction", f"WITH {SCORES_SQL} SELECT row_id, model, pred FROM pr")
def _argmax(spark, sf):
    return long_scores(spark, sf).select("row_id", "model", "pred")


@query("class_alignment", f"""
WITH {SCORES_SQL},
a AS (SELECT row_id, [p_alpha[1], 0, p_alpha[3], 0, p_alpha[4]] AS v FROM sc)
SELECT row_id, {', '.join(f'round(v[{i + 1}] / list_sum(v), 6) AS c{i}' for i in range(5))} FROM a""")
def _align(spark, sf):
    s = scores(spark, sf).withColumn("sub", F.array(*[F.get("p_alpha", F.lit(i)) for i in (0, 2, 3)]))
    s = s.withColumn("v", arrays.align_classes(F.col("sub"), [0, 2, 4], 5))
    return s.select("row_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"c{i}") for i in range(5)])


@query("confusion_matrix", f"""
WITH {SCORES_SQL},
c AS (SELECT y, pred, count(*) AS n FROM pr WHERE model = 'beta' GROUP BY y, pred),
g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS pred FROM range(5) t(a), range(5) u(b))
SELECT y, pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY y), 1), 6) AS share
FROM g LEFT JOIN c USING (y, pred)""")
def _conf(spark, sf):
    c = metrics.confusion(long_scores(spark, sf).filter("model = 'beta'"), "y", "pred")
    return rounded(metrics.confusion_grid(c, N), "share")


@query("classification_scores", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}
SELECT model, n_samples, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM sm""")
def _scores(spark, sf):
    c = metrics.confusion(long_scores(spark, sf), "y", "pred", ["model"])
    return rounded(metrics.summary_scores(c, ["model"]), *METRICS)


@query("per_class_report", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}
SELECT model, ['view','click','signup','purchase','error'][cls + 1] AS class, CAST(support AS BIGINT) AS support,
  round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, cls IN (3, 4) AS is_rare FROM pc""")
def _report(spark, sf):
    c = metrics.confusion(long_scores(spark, sf), "y", "pred", ["model"])
    return rounded(metrics.class_report(c, EVENT_CLASSES, RARE, ["model"]), "precision", "recall", "f1")


@query("rare_class_recall", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}
SELECT model, round(avg(rec) FILTER (cls IN (3, 4) AND support > 0), 6) AS rare_class_recall_macro FROM pc GROUP BY model""")
def _rare(spark, sf):
    c = metrics.confusion(long_scores(spark, sf), "y", "pred", ["model"])
    return rounded(metrics.rare_recall(metrics.class_report(c, EVENT_CLASSES, RARE, ["model"]), ["model"]),
                   "rare_class_recall_macro")


_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 16)[1:-1]]
_BINS_SQL = f""",
cb AS (SELECT model, CAST({' + '.join(f'CAST(list_max(p) > CAST({e!r} AS DOUBLE) AS INTEGER)' for e in _EDGES)} AS INTEGER) AS bin,
    list_max(p) AS c, CASE WHEN pred = y THEN 1 ELSE 0 END AS ok FROM pr),
bins AS (SELECT model, bin, count(*) AS n, avg(c) AS confidence, avg(ok) AS accuracy FROM cb GROUP BY model, bin)
"""


@query("reliability_bins", f"""
WITH {SCORES_SQL}{_BINS_SQL}
SELECT model, bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins""")
def _bins(spark, sf):
    return rounded(metrics.confidence_bins(long_scores(spark, sf), "p", "y", 15, ["model"]),
                   "confidence", "accuracy")


@query("calibration_error", f"""
WITH {SCORES_SQL}{_BINS_SQL}
SELECT model, round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bins GROUP BY model""")
def _ece(spark, sf):
    return rounded(metrics.calibration_error(
        metrics.confidence_bins(long_scores(spark, sf), "p", "y", 15, ["model"]), ["model"]), "ece")


@query("brier_score", f"""
WITH {SCORES_SQL},
x AS (SELECT model, row_id, sum(pow(p[i] - CASE WHEN i - 1 = y THEN 1 ELSE 0 END, 2)) AS b FROM pr, range(1, 6) t(i) GROUP BY model, row_id)
SELECT model, round(avg(b), 6) AS brier FROM x GROUP BY model""")
def _brier(spark, sf):
    return rounded(metrics.brier(long_scores(spark, sf), "p", "y", ["model"]), "brier")


_AREA_SQL = """,
vc AS (SELECT model, CAST(i - 1 AS INTEGER) AS cls, p[i] AS score, count(*) FILTER (y = i - 1) AS pos,
    count(*) FILTER (y <> i - 1) AS neg FROM pr, range(1, 6) t(i) GROUP BY model, i, p[i]),
cm AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, cls) AS n_pos,
    sum(neg) OVER (PARTITION BY model, cls) AS n_neg FROM vc WINDOW w AS (PARTITION BY model, cls ORDER BY score DESC)),
ar AS (SELECT model, cls, sum((neg / n_neg) * ((tp - pos / 2.0) / n_pos)) AS roc_auc,
    sum((pos / n_pos) * (tp / (tp + fp))) AS pr_auc FROM cm GROUP BY model, cls)
"""


@query("ranking_areas", f"""
WITH {SCORES_SQL}{_AREA_SQL} SELECT model, cls, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM ar""")
def _areas(spark, sf):
    k = ["model"]
    return rounded(metrics.ranking_areas(metrics.score_counts(long_scores(spark, sf), "p", "y", k), k),
                   "roc_auc", "pr_auc")


@query("macro_areas", f"""
WITH {SCORES_SQL}{_AREA_SQL}
SELECT model, round(avg(roc_auc), 6) AS roc_auc_ovr_macro, round(avg(pr_auc), 6) AS pr_auc_macro FROM ar GROUP BY model""")
def _macro(spark, sf):
    k = ["model"]
    a = metrics.ranking_areas(metrics.score_counts(long_scores(spark, sf), "p", "y", k), k)
    return rounded(metrics.macro_areas(a, k), "roc_auc_ovr_macro", "pr_auc_macro")


@query("curve_points", f"""
WITH {SCORES_SQL}{_AREA_SQL}
SELECT model, cls, round(score, 9) AS score, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr,
  round(tp / (tp + fp), 6) AS precision FROM cm""")
def _curves(spark, sf):
    k = ["model"]
    p = metrics.roc_points(metrics.score_counts(long_scores(spark, sf), "p", "y", k), k)
    return rounded(p, "fpr", "tpr", "precision").withColumn("score", F.round("score", 9))


@query("seed_aggregation", f"""
WITH {SCORES_SQL}, ps AS (SELECT *, row_id % 3 AS seed FROM pr){f1_tables('ps', 'model, seed')}
SELECT model, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1,
  round(coalesce(stddev_samp(accuracy), 0), 6) AS accuracy_std, round(coalesce(stddev_samp(macro_f1), 0), 6) AS macro_f1_std,
  count(*) AS n_seeds FROM sm GROUP BY model""")
def _seeds(spark, sf):
    d = long_scores(spark, sf).withColumn("seed", F.col("row_id") % 3)
    k = ["model", "seed"]
    t = metrics.summary_scores(metrics.confusion(d, "y", "pred", k), k)
    out = metrics.aggregate_seeds(t, "model", ["accuracy", "macro_f1"])
    return rounded(out, "accuracy", "macro_f1", "accuracy_std", "macro_f1_std")


def wide_preds(spark, sf):
    s = scores(spark, sf)
    return s.select("row_id", "y", *[arrays.argmax(F.col(f"p_{m}")).alias(m) for m in MODELS])


@query("model_discordance", f"""
WITH {SCORES_SQL},
ok AS (SELECT row_id, model, y = pred AS ok FROM pr)
SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.ok AND NOT b.ok) AS n01, count(*) FILTER (NOT a.ok AND b.ok) AS n10
FROM ok a JOIN ok b ON a.row_id = b.row_id AND a.model < b.model GROUP BY a.model, b.model""")
def _disc(spark, sf):
    return metrics.discordance(wide_preds(spark, sf), "y", list(MODELS))


@query("mcnemar_comparison")
def _mcnemar(spark, sf):
    return metrics.compare_models(wide_preds(spark, sf), "y", list(MODELS))


@query("bootstrap_comparison")
def _boot(spark, sf):
    return metrics.compare_models(wide_preds(spark, sf), "y", list(MODELS), "bootstrap", iters=200)


@query("zero_day_scores", f"""
WITH {SCORES_SQL}
SELECT 'error' AS held_out_family, count(*) FILTER (y = 4) AS n_unseen,
  round(avg(CASE WHEN pred <> 0 THEN 1 ELSE 0 END) FILTER (y = 4), 6) AS unseen_detection_recall,
  count(*) FILTER (y = 0) AS n_benign, round(avg(CASE WHEN pred <> 0 THEN 1 ELSE 0 END) FILTER (y = 0), 6) AS false_alarm_rate
FROM pr WHERE model = 'gamma'""")
def _zero(spark, sf):
    d = long_scores(spark, sf).filter("model = 'gamma'")
    return rounded(metrics.zero_day(d, "y", "pred", 4, 0, "error"), "unseen_detection_recall", "false_alarm_rate")


@query("metric_table", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}{_BINS_SQL}{_AREA_SQL},
br AS (SELECT model, avg(b) AS brier FROM (SELECT model, row_id, sum(pow(p[i] - CASE WHEN i - 1 = y THEN 1 ELSE 0 END, 2)) AS b
  FROM pr, range(1, 6) t(i) GROUP BY model, row_id) GROUP BY model)
SELECT sm.model, n_samples, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, round(ece, 6) AS ece, round(brier, 6) AS brier,
  round(roc_auc_ovr_macro, 6) AS roc_auc_ovr_macro, round(pr_auc_macro, 6) AS pr_auc_macro, round(rr, 6) AS rare_class_recall_macro
FROM sm JOIN br USING (model)
JOIN (SELECT model, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM bins GROUP BY model) USING (model)
JOIN (SELECT model, avg(roc_auc) AS roc_auc_ovr_macro, avg(pr_auc) AS pr_auc_macro FROM ar GROUP BY model) USING (model)
JOIN (SELECT model, avg(rec) FILTER (cls IN (3, 4)) AS rr FROM pc GROUP BY model) USING (model)""")
def _table(spark, sf):
    t = metrics.evaluate(scores(spark, sf), list(MODELS), "y", EVENT_CLASSES, RARE)["metrics"]
    return rounded(t, *[c for c in t.columns if c not in ("model", "n_samples")])


# -- fusion --------------------------------------------------------------------
def fusion_rows(spark, sf):
    """Scores with context from user histories and two scalar evidence columns."""
    s = scores(spark, sf)
    seqs = windows.event_sequences(s, "user_id", "ts", ["row_id"], F.col("label"), 50)
    g = temporal.fit_transitions(seqs, EVENT_CLASSES)
    d = windows.previous_state(s, "user_id", "ts", ["row_id"], F.col("label"))
    d = fusion.add_context(d, g, EVENT_CLASSES)
    return cut_lineage(d.select("row_id", "ts", "y", "context", *[f"p_{m}" for m in MODELS],
                    (F.col("k") / 100.0).alias("sp"), (F.col("hour") / 24.0).alias("tc"),
                    F.when(F.col("row_id") % 4 == 0, 0.0).otherwise(1.0).alias("availability")))


CUT = "ts < timestamp '2024-01-20'"
CUT_SQL = "ts < TIMESTAMP '2024-01-20'"

FUSION_SQL = SCORES_SQL + """,
hist AS (SELECT user_id, label, us, row_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, row_id DESC) AS rk FROM sc),
nx AS (SELECT label AS src, lead(label) OVER (PARTITION BY user_id ORDER BY us, row_id) AS dst FROM hist WHERE rk <= 50),
ec AS (SELECT src, dst, count(*) AS cnt FROM nx WHERE dst IS NOT NULL GROUP BY src, dst),
st5 AS (SELECT unnest(['view','click','signup','purchase','error']) AS state),
gr AS (SELECT a.state AS src, b.state AS dst, (coalesce(cnt, 0) + CAST(0.1 AS DOUBLE)) /
    (coalesce(sum(cnt) OVER (PARTITION BY a.state), 0) + CAST(0.1 AS DOUBLE) * 5) AS prob
  FROM st5 a CROSS JOIN st5 b LEFT JOIN ec ON ec.src = a.state AND ec.dst = b.state),
ctx AS (SELECT src, list(prob ORDER BY list_position(['view','click','signup','purchase','error'], dst)) AS context FROM gr GROUP BY src),
pv AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY us, row_id) AS prev_state FROM sc),
fr AS (SELECT pv.*, coalesce(context, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[]) AS context, k / 100.0 AS sp, hour / 24.0 AS tc,
    CASE WHEN row_id % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS availability
  FROM pv LEFT JOIN ctx ON ctx.src = pv.prev_state),
""" + f"""
md AS ({' UNION ALL '.join(f"SELECT row_id, ts, y, context, sp, tc, availability, '{m}' AS model, {j} AS pos, p_{m} AS p FROM fr" for j, m in enumerate(MODELS))}),
mp AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
    1 + list_sum([greatest(x, 1e-12) * ln(greatest(x, 1e-12)) FOR x IN p]) / ln(CAST(5 AS DOUBLE)) AS conf FROM md)
"""
FUSION_SQL = FUSION_SQL.replace("k / 100.0 AS sp, hour / 24.0 AS tc", "k / CAST(100 AS DOUBLE) AS sp, hour / CAST(24 AS DOUBLE) AS tc")

QUALITY_SQL = f""",
vp AS (SELECT model, y, pred FROM mp WHERE {CUT_SQL}){f1_tables('vp', 'model')},
ev AS (SELECT 'sp' AS model, sp AS score, y FROM fr WHERE {CUT_SQL} UNION ALL SELECT 'tc', tc, y FROM fr WHERE {CUT_SQL}),
evc AS (SELECT model, score, count(*) FILTER (y <> 0) AS pos, count(*) FILTER (y = 0) AS neg FROM ev GROUP BY model, score),
evm AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY model) AS np,
    sum(neg) OVER (PARTITION BY model) AS nn FROM evc),
qual AS (SELECT model, macro_f1 AS q FROM sm
  UNION ALL SELECT model, sum((neg / nn) * ((tp - pos / 2.0) / np)) FROM evm GROUP BY model)
"""

L1, L2, L3 = 0.5, 0.3, 0.2


def weight_sql(l1="CAST(0.5 AS DOUBLE)", l2="CAST(0.3 AS DOUBLE)", l3="CAST(0.2 AS DOUBLE)", where="true", grid=""):
    """CTEs rel -> wt -> fs: reliabilities, weights, fused class sums and risk."""
    key = "row_id, g" if grid else "row_id"
    g = ", g" if grid else ""
    return f""",
rel AS (SELECT row_id{g}, y, model, pos, p, greatest({l1} * q + {l2} * conf + {l3} * (CASE WHEN {l3} > 0 THEN context[pred + 1] ELSE CAST(0.2 AS DOUBLE) END), 0) AS q,
    1 - p[1] AS score FROM mp JOIN qual USING (model){grid} WHERE {where}
  UNION ALL SELECT row_id{g}, y, model, CASE model WHEN 'sp' THEN 3 ELSE 4 END, NULL, q * availability, CASE model WHEN 'sp' THEN sp ELSE tc END
    FROM fr JOIN qual ON qual.model IN ('sp', 'tc'){grid} WHERE {where}),
wt AS (SELECT *, CASE WHEN sum(q) OVER (PARTITION BY {key}) > 1e-12 THEN q / sum(q) OVER (PARTITION BY {key}) ELSE CAST(0.2 AS DOUBLE) END AS wgt FROM rel),
fs AS (SELECT {key}, any_value(y) AS y, sum(wgt * score) AS risk, {', '.join(f'sum(wgt * p[{i + 1}]) AS f{i}' for i in range(5))} FROM wt GROUP BY {key}),
fz AS (SELECT *, [f0, f1, f2, f3, f4] AS fused FROM fs),
fp AS (SELECT *, CAST(list_position([round(x / list_sum(fused), 12) FOR x IN fused], list_max([round(x / list_sum(fused), 12) FOR x IN fused])) - 1 AS INTEGER) AS pred FROM fz)
"""


def fitted_fusion(rows, **kw):
    f = fusion.Fusion(list(MODELS), list(EVENT_CLASSES), 0, **kw)
    return f.fit_quality(rows.filter(CUT), "y")


@query("confidence_term", f"WITH {FUSION_SQL} SELECT row_id, model, round(conf, 6) AS confidence FROM mp")
def _confidence(spark, sf):
    d = long_scores(spark, sf)
    return d.select("row_id", "model", F.round(arrays.confidence(F.col("p"), N), 6).alias("confidence"))


@query("context_term", f"WITH {FUSION_SQL} SELECT row_id, model, round(context[pred + 1], 6) AS context FROM mp")
def _context(spark, sf):
    d = fusion_rows(spark, sf)
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(F.get(
        "context", arrays.argmax(F.col(f"p_{m}"))), 6).alias("context")) for m in MODELS]))
    return d.select("row_id", parts.alias("x")).select("row_id", "x.model", "x.context")


@query("context_label_graph", f"""
WITH {SCORES_SQL},
th AS (SELECT user_id, label, us, row_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, row_id DESC) AS rk FROM sc WHERE {CUT_SQL}),
tn AS (SELECT label AS src, lead(label) OVER (PARTITION BY user_id ORDER BY us, row_id) AS dst FROM th WHERE rk <= 50),
tc AS (SELECT src, dst, count(*) AS cnt FROM tn WHERE dst IS NOT NULL GROUP BY src, dst),
tt AS (SELECT src, sum(cnt) AS total FROM tc GROUP BY src),
nm AS (SELECT CAST(i - 1 AS INTEGER) AS code, ['view','click','signup','purchase','error'][i] AS name FROM range(1, 6) r(i)),
pp AS (SELECT row_id, model, pr.pred, lag(pr.pred) OVER (PARTITION BY user_id, model ORDER BY pr.us, row_id) AS before
  FROM pr JOIN (SELECT row_id, user_id FROM sc) USING (row_id))
SELECT row_id, model, round(CASE WHEN before IS NULL THEN 0.2 ELSE (coalesce(cnt, 0) + CAST(0.1 AS DOUBLE)) /
    (coalesce(total, 0) + CAST(0.1 AS DOUBLE) * 5) END, 6) AS k
FROM pp LEFT JOIN nm a ON a.code = before LEFT JOIN nm b ON b.code = pp.pred
LEFT JOIN tt ON tt.src = a.name LEFT JOIN tc ON tc.src = a.name AND tc.dst = b.name""")
def _label_context(spark, sf):
    s = scores(spark, sf)
    seqs = windows.event_sequences(s.filter(CUT), "user_id", "ts", ["row_id"], F.col("label"), 50)
    g = temporal.fit_transitions(seqs, EVENT_CLASSES)
    d = fusion.add_label_context(s, g, EVENT_CLASSES, list(MODELS), "user_id", "ts", ["row_id"])
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(f"k_{m}", 6).alias("k")) for m in MODELS]))
    return d.select("row_id", parts.alias("x")).select("row_id", "x.model", "x.k")


@query("baseline_quality", f"WITH {FUSION_SQL}{QUALITY_SQL} SELECT model AS source, round(q, 6) AS q FROM qual")
def _quality(spark, sf):
    f = fitted_fusion(fusion_rows(spark, sf))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in f.quality.items()], "source string, q double")


@query("fusion_reliabilities", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql()}
SELECT row_id, model AS source, round(q, 6) AS q, round(wgt, 6) AS w FROM wt""")
def _rel(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    z = f.fuse(d)
    names = F.array(*[F.lit(s) for s in f.sources])
    return z.select("row_id", F.explode(F.arrays_zip(names.alias("source"), F.col("q"), F.col("w"))).alias("x")).select(
        "row_id", "x.source", F.round("x.q", 6).alias("q"), F.round("x.w", 6).alias("w"))


@query("fused_risk", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql()}
SELECT row_id, round(risk, 6) AS risk, {', '.join(f'round(fused[{i + 1}] / list_sum(fused), 6) AS f{i}' for i in range(5))} FROM fp""")
def _fused(spark, sf):
    d = fusion_rows(spark, sf)
    z = fitted_fusion(d).fuse(d)
    return z.select("row_id", F.round("risk", 6).alias("risk"),
                    *[F.round(F.get("fused", F.lit(i)), 6).alias(f"f{i}") for i in range(N)])


_GRID = "(VALUES " + ", ".join(
    f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for i, (a, b, c) in enumerate(
        fusion.Fusion([], [], 0).lambda_grid(0.1))) + ") AS gg(g, la, lb, lc)"


@query("lambda_search", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql('la', 'lb', 'lc', CUT_SQL, ' CROSS JOIN ' + _GRID).replace('pc AS', 'pc AS')}
{f1_tables('fp', 'g').replace('sd AS', 'sd2 AS').replace('FROM sd ', 'FROM sd2 ').replace('pc AS', 'pc2 AS').replace('FROM pc ', 'FROM pc2 ').replace('sm AS', 'sm2 AS')}
SELECT CAST(g AS INTEGER) AS i, round(macro_f1, 4) AS macro_f1 FROM sm2""")
def _lambda(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    return f.lambda_scores(d.filter(CUT), "y").select("i", F.round("macro_f1", 4).alias("macro_f1"))


_TAUS = [float(x) for x in np.linspace(0.0, 1.0, 101)]


@query("alert_threshold", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql(where=CUT_SQL)},
tg AS (SELECT CAST(i - 1 AS INTEGER) AS i, t[i] AS tau FROM (SELECT {_TAUS!r}::DOUBLE[] AS t), range(1, 102) r(i)),
ct AS (SELECT i, tau, count(*) FILTER (risk >= tau AND y <> 0) AS tp, count(*) FILTER (risk >= tau AND y = 0) AS fp,
    count(*) FILTER (risk < tau AND y <> 0) AS fn, count(*) FILTER (risk < tau AND y = 0) AS tn FROM fp, tg GROUP BY i, tau)
SELECT i, round(tau, 6) AS tau, tp, fp, fn, tn, round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END
  + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END) /
  (CAST(2 * tp + fp + fn > 0 AS INTEGER) + CAST(2 * tn + fp + fn > 0 AS INTEGER)), 6) AS macro_f1, round(fp / (fp + tn), 6) AS far FROM ct""")
def _tau(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    return rounded(f.threshold_scores(f.fuse(d.filter(CUT)), "y"), "tau", "macro_f1", "far")


@query("explain_row", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql(where='row_id = 17')},
x AS (SELECT wt.model AS source, qual.q AS quality, conf AS confidence, wt.q AS q_rel, wgt AS w, score, wgt * score AS contribution
  FROM wt JOIN qual USING (model) LEFT JOIN (SELECT model, conf FROM mp WHERE row_id = 17) USING (model))
SELECT source, round(quality, 6) AS quality, round(confidence, 6) AS confidence, round(q_rel, 6) AS q, round(w, 6) AS w, round(score, 6) AS score,
  round(contribution, 6) AS contribution FROM x
UNION ALL SELECT 'TOTAL', NULL, NULL, NULL, round(sum(w), 6), NULL, round(sum(contribution), 6) FROM x""")
def _explain(spark, sf):
    d = fusion_rows(spark, sf)
    x = fitted_fusion(d).explain(d, "row_id", 17)
    return rounded(x, "quality", "confidence", "q", "w", "score", "contribution")


@query("fusion_weight_table", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql()}
SELECT row_id, {', '.join(f"round(max(wgt) FILTER (model = '{s}'), 6) AS w_{s}" for s in [*MODELS, 'sp', 'tc'])}, round(sum(wgt * score), 6) AS "R_t"
FROM wt GROUP BY row_id""")
def _wtable(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    t = f.weight_table(f.fuse(d), "row_id")
    return rounded(t, *[c for c in t.columns if c != "row_id"])


@query("fusion_weight_summary", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql()}
SELECT model AS source, round(avg(wgt), 6) AS mean, round(stddev_pop(wgt), 6) AS std, round(min(wgt), 6) AS min, round(max(wgt), 6) AS max
FROM wt GROUP BY model""")
def _wsum(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    return rounded(f.weight_summary(f.fuse(d)), "mean", "std", "min", "max")


@query("fusion_variants")
def _variants(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d)
    return rounded(f.ablations(d.filter(f"NOT ({CUT})"), "y"), *METRICS)


_STATIC_F1 = (f1_tables('fp', '1').replace('sd AS (SELECT 1,', 'sd2 AS (SELECT').replace('UNION ALL SELECT 1,', 'UNION ALL SELECT')
              .replace('pc AS (SELECT 1,', 'pc2 AS (SELECT').replace('GROUP BY 1, cls', 'GROUP BY cls').replace('FROM sd ', 'FROM sd2 ')
              .replace('sm AS (SELECT 1,', 'sm2 AS (SELECT').replace('FROM pc GROUP BY 1', 'FROM pc2'))


@query("static_fusion_scores", f"""
WITH {FUSION_SQL}{QUALITY_SQL}{weight_sql('CAST(1 AS DOUBLE)', 'CAST(0 AS DOUBLE)', 'CAST(0 AS DOUBLE)')}{_STATIC_F1}
SELECT n_samples, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1 FROM sm2""")
def _static(spark, sf):
    d = fusion_rows(spark, sf)
    f = fitted_fusion(d).variants()["static_weights"]
    t = metrics.summary_scores(metrics.confusion(f.fuse(d), "y", "pred"))
    return t.select("n_samples", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


_T = [float(t) for t in np.geomspace(0.25, 8.0, 200)]


@query("temperature_scaling", f"""
WITH {SCORES_SQL},
tg AS (SELECT i, t[i] AS temp FROM (SELECT {_T!r}::DOUBLE[] AS t), range(1, 201) r(i)),
lo AS (SELECT y, [ln(greatest(x, 1e-12)) FOR x IN p_gamma] AS l FROM sc),
nl AS (SELECT i, temp, avg(-(l[y + 1] / temp - ln(list_sum([exp(x / temp) FOR x IN l])))) AS nll FROM lo, tg GROUP BY i, temp)
SELECT round(min_by(temp, (nll, i)), 6) AS temperature FROM nl""")
def _temp(spark, sf):
    t = fusion.fit_temperature(scores(spark, sf), "p_gamma", "y", N)
    return spark.createDataFrame([(round(t, 6),)], "temperature double")


@query("calibration_before_after")
def _cal(spark, sf):
    s = scores(spark, sf)
    val, test = s.filter(CUT), s.filter(f"NOT ({CUT})")
    out = []
    for m, how in (("alpha", "isotonic"), ("beta", "platt"), ("gamma", "temperature")):
        cal = fusion.fit_calibrator(val, f"p_{m}", "y", N, how)
        counted = cut_lineage(metrics.counted_rows(test, f"p_{m}", "y"))
        out.append(reports.calibration_change(cal.apply(counted, f"p_{m}", "after"), f"p_{m}", "after", "y", weight="n").select(
            F.lit(m).alias("model"), F.lit(how).alias("method"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# A point of the running counts is a corner of the rising fit if every slope to its
# left is below every slope to its right; blocks lie between corners.
ISOTONIC_SQL = f"""
WITH {SCORES_SQL},
pts AS (SELECT c AS cls, p_alpha[c + 1] AS score, sum(CAST(y = c AS BIGINT)) AS pos, count(*) AS n
  FROM (SELECT * FROM sc WHERE {CUT_SQL}), (SELECT CAST(range AS INTEGER) AS c FROM range(5)) GROUP BY ALL),
run AS (SELECT *, row_number() OVER k AS i, CAST(sum(pos) OVER k AS BIGINT) AS cp, CAST(sum(n) OVER k AS BIGINT) AS cn
  FROM pts WINDOW k AS (PARTITION BY cls ORDER BY score)),
cum AS (SELECT cls, i, cp, cn FROM run UNION ALL SELECT DISTINCT cls, 0, 0, 0 FROM run),
slope AS (SELECT a.cls, a.i,
    max((a.cp - b.cp) / CAST(a.cn - b.cn AS DOUBLE)) FILTER (b.i < a.i) AS before,
    min((b.cp - a.cp) / CAST(b.cn - a.cn AS DOUBLE)) FILTER (b.i > a.i) AS after
  FROM cum a JOIN cum b ON a.cls = b.cls AND a.i <> b.i GROUP BY a.cls, a.i),
corner AS (SELECT cls, i, lead(i) OVER (PARTITION BY cls ORDER BY i) AS upto FROM slope
  WHERE before IS NULL OR after IS NULL OR before < after),
blk AS (SELECT cls, min(score) AS low, max(score) AS high, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS n
  FROM run JOIN corner USING (cls) WHERE run.i > corner.i AND run.i <= corner.upto GROUP BY cls, corner.i)
"""


@query("isotonic_blocks", ISOTONIC_SQL + "SELECT cls, round(low, 9) AS low, round(high, 9) AS high, pos, n FROM blk")
def _blocks(spark, sf):
    """Slices of ten scores, so that slices are merged as in a large table."""
    counts = cut_lineage(metrics.score_counts(scores(spark, sf).filter(CUT), "p_alpha", "y"))
    return isotonic.rising_blocks(counts, ["cls"], rows=10).select(
        "cls", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "pos", "n")


@query("isotonic_calibration", ISOTONIC_SQL + f""",
ends AS (SELECT *, pos / CAST(n AS DOUBLE) AS v, lead(low) OVER k AS low2, lead(pos / CAST(n AS DOUBLE)) OVER k AS v2 FROM blk
  WINDOW k AS (PARTITION BY cls ORDER BY low)),
raw AS (SELECT row_id, c AS cls, p_alpha[c + 1] AS score
  FROM (SELECT * FROM sc WHERE NOT ({CUT_SQL})), (SELECT CAST(range AS INTEGER) AS c FROM range(5))),
hit AS (SELECT row_id, cls, CASE WHEN v IS NULL THEN (SELECT min(e.v) FROM ends e WHERE e.cls = r.cls)
    WHEN score <= high OR v2 IS NULL THEN v
    ELSE v + (v2 - v) * (score - high) / (low2 - high) END AS v
  FROM (SELECT r.*, e.v, e.high, e.low2, e.v2 FROM raw r ASOF LEFT JOIN ends e ON r.cls = e.cls AND r.score >= e.low) r)
SELECT row_id, {', '.join(f"""round(CASE WHEN sum(v) > 0 THEN sum(v) FILTER (cls = {i}) / sum(v) ELSE 0.2 END, 6) AS c{i}""" for i in range(5))}
FROM hit GROUP BY row_id""")
def _iso(spark, sf):
    s = scores(spark, sf)
    cal = fusion.fit_calibrator(s.filter(CUT), "p_alpha", "y", N, "isotonic")
    out = cal.apply(s.filter(f"NOT ({CUT})"), "p_alpha", "after")
    return out.select("row_id", *[F.round(F.get("after", F.lit(i)), 6).alias(f"c{i}") for i in range(N)])


@query("guard_probabilities", f"""
WITH {SCORES_SQL}, x AS (SELECT row_id, CASE WHEN row_id % 50 = 0 THEN [v * 1.01 FOR v IN p_alpha]
  WHEN row_id % 51 = 0 THEN [v - 0.2 FOR v IN p_alpha] ELSE p_alpha END AS p FROM sc)
SELECT 'probabilities_valid' AS guard, count(*) AS n, min(CAST(row_id AS VARCHAR)) AS example FROM x
WHERE list_min(p) < -1e-4 OR abs(list_sum(p) - 1) > 1e-3 HAVING count(*) > 0""")
def _gp(spark, sf):
    s = scores(spark, sf)
    p = F.when(F.col("row_id") % 50 == 0, F.transform("p_alpha", lambda v: v * 1.01)).when(
        F.col("row_id") % 51 == 0, F.transform("p_alpha", lambda v: v - 0.2)).otherwise(F.col("p_alpha"))
    return guards.probabilities_valid(s.withColumn("p", p), "p", "row_id")


@query("guard_weights", f"""
WITH {SCORES_SQL}
SELECT 'weights_sum_to_one' AS guard, count(*) AS n, min(CAST(row_id AS VARCHAR)) AS example FROM sc
WHERE row_id % 50 = 0 HAVING count(*) > 0""")
def _gw(spark, sf):
    s = scores(spark, sf)
    p = F.when(F.col("row_id") % 50 == 0, F.transform("p_alpha", lambda v: v * 1.01)).otherwise(F.col("p_alpha"))
    return guards.weights_sum_to_one(s.withColumn("w", p), "w", "row_id")
