"""Models, the full run and branch tables over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmine.functions.arrays import argmax
from flowmine.operators import metrics, models
from flowmine.operators.fitted import Preprocessor
from flowmine.operators.splits import time_blocked_split
from flowmine.plans import run as plan
from flowmine.queries.common import TIME_BLOCKS_SQL, event_split, query, sessions_of
from flowmine.queries.scoring import MODELS, SCORES_SQL, f1_tables, long_scores, rounded
from flowmine.session import cut_lineage
from flowmine.settings import ModelSettings, Settings
from flowmine.sources.views import EVENT_CLASSES

FEATURES = ["value", "k", "hour", "signal"]
LIGHT = ModelSettings(rf_trees=20, rf_depth=6, boost_rounds=8, boost_depth=3, window=4, hidden=(16,), epochs=30,
                      edge_max_gap_s=86400.0)


def coded(d):
    y = (F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("label")) - 1).cast("int")
    # A feature that carries the class for two rows in three.
    return d.withColumn("y", y).withColumn("signal", F.when(
        F.col("row_id") % 3 == 0, F.col("k") % 5).otherwise(F.col("y")).cast("double"))


def modelling_rows(spark, sf):
    # Only what the models read is shuffled and staged; scaling is cheaper than reading a second copy.
    flows = sessions_of(spark, sf).select("row_id", "ts", "session_id", "label", "src_ip", "value", "k", "hour")
    d = cut_lineage(coded(time_blocked_split(flows, "session_id", "ts", "label", "row_id", EVENT_CLASSES)))
    p = Preprocessor(FEATURES).fit(d.filter("split = 'train'"))
    return p.transform(d, ["row_id", "ts", "session_id", "label", "y", "src_ip", "split"])


for _name in ("rf", "boost", "neural", "sequence", "graph"):
    @query(f"model_{_name}")
    def _model(spark, sf, name=_name):
        rows = modelling_rows(spark, sf)
        parts = {p: rows.filter(F.col("split") == p) for p in ("train", "val", "test")}
        data = models.TrainingData(parts["train"], parts["val"], FEATURES, len(EVENT_CLASSES))
        out = models.MODELS[name](data, LIGHT).predict(parts["test"], "p")
        conf = metrics.confusion(out.select("y", argmax(F.col("p")).alias("pred")), "y", "pred")
        return rounded(metrics.summary_scores(conf), "accuracy", "macro_f1").select("n_samples", "accuracy", "macro_f1")


def light_settings() -> Settings:
    return Settings(classes=tuple(EVENT_CLASSES), benign="view", models=LIGHT).with_(
        selection=dict(rankers=("mi", "dmm", "sd", "rfi"), top_k=3, vote_threshold=2, n_grid=(2, 3), rfi_trees=10,
                       probe_trees=10),
        imbalance=dict(mode="class_weight"), evaluation=dict(rare_classes=("error",)))


@query("full_run")
def _full(spark, sf):
    d = coded(sessions_of(spark, sf)).drop("user_id", "us", "skey")
    r = plan.run(d, FEATURES, plan.Roles(label="label"), light_settings())
    return rounded(r.tables["metrics"], "accuracy", "macro_f1").select("model", "n_samples", "accuracy", "macro_f1")


@query("score_gap", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}
SELECT a.model, round(a.accuracy, 6) AS accuracy, round(a.macro_f1, 6) AS macro_f1, round(a.accuracy - b.accuracy, 6) AS accuracy_gap,
  round(a.macro_f1 - b.macro_f1, 6) AS macro_f1_gap FROM sm a, sm b WHERE b.model = 'alpha'""")
def _gap(spark, sf):
    s = metrics.summary_scores(metrics.confusion(long_scores(spark, sf), "y", "pred", ["model"]), ["model"])
    g = plan.leakage_gap(s.select("model", "accuracy", "macro_f1"), "model", ["accuracy", "macro_f1"], "alpha")
    return rounded(g, "accuracy", "macro_f1", "accuracy_gap", "macro_f1_gap")


@query("branch_comparison", f"""
WITH {SCORES_SQL}{f1_tables('pr', 'model')}
SELECT model AS branch, CAST(n_samples AS BIGINT) AS n_samples, round(accuracy, 6) AS accuracy,
  CASE WHEN model <> 'gamma' THEN round(macro_f1, 6) END AS macro_f1 FROM sm""")
def _branches(spark, sf):
    s = metrics.summary_scores(metrics.confusion(long_scores(spark, sf), "y", "pred", ["model"]), ["model"])
    s = rounded(s, "accuracy", "macro_f1").select("model", "n_samples", "accuracy", "macro_f1")
    parts = {}
    for m in MODELS:
        t = s.filter(F.col("model") == m).drop("model")
        parts[m] = t.drop("macro_f1") if m == "gamma" else t
    return plan.comparison(parts).select("branch", "n_samples", "accuracy", "macro_f1")


@query("rows_per_part", f"""
WITH {TIME_BLOCKS_SQL} SELECT split, count(*) AS n, count(DISTINCT session_id) AS sessions FROM rows_split GROUP BY split""")
def _parts(spark, sf):
    per = event_split(spark, sf).groupBy("split", "session_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("split").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("sessions"))
