"""Parts of a run that no query reaches: stability, comparisons, costs, search, branches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmine.operators import models, reports, selection
from flowmine.plans import run as plan
from flowmine.settings import ModelSettings, Recipe, SelectionSettings

FEATURES = ["a", "b", "c"]
SELECT = SelectionSettings(rankers=("dmm", "sd"), top_k=2, vote_threshold=1, probe_trees=3, stability_runs=1, n_grid=(1, 2), recipes=(
    Recipe("every feature", read="all"), Recipe("spread", ("sd",), 1), Recipe("correlation", ("pearson",), 1)))


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(4)
    data = [(i, int(c), float(np.clip(0.3 * c + g.normal(0, .05), 0, 1)), float(g.random() ** 3), 0.5 + 0.01 * float(g.random()))
            for i, c in enumerate(g.choice([0, 1, 2], 240))]
    d = spark.createDataFrame(data, "row_id int, y int, a double, b double, c double").withColumn(
        "session_id", F.concat(F.lit("s"), F.floor(F.col("row_id") / 4).cast("string"))).withColumn(
        "ts", F.timestamp_seconds("row_id")).withColumn("src_ip", F.lit("h"))
    return d.filter("row_id % 3 > 0").cache(), d.filter("row_id % 3 = 0").cache()


def test_stability_and_comparison_lists(rows):
    train, val = rows
    freq = {r["feature"]: r["frequency"] for r in selection.stability(train, FEATURES, "y", "row_id", 1, SELECT).collect()}
    assert set(freq) == set(FEATURES) and sum(freq.values()) == 1.0
    scores = selection.comparison_scores(selection.score_rankers(train, FEATURES, "y", "row_id", SELECT), train, FEATURES, "y", 2)
    lists = selection.ablation_subsets(scores, 2, SELECT)
    assert list(lists) == ["every feature", "spread", "correlation", "without dmm", "without sd"]
    assert lists["every feature"] == FEATURES and lists["correlation"][0] == "a" and all(len(f) <= 2 for n, f in lists.items() if n != "every feature")
    assert lists["without dmm"] == lists["spread"]
    probes = selection.ablations({n: lists[n] for n in ("every feature", "correlation")}, train, {"val": val}, "y", "row_id", SELECT).collect()
    assert {(r["experiment"], r["n_features"]) for r in probes} == {("every feature", 3), ("correlation", 2)}
    assert all(0.5 < r["macro_f1"] <= 1 for r in probes)
    grid = {(r["K"], r["eta"], r["N"]): r for r in selection.sensitivity(
        scores, train, val, "y", "row_id", [1, 2], [1], [1, 3], SELECT).collect()}
    assert len(grid) == 4 and all((r["val_macro_f1"] is None) == (r["pool_size"] < r["N"]) for r in grid.values())


def test_costs_search_and_failures(spark, rows):
    train, val = rows
    data = models.TrainingData(train, val, FEATURES, 3)
    settings = ModelSettings(enabled=("rf",), rf_trees=4, rf_depth=3)
    fitted, failed = models.train_all(data, data, settings)
    cost = models.cost_table(fitted, val).first()
    assert failed == [] and cost["model"] == "rf" and cost["train_s"] > 0 and cost["inference_ms_per_flow"] > 0 and cost["parameters"] > 0
    best, score = models.search("rf", data, {"rf_depth": [1, 4], "rf_trees": [3]}, trials=2, settings=settings)
    assert best == {"rf_depth": 4, "rf_trees": 3} and score > 0.8
    again = models.search("rf", data, {"rf_depth": [1, 4], "rf_trees": [3]}, trials=1, settings=settings)
    assert again[0]["rf_depth"] in (1, 4)
    broken = models.TrainingData(train.drop("a"), val, FEATURES, 3)
    with pytest.raises(RuntimeError, match="no model"):
        models.train_all(broken, broken, settings)


def test_tables_of_runs(spark, rows):
    train, _ = rows
    top = reports.top_rows(train, 3, F.col("a").desc(), F.col("row_id")).collect()
    want = sorted(((-r["a"], r["row_id"]) for r in train.collect()))[:3]
    assert [(-r["a"], r["row_id"]) for r in top] == want
    one = {"strategy": "time_blocked", "imbalance": "both", "n_features": 3, "accuracy": 0.9, "macro_f1": 0.8, "weighted_f1": 0.85,
           "ece": 0.1, "threshold": 0.5, "lambdas": "(1, 0)", "failed": ""}
    table = plan.summary_table(spark, {"x": one, "y": {**one, "strategy": "stratified_flow", "macro_f1": 0.9}})
    assert {r["name"]: r["macro_f1"] for r in table.collect()} == {"x": 0.8, "y": 0.9}
    both = plan.comparison({"first": table, "second": table.drop("ece")})
    assert both.count() == 4 and both.filter("branch = 'second' AND ece IS NULL").count() == 2
    gap = {r["strategy"]: r["macro_f1_gap"] for r in plan.leakage_gap(table, "strategy", ["macro_f1"]).collect()}
    assert gap == {"time_blocked": 0.0, "stratified_flow": pytest.approx(0.1)}


def test_branches_run_and_skip_small_families(spark, sf):
    from flowmine.queries.common import sessions_of
    from flowmine.queries.modelling import FEATURES as EVENT_FEATURES, coded, light_settings

    d = coded(sessions_of(spark, sf)).drop("user_id", "us", "skey")
    settings = light_settings().with_(models=dict(enabled=("rf",)))
    runs = plan.imbalance_branches(d, EVENT_FEATURES, plan.Roles(label="label"), settings, modes=("class_weight",))
    assert runs["class_weight"].summary["imbalance"] == "class_weight" and 0 <= runs["class_weight"].summary["macro_f1"] <= 1
    assert plan.summary_table(spark, {m: r.summary for m, r in runs.items()}).count() == 1
    own = plan.run(d, EVENT_FEATURES, plan.Roles(label="label"), settings.with_(fusion=dict(context="label_graph")))
    assert "k_rf" in own.scored.columns and own.fusion.by_model and 0 <= own.summary["macro_f1"] <= 1
    with pytest.raises(ValueError, match="label_graph"):
        plan.run(d, EVENT_FEATURES, plan.Roles(label="label"), settings.with_(fusion=dict(context="guess")))
    none = plan.zero_day_branches(d, EVENT_FEATURES, plan.Roles(label="label"), settings, families=["absent"])
    assert tuple(none.first())[:3] == ("absent", 0, None)
