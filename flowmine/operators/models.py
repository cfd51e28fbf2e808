"""Classifiers on one canonical class order.

A model is ``fit(data) -> Fitted`` where ``Fitted.predict(df, name)`` adds an
array column with one probability per class, whatever classes it has seen.
"""

from __future__ import annotations

import itertools
import json
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel,
    RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.arrays import argmax, scaled
from flowmine.functions.columns import hash_unit, literal_map, quote, seeded_order
from flowmine.operators import graph, metrics
from flowmine.operators.imbalance import class_weights
from flowmine.operators.rankers import fit_one_vs_rest, labels_of
from flowmine.operators.windows import session_windows
from flowmine.session import cut_lineage
from flowmine.settings import ModelSettings

log = logging.getLogger(__name__)


@dataclass
class TrainingData:
    """Rows and roles a model may use. ``y`` holds integer class codes."""

    train: DataFrame
    val: DataFrame
    features: list[str]
    n_classes: int
    row_id: str = "row_id"
    y: str = "y"
    weight: str | None = None
    session: str = "session_id"
    ts: str = "ts"
    host: str = "src_ip"
    seed: int = 42


def vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[quote(c).cast("double") for c in features])))


def aligned(p: Column, n: int) -> Column:
    """Probability array of any length as ``n`` entries with sum one."""
    return scaled([F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(n)])


@dataclass
class Fitted:
    """A fitted model: Spark models by key, the inputs they need, their order."""

    kind: str
    features: list[str]
    n_classes: int
    models: dict[str, object]
    extra: dict = field(default_factory=dict)
    train_s: float = 0.0

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        return PREDICTORS[self.kind](self, df, name)

    def parameters(self) -> int:
        """Tree nodes or weights."""
        n = 0
        for m in self.models.values():
            if hasattr(m, "totalNumNodes"):
                n += m.totalNumNodes
            elif hasattr(m, "weights"):
                n += len(m.weights)
            else:
                n += m.coefficientMatrix.numRows * m.coefficientMatrix.numCols + len(m.interceptVector)
        return n

    def save(self, spark, path: str) -> None:
        for k, m in self.models.items():
            m.write().overwrite().save(f"{path}/{k}")
        meta = json.dumps({"kind": self.kind, "features": self.features, "n_classes": self.n_classes,
                           "models": {k: type(m).__name__ for k, m in self.models.items()}, "extra": self.extra})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "Fitted":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        kinds = {c.__name__: c for c in (RandomForestClassificationModel, GBTClassificationModel,
                                         MultilayerPerceptronClassificationModel, LogisticRegressionModel)}
        models = {k: kinds[c].load(f"{path}/{k}") for k, c in meta["models"].items()}
        return Fitted(meta["kind"], meta["features"], meta["n_classes"], models, meta["extra"])


MODELS: dict[str, Callable[[TrainingData, ModelSettings], Fitted]] = {}
PREDICTORS: dict[str, Callable[[Fitted, DataFrame, str], DataFrame]] = {}


def register_model(name: str, predict: Callable[[Fitted, DataFrame, str], DataFrame]):
    """Add a model kind to the registry."""
    def add(fn):
        MODELS[name] = fn
        PREDICTORS[name] = predict
        return fn
    return add


def _drop_ml(df: DataFrame) -> DataFrame:
    return df.drop("features", "rawPrediction", "probability", "prediction")


def _predict_single(m: Fitted, df: DataFrame, name: str) -> DataFrame:
    out = m.models["main"].transform(vector(df, m.features)).withColumn("__p", vector_to_array("probability"))
    return _drop_ml(out.withColumn(name, aligned(F.col("__p"), m.n_classes))).drop("__p")


@register_model("rf", _predict_single)
def fit_forest(d: TrainingData, s: ModelSettings) -> Fitted:
    """Random forest, Gini, square-root feature draws, row weights."""
    est = RandomForestClassifier(featuresCol="features", labelCol=d.y, numTrees=s.rf_trees, maxDepth=s.rf_depth,
                                 featureSubsetStrategy="sqrt", seed=d.seed)
    if d.weight:
        est = est.setWeightCol(d.weight)
    return Fitted("rf", d.features, d.n_classes, {"main": est.fit(vector(d.train, d.features))})


def _predict_boost(m: Fitted, df: DataFrame, name: str) -> DataFrame:
    out = vector(df, m.features)
    for k, model in m.models.items():
        out = model.transform(out).withColumn(f"__s{k}", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction")
    parts = [F.col(f"__s{c}") if str(c) in m.models else F.lit(0.0) for c in range(m.n_classes)]
    return out.withColumn(name, scaled(parts)).drop("features", *[f"__s{k}" for k in m.models])


@register_model("boost", _predict_boost)
def fit_boosting(d: TrainingData, s: ModelSettings) -> Fitted:
    """One boosted binary model per class, stopped early on validation rows."""
    w = F.col(d.weight) if d.weight else F.lit(1.0)
    cols = lambda df, flag, wt: vector(df, d.features).select(
        "features", d.y, wt.cast("double").alias("__w"), F.lit(flag).alias("__val"))
    both = cols(d.train, False, w).unionByName(cols(d.val, True, F.lit(1.0)))
    models = fit_one_vs_rest(both, d.y, labels_of(d.train, d.y), lambda c: GBTClassifier(
        featuresCol="features", weightCol="__w", validationIndicatorCol="__val", maxIter=s.boost_rounds,
        maxDepth=s.boost_depth, stepSize=s.boost_step, subsamplingRate=0.9, seed=d.seed))
    return Fitted("boost", d.features, d.n_classes, {str(int(c)): m for c, m in models.items()})


def replicate_by_weight(df: DataFrame, weight: str, row_id: str, seed: int) -> DataFrame:
    """Whole copies in proportion to the weight, for learners without weights."""
    whole = F.floor(F.col(weight))
    part = (hash_unit(seeded_order(seed, F.col(row_id))) < F.col(weight) - whole).cast("int")
    return (df.withColumn("__n", (whole + part).cast("int")).filter("__n > 0")
            .withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__k"))


def _mlp(df: DataFrame, d: TrainingData, width: int, s: ModelSettings) -> MultilayerPerceptronClassificationModel:
    rows = replicate_by_weight(df, d.weight, d.row_id, d.seed) if d.weight else df
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=d.y, layers=[width, *s.hidden, d.n_classes], maxIter=s.epochs,
        seed=d.seed).fit(rows.select("features", F.col(d.y).cast("double").alias(d.y)))


@register_model("neural", _predict_single)
def fit_neural(d: TrainingData, s: ModelSettings) -> Fitted:
    """Feed-forward network on the features in their chosen order."""
    return Fitted("neural", d.features, d.n_classes, {"main": _mlp(vector(d.train, d.features), d, len(d.features), s)})


def _windowed(df: DataFrame, features, session, ts, row_id, length) -> DataFrame:
    w = session_windows(df, session, ts, [row_id], features, length, "__win")
    return w.withColumn("features", array_to_vector(F.flatten("__win"))).drop("__win")


def _predict_sequence(m: Fitted, df: DataFrame, name: str) -> DataFrame:
    x = m.extra
    out = m.models["main"].transform(_windowed(df, m.features, x["session"], x["ts"], x["row_id"], x["window"]))
    out = out.withColumn("__p", vector_to_array("probability"))
    return _drop_ml(out.withColumn(name, aligned(F.col("__p"), m.n_classes))).drop("__p")


@register_model("sequence", _predict_sequence)
def fit_sequence(d: TrainingData, s: ModelSettings) -> Fitted:
    """Network over the last rows of the session."""
    rows = _windowed(d.train, d.features, d.session, d.ts, d.row_id, s.window)
    model = _mlp(rows, d, s.window * len(d.features), s)
    return Fitted("sequence", d.features, d.n_classes, {"main": model},
                  {"window": s.window, "session": d.session, "ts": d.ts, "row_id": d.row_id})


def graph_features(df: DataFrame, features: Sequence[str], session: str, ts: str, host: str, hops: int,
                   max_in: int, max_gap_s: float, max_edges: int | None = None, label: str | None = None) -> DataFrame:
    """Per session its mean features and their propagated values, over all edges unless ``max_edges`` is given.

    Rows without a session are in no node and in no edge.
    """
    df = df.filter(F.col(session).isNotNull())
    # Both are read several times below, and are far smaller than the rows.
    nodes = graph.numbered(graph.session_nodes(df, session, ts, features, label), session, "__no")
    if max_edges:
        # The budget is cut in the order of the names.
        edges, key = cut_lineage(graph.session_edges(df, session, ts, host, max_in, max_gap_s)), session
        log.warning("only the first %d of %d session edges are used", max_edges, edges.count())
        edges = graph.limit_edges(edges, max_edges)
    else:
        edges, key = cut_lineage(graph.numbered_edges(df, nodes, session, host, max_in, max_gap_s, "__no")), "__no"
    h = graph.propagate(nodes, edges, key, features, hops, "causal", folded=True)
    far = h.select(key, F.array(*[quote(c) for c in features]).alias("__far"))
    own = nodes.select(session, "__no", F.array(*[quote(c) for c in features]).alias("__own"),
                       *(["node_label"] if label else []))
    return own.join(far, key).withColumn("features", array_to_vector(F.concat("__own", "__far"))).drop(
        "__own", "__far", "__no")


def _predict_graph(m: Fitted, df: DataFrame, name: str) -> DataFrame:
    x = m.extra
    nodes = graph_features(df, m.features, x["session"], x["ts"], x["host"], x["hops"], x["max_in"], x["gap"], x["edges"])
    p = m.models["main"].transform(nodes).withColumn("__p", vector_to_array("probability"))
    p = p.select(x["session"], aligned(F.col("__p"), m.n_classes).alias(name))
    return graph.to_rows(df, p, x["session"])


@register_model("graph", _predict_graph)
def fit_graph(d: TrainingData, s: ModelSettings) -> Fitted:
    """Linear model on raw and propagated session features; weights follow the nodes."""
    nodes = graph_features(d.train, d.features, d.session, d.ts, d.host, s.graph_hops, s.max_in_degree,
                           s.edge_max_gap_s, s.max_edges, d.y)
    nodes = cut_lineage(nodes)
    est = LogisticRegression(featuresCol="features", labelCol="node_label", family="multinomial", maxIter=100,
                             regParam=1e-4)
    if d.weight:
        w = {str(r["node_label"]): r["weight"] for r in class_weights(nodes, "node_label").collect()}
        nodes = nodes.withColumn("__w", F.element_at(literal_map(w), F.col("node_label").cast("string")))
        est = est.setWeightCol("__w")
    return Fitted("graph", d.features, d.n_classes, {"main": est.fit(nodes)},
                  {"session": d.session, "ts": d.ts, "host": d.host, "hops": s.graph_hops, "max_in": s.max_in_degree,
                   "gap": s.edge_max_gap_s, "edges": s.max_edges})


def train_all(flow: TrainingData, ordered: TrainingData, settings: ModelSettings = ModelSettings()
              ) -> tuple[dict[str, Fitted], list[str]]:
    """Fit every enabled model; one whose data or parameters Spark refuses is left out, none left is an error.

    ``flow`` may be resampled; sequence and graph models need ``ordered``, the
    original rows with their sessions.
    """
    fitted, failed = {}, []
    for name in settings.enabled:
        t0 = time.perf_counter()
        try:
            fitted[name] = MODELS[name](ordered if name in ("sequence", "graph") else flow, settings)
            fitted[name].train_s = time.perf_counter() - t0
        except (ValueError, ArithmeticError, PySparkException) as e:
            log.warning("model %s failed: %s", name, e)
            failed.append(name)
    if not fitted:
        raise RuntimeError(f"no model could be fitted: {failed}")
    return fitted, failed


def predict_all(fitted: dict[str, Fitted], df: DataFrame) -> DataFrame:
    """Probability column ``p_<model>`` of every model."""
    for name, m in fitted.items():
        df = m.predict(df, f"p_{name}")
    return df


def cost_table(fitted: dict[str, Fitted], df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Train seconds, inference milliseconds per row, parameters."""
    n = n_rows or df.count()
    rows = []
    for name, m in fitted.items():
        t0 = time.perf_counter()
        m.predict(df, "__out").select(F.sum(F.get("__out", F.lit(0)))).collect()
        rows.append((name, m.train_s, 1000.0 * (time.perf_counter() - t0) / max(n, 1), m.parameters()))
    return df.sparkSession.createDataFrame(rows, "model string, train_s double, inference_ms_per_flow double, parameters long")


def macro_f1(m: Fitted, df: DataFrame, y: str) -> float:
    p = m.predict(df, "__out").select(F.col(y).alias("y"), argmax(F.col("__out")).alias("pred"))
    return metrics.summary_scores(metrics.confusion(p, "y", "pred")).first()["macro_f1"]


def search(name: str, data: TrainingData, grid: dict[str, Sequence], trials: int = 15,
           settings: ModelSettings = ModelSettings(), seed: int = 42) -> tuple[dict, float]:
    """Best of a seeded random part of a parameter grid, by validation macro-F1."""
    import hashlib
    cells = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    cells.sort(key=lambda c: hashlib.md5(f"{seed}:{sorted(c.items())}".encode()).hexdigest())
    scored = [(macro_f1(MODELS[name](data, replace(settings, **c)), data.val, data.y), -i, c)
              for i, c in enumerate(cells[:trials])]
    best = max(scored, key=lambda t: t[:2])
    return best[2], best[0]
