"""Feature rankers: ``fn(train, features, label, row_id, settings, seed)`` -> (feature, score)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import bins_below, hash_slice, literal_map, quote, seeded_order
from flowmine.operators import metrics
from flowmine.operators.blocks import add_neighbours, add_running
from flowmine.operators.fitted import medians
from flowmine.operators.quantiles import exact_quantiles
from flowmine.operators.sampling import holdout, stratified_sample
from flowmine.operators.slices import SLICE_ROWS, sliced
from flowmine.operators.windows import session_windows
from flowmine.session import cut_lineage, shared_folder
from flowmine.settings import SelectionSettings

RANKERS: dict[str, Callable[..., DataFrame]] = {}


def register_ranker(name: str):
    """Add a ranker to the registry (also the plug point for users)."""
    def add(fn):
        RANKERS[name] = fn
        return fn
    return add


def score_table(df: DataFrame, scores: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f, i, float(s)) for i, (f, s) in enumerate(scores.items())], "feature string, pos int, score double")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n = sum(counts.values())
    table = {str(k): n / (len(counts) * v) for k, v in counts.items()}
    return df.withColumn("weight", F.coalesce(F.element_at(literal_map(table), F.col(label).cast("string")),
                                              F.lit(1.0)))


def fitting_rows(train: DataFrame, features: Sequence[str], label: str, row_id: str, max_rows: int | None, seed: int,
                 floor: int = 1) -> DataFrame:
    """Rows a forest is fitted on, with balanced weights; staged, since a fit reads them once a level."""
    rows = train.select(*dict.fromkeys([row_id, label, *features]))
    return balanced_weights(cut_lineage(stratified_sample(rows, label, max_rows, seed, [row_id], floor)), label)


def with_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[quote(c).cast("double") for c in features])))


# -- statistics ----------------------------------------------------------------
@register_ranker("dmm")
def rank_mean_median(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Distance between mean and median."""
    row = train.agg(*[F.avg(quote(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    mid = medians(train, features)
    return score_table(train, {c: abs(row[i] - mid[c]) for i, c in enumerate(features)})


@register_ranker("sd")
def rank_deviation(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Population standard deviation."""
    row = train.agg(*[F.stddev_pop(quote(c)).alias(f"s{i}") for i, c in enumerate(features)]).first()
    return score_table(train, {c: row[i] for i, c in enumerate(features)})


def rank_pearson(train, features, label, row_id=None, settings=None, seed=42) -> DataFrame:
    """Largest absolute correlation with any one-vs-rest class indicator."""
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    parts = [F.corr(quote(c).cast("double"), (F.col(label) == k).cast("double")).alias(f"r{i}_{j}")
             for i, c in enumerate(features) for j, k in enumerate(classes)]
    row = train.agg(*parts).first()

    def best(i):
        vals = [row[f"r{i}_{j}"] for j in range(len(classes))]
        return max([abs(v) for v in vals if v is not None and np.isfinite(v)], default=0.0)
    return score_table(train, {c: best(i) for i, c in enumerate(features)})


def rank_pca(train, features, label=None, row_id=None, settings=None, seed=42, components: int = 10) -> DataFrame:
    """Absolute loadings weighted by explained variance."""
    model = PCA(k=min(components, len(features)), inputCol="features", outputCol="pc").fit(
        with_vector(train, features).select("features"))
    load = np.abs(model.pc.toArray()) @ model.explainedVariance.toArray()
    return score_table(train, {c: load[i] for i, c in enumerate(features)})


def digamma(n: Column) -> Column:
    """Digamma of a positive number: shift by six, then the asymptotic series."""
    x = n + F.lit(6.0)
    y = 1.0 / (x * x)
    series = F.ln(x) - 0.5 / x - y * (1 / 12.0 - y * (1 / 120.0 - y / 252.0))
    for i in range(6):
        series = series - 1.0 / (n + F.lit(float(i)))
    return series


def mutual_information(df: DataFrame, features: Sequence[str], label: str, row_id: str, k: int = 3,
                       slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Nearest-neighbour estimate (Ross 2014) of each feature's information on the label.

    In one dimension the k-th neighbour of the same class lies among the k rows
    before and after in sorted order; how many rows of any class lie nearer is a
    difference of two running counts over points and interval ends. Rows of one
    class with one value share both figures, so all steps run on counted values.
    Features and classes of more than ``slice_rows`` values are cut by value; each
    slice gets the k values on either side of it.
    """
    x = F.array(*[F.struct(F.lit(c).alias("feature"), quote(c).cast("double").alias("x")) for c in features])
    long = df.select(F.col(label).alias("y"), F.explode(x).alias("e")).groupBy("y", "e.feature", "e.x").agg(
        F.count(F.lit(1)).alias("c"))
    long = cut_lineage(long)
    sizes = long.filter(F.col("feature") == F.lit(features[0])).groupBy("y").agg(F.sum("c").alias("ny")).filter("ny > 1")
    long = long.join(F.broadcast(sizes), "y")
    long, block = sliced(long, ["feature", "y"], ["x"], slice_rows)
    long = add_neighbours(long, ["feature", "y"], ["x"], block, F.struct("x", "c"), k)

    def copies(value: Column, times: Column) -> Column:
        return F.array_repeat(F.abs(F.col("x") - value), F.least(times, F.lit(k)).cast("int"))
    around = F.flatten(F.transform(F.concat("before", "after"), lambda v: copies(v["x"], v["c"])))
    near = F.array_sort(F.concat(copies(F.col("x"), F.col("c") - 1), around))
    kk = F.least(F.lit(k), F.col("ny") - 1)
    pts = long.withColumn("near", near).withColumn("k", kk).withColumn("d", F.get("near", (kk - 1).cast("int")))
    tie = F.col("d") == 0
    marks = F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("o"), F.col("c").alias("pt"), F.lit(0).alias("sign")),
        F.struct((F.col("x") + F.col("d")).alias("v"), F.when(tie, 2).otherwise(0).alias("o"), F.lit(0).cast("long").alias("pt"),
                 F.lit(1).alias("sign")),
        F.struct((F.col("x") - F.col("d")).alias("v"), F.when(tie, 0).otherwise(2).alias("o"), F.lit(0).cast("long").alias("pt"),
                 F.lit(-1).alias("sign")))
    ev = pts.select("feature", "y", "x", "c", "k", "ny", F.explode(marks).alias("m")).select(
        "feature", "y", "x", "c", "k", "ny", "m.*")
    order = ["v", "o", "y", "x", "sign"]
    ev, block = sliced(cut_lineage(ev), ["feature"], order, slice_rows)
    run = add_running(ev, ["feature"], order, block, {"upto": F.col("pt")})
    m = run.filter("sign <> 0").groupBy("feature", "y", "x").agg(
        F.sum(F.col("upto") * F.col("sign")).alias("m"), F.first("c").alias("c"), F.first("k").alias("k"),
        F.first("ny").alias("ny"))

    def mean(value: str) -> Column:
        return F.sum(F.col("c") * digamma(F.col(value).cast("double"))) / F.sum("c")
    t = m.groupBy("feature").agg(F.sum("c").alias("n"), mean("k").alias("a"), mean("ny").alias("b"), mean("m").alias("c"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n").cast("double")) + F.col("a") - F.col("b") - F.col("c"))
    order = literal_map({c: i for i, c in enumerate(features)}, value_type="int")
    return t.select("feature", F.element_at(order, F.col("feature")).alias("pos"), mi.alias("score"))


@register_ranker("mi")
def rank_information(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    return mutual_information(train, features, label, row_id, settings.mi_neighbors)


def binned_information(train: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information with quantile bins of each feature, over all rows."""
    q = exact_quantiles(train, features, [i / bins for i in range(1, bins)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bins_below(quote(c), sorted(set(q[c]))).alias("b"))
                      for c in features])
    joint = train.select(F.col(label).alias("y"), F.explode(cells).alias("e")).groupBy("e.feature", "e.b", "y").agg(
        F.count(F.lit(1)).alias("n"))
    wf, wb, wy = Window.partitionBy("feature"), Window.partitionBy("feature", "b"), Window.partitionBy("feature", "y")
    t = joint.select("feature", "n", F.sum("n").over(wf).alias("t"), F.sum("n").over(wb).alias("nb"),
                     F.sum("n").over(wy).alias("ny"))
    return t.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(
        F.col("n") / F.col("nb") * (F.col("t") / F.col("ny")))).alias("score"))


# -- trees -----------------------------------------------------------------------
@register_ranker("rfi")
def rank_forest(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Impurity importance of a class-balanced random forest."""
    s = fitting_rows(train, features, label, row_id, settings.rfi_max_rows, seed)
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=10,
                                   numTrees=settings.rfi_trees, seed=seed).fit(with_vector(s, features))
    imp = model.featureImportances.toArray()
    return score_table(train, {c: imp[i] for i, c in enumerate(features)})


def tree_nodes(model, spark) -> DataFrame:
    """Node table of a fitted tree ensemble, through its own saved form."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    d = spark.read.parquet(path + "/data")
    n = "nodeData."
    return d.select(F.col("treeID").alias("tree"), F.col(n + "id").alias("id"), F.col(n + "prediction").alias("value"),
                    F.col(n + "rawCount").cast("double").alias("cover"), F.col(n + "gain").alias("gain"),
                    F.col(n + "leftChild").alias("left"), F.col(n + "rightChild").alias("right"),
                    F.col(n + "split.featureIndex").alias("feature"),
                    F.get(F.col(n + "split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"))


def fit_one_vs_rest(df: DataFrame, label: str, classes: Sequence[int], make: Callable[[int], object],
                    parallel: int = 4) -> dict[int, object]:
    """One binary booster per class, fitted side by side."""
    data = df.persist()
    try:
        def one(c):
            return c, make(c).setLabelCol("__t").fit(data.withColumn("__t", (F.col(label) == c).cast("double")))
        with ThreadPoolExecutor(parallel) as pool:
            return dict(pool.map(one, classes))
    finally:
        data.unpersist()


def labels_of(df: DataFrame, label: str) -> list:
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def _boosters(train, features, label, row_id, rows, rounds, depth, seed) -> dict[int, object]:
    s = with_vector(balanced_weights(stratified_sample(train, label, rows, seed, [row_id]), label), features)
    return fit_one_vs_rest(s.select("features", label, "weight"), label, labels_of(s, label), lambda c: GBTClassifier(
        featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, subsamplingRate=0.9, seed=seed))


@register_ranker("boost")
def rank_gain(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Mean gain per split of boosted trees, over all one-vs-rest boosters."""
    models = _boosters(train, features, label, row_id, settings.boost_max_rows, settings.boost_rounds,
                       settings.boost_depth, seed)
    total, count = np.zeros(len(features)), np.zeros(len(features))
    for m in models.values():
        for r in tree_nodes(m, train.sparkSession).filter("left >= 0").groupBy("feature").agg(
                F.sum("gain").alias("g"), F.count(F.lit(1)).alias("n")).collect():
            total[r["feature"]] += r["g"]
            count[r["feature"]] += r["n"]
    return score_table(train, {c: total[i] / count[i] if count[i] else 0.0 for i, c in enumerate(features)})


def leaf_paths(nodes: pd.DataFrame) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Per leaf its value and, per feature on the way, bounds (low, high] and cover share."""
    out = []
    for _, tree in nodes.groupby("tree"):
        by_id = {int(r.id): r for r in tree.itertuples()}
        stack = [(0, {})]
        while stack:
            i, seen = stack.pop()
            r = by_id[i]
            if r.left < 0:
                out.append((float(r.value), [(f, *b) for f, b in seen.items()]))
                continue
            f = int(r.feature)
            low, high, share = seen.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in ((int(r.left), low, min(high, r.threshold)), (int(r.right), max(low, r.threshold), high)):
                part = by_id[child].cover / max(r.cover, 1e-12)
                stack.append((child, {**seen, f: (lo, hi, share * part)}))
    return out


def shapley_values(paths, x: np.ndarray, n_features: int) -> np.ndarray:
    """Path-dependent Shapley values of a sum of trees for a block of rows.

    A leaf is a product game over the features on its path: a present feature
    contributes whether the row follows the path, an absent one its cover share.
    """
    phi = np.zeros((len(x), n_features))
    for value, path in paths:
        m = len(path)
        if m == 0 or value == 0:
            continue
        on = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in path]
        size_weight = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        for j in range(m):
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for k in range(m):
                if k != j:
                    shifted = np.zeros_like(poly)
                    shifted[:, 1:] = poly[:, :-1]
                    poly = poly * path[k][3] + shifted * on[k][:, None]
            phi[:, path[j][0]] += value * (on[j] - path[j][3]) * (poly @ np.array(size_weight))
    return phi


def mean_shapley(model, df: DataFrame, n_features: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Mean absolute Shapley value per feature position over the rows of ``df``."""
    nodes = tree_nodes(model, df.sparkSession).toPandas()   # bounded by trees and depth
    w = list(weights if weights is not None else model.treeWeights)
    nodes["value"] = nodes["value"] * nodes["tree"].map(lambda t: w[int(t)])
    paths = leaf_paths(nodes)

    def explain(batches):
        for pdf in batches:
            phi = np.abs(shapley_values(paths, np.stack(pdf["x"].to_numpy()), n_features)) if len(pdf) else \
                np.zeros((0, n_features))
            yield pd.DataFrame({"pos": np.arange(n_features), "total": phi.sum(0), "n": len(pdf)})

    rows = df.select(vector_to_array("features").alias("x"))
    return rows.mapInPandas(explain, "pos int, total double, n long").groupBy("pos").agg(
        (F.sum("total") / F.sum("n")).alias("score"))


@register_ranker("shap")
def rank_shapley(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Mean absolute Shapley value of boosted trees over all rows and classes; the fit is on a bounded sample."""
    fit_rows = stratified_sample(train, label, settings.shap_fit_max_rows, seed, [row_id])
    models = _boosters(fit_rows, features, label, row_id, None, settings.shap_trees, 5, seed)
    shown = with_vector(train, features)
    total = np.zeros(len(features))
    for m in models.values():
        for r in mean_shapley(m, shown, len(features)).collect():
            total[r["pos"]] += r["score"]
    return score_table(train, {c: total[i] / len(models) for i, c in enumerate(features)})


# -- permutation ------------------------------------------------------------------
def permutation_importance(predict: Callable[[Sequence[Column]], Column], held: DataFrame, features: Sequence[str],
                           label: str, row_id: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Mean drop of macro-F1 when one feature's values are shuffled.

    Every (feature, repeat) is a variant of the held-out rows; its permutation is
    the pairing of two md5 orders. All variants are predicted in one job.
    """
    names = [f"__x{i}" for i in range(len(features))]
    base = held.select(row_id, label, *[quote(c).cast("double").alias(n) for n, c in zip(names, features)])
    variants = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(r).alias("rep"))
                         for i in range(len(features)) for r in range(repeats)])
    rows = base.select("*", F.explode(variants).alias("v")).select(row_id, label, *names, "v.f", "v.rep")

    def placed(name: str, *payload: str | Column) -> DataFrame:
        """Position of each row in a random order of its variant, from slices of the order."""
        digest = seeded_order(f"{seed}{name}", F.col("f"), F.col("rep"), F.col(row_id))
        keyed = rows.select("f", "rep", *payload, digest.alias("__d")).withColumn("__slice", hash_slice(F.col("__d")))
        return add_running(keyed, ["f", "rep"], ["__d"], "__slice", {"at": F.lit(1).cast("long")}).drop("__d", "__slice")

    own = F.coalesce(*[F.when(F.col("f") == i, F.col(n)) for i, n in enumerate(names)])
    mixed = placed("a", label, *names).join(placed("b", own.alias("__swap")), ["f", "rep", "at"]).select(
        "f", "rep", label, *[F.when(F.col("f") == i, F.col("__swap")).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)])
    both = mixed.unionByName(base.select(F.lit(-1).alias("f"), F.lit(0).alias("rep"), label, *names))
    scored = both.select("f", "rep", label, predict([F.col(n) for n in names]).alias("prediction"))
    conf = metrics.confusion(scored, label, "prediction", ["f", "rep"])
    f1 = metrics.summary_scores(conf, ["f", "rep"]).groupBy("f").agg(F.avg("macro_f1").alias("m"))
    got = {r["f"]: r["m"] for r in f1.collect()}
    return score_table(held, {c: got[-1] - got[i] for i, c in enumerate(features)})


def cosine_map(n_in: int, n_out: int, gamma: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Random cosine map of a batch whose inner products approach a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (n_in, n_out))
    b = rng.uniform(0.0, 2.0 * np.pi, n_out)
    return lambda x: np.sqrt(2.0 / n_out) * np.cos(x @ w + b)


def fourier_features(lift: Callable[[np.ndarray], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """Adds the vector ``features`` that ``lift`` makes of the array ``x``."""
    @F.pandas_udf("array<double>")
    def lifted(x: pd.Series) -> pd.Series:
        return pd.Series(list(lift(np.stack(x.to_numpy()))))

    return lambda d: d.withColumn("features", array_to_vector(lifted("x")))


def lifted_prediction(model: OneVsRestModel, lift: Callable[[np.ndarray], np.ndarray]) -> Callable[[Sequence[Column]], Column]:
    """The prediction of ``model`` on lifted rows, one product a batch; the lifted vectors never leave the worker."""
    w = np.stack([m.coefficients.toArray() for m in model.models], axis=1)
    b = np.array([m.intercept for m in model.models])

    @F.pandas_udf("double")
    def predicted(*x: pd.Series) -> pd.Series:
        return pd.Series((lift(np.column_stack([c.to_numpy() for c in x])) @ w + b).argmax(axis=1).astype(float))

    return lambda columns: predicted(*columns)


@register_ranker("pi_svm")
def rank_permutation(train, features, label, row_id, settings=SelectionSettings(), seed=42) -> DataFrame:
    """Permutation drop of a linear SVM on kernel features, on all held-out train rows.

    Only the fit is on a sample (``svm_max_rows`` of the other rows).
    """
    s = cut_lineage(holdout(train.select(row_id, label, *[quote(c) for c in features]), label,
                            settings.svm_holdout_frac, seed, [row_id]).withColumn("__y", F.col(label).cast("double")))
    lift = cosine_map(len(features), 100, 1.0 / max(len(features), 1), seed)
    fit = stratified_sample(s.filter("not holdout"), label, settings.svm_max_rows, seed, [row_id], 4).withColumn("x", F.array(*[quote(c).cast("double") for c in features]))
    fit = fourier_features(lift)(balanced_weights(fit, label)).select("features", "__y", "weight").persist()
    model = OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.001), labelCol="__y", weightCol="weight",
                      parallelism=4).fit(fit)
    fit.unpersist()
    return permutation_importance(lifted_prediction(model, lift), s.filter("holdout"), features, label, row_id,
                                  settings.svm_repeats, seed)


# -- sequences ---------------------------------------------------------------------
def mlp_parts(layers: Sequence[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and bias of each layer from the flat weight vector."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        w = weights[at:at + n_in * n_out].reshape(n_in, n_out).T
        at += n_in * n_out
        out.append((w, weights[at:at + n_out]))
        at += n_out
    return out


def mlp_input_gradients(parts, x: np.ndarray) -> np.ndarray:
    """d p_c / d x for every class: array (rows, classes, inputs)."""
    acts, a = [], x
    for w, b in parts[:-1]:
        a = 1.0 / (1.0 + np.exp(-(a @ w.T + b)))
        acts.append(a)
    w, b = parts[-1]
    z = a @ w.T + b
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    g = p[:, :, None] * (np.eye(p.shape[1])[None] - p[:, None, :]) @ w
    for (w, _), h in zip(reversed(parts[:-1]), reversed(acts)):
        g = (g * (h * (1 - h))[:, None, :]) @ w
    return g


def rank_sequence(train, features, label, row_id, settings=SelectionSettings(), seed=42, session="session_id",
                  ts="ts") -> DataFrame:
    """Mean |x * dp/dx| of a network over all session windows, summed over window steps.

    Only the fit is on a sample (``sequence_max_windows``).
    """
    win = cut_lineage(session_windows(train, session, ts, [row_id], features, settings.window)
                      .select(row_id, label, "window"))
    s = stratified_sample(win, label, settings.sequence_max_windows, seed, [row_id])
    s = s.select(F.col(label).cast("double").alias("__y"), F.flatten("window").alias("x")).withColumn(
        "features", array_to_vector("x"))
    n_classes = int(max(labels_of(s, "__y"))) + 1
    layers = [settings.window * len(features), 32, n_classes]
    model = MultilayerPerceptronClassifier(labelCol="__y", featuresCol="features", layers=layers, maxIter=30,
                                           seed=seed).fit(s.select("features", "__y"))
    parts = mlp_parts(layers, np.array(model.weights))
    k = len(features)

    def effect(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, layers[0]))
            g = np.abs(mlp_input_gradients(parts, x) * x[:, None, :]).sum(1) if len(x) else np.zeros((0, layers[0]))
            yield pd.DataFrame({"pos": np.arange(k), "total": g.reshape(len(x), -1, k).sum((0, 1)), "n": len(x)})

    shown = win.select(F.flatten("window").alias("x"))
    got = {r["pos"]: r["s"] for r in shown.mapInPandas(effect, "pos int, total double, n long").groupBy("pos")
           .agg((F.sum("total") / F.sum("n")).alias("s")).collect()}
    return score_table(train, {c: got.get(i, 0.0) for i, c in enumerate(features)})


RANKERS["sequence"] = rank_sequence
