"""Calibration and per-row, reliability-weighted fusion of several models.

The input is one row per record with a probability array per model
(``p_<model>``), so weights, fused probabilities and risk are plain expressions:
fusing a table takes no shuffle at all.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.arrays import argmax, confidence, log_gaps, scaled, soften
from flowmine.functions.columns import literal_map, plus
from flowmine.operators import isotonic, metrics
from flowmine.operators.temporal import TransitionGraph
from flowmine.operators.windows import previous_state
from flowmine.session import cut_lineage
from flowmine.settings import FusionSettings

EPS = 1e-12


# -- calibration -------------------------------------------------------------
def fit_temperature(df: DataFrame, probs: str, truth: str, n_classes: int, steps: int = 200) -> float:
    """Temperature with the smallest log loss on a geometric grid 0.25 ... 8.

    Rows of equal probabilities and truth meet the grid once, with their count.
    """
    grid = [float(t) for t in np.geomspace(0.25, 8.0, steps)]
    gaps = log_gaps(F.col(probs), n_classes)
    own = F.get(F.array(*gaps), F.col(truth).cast("int"))
    # The grid is unrolled before the explode, so each row carries plain numbers.
    rows = metrics.counted_rows(df, probs, truth).select(*[g.alias(f"g{i}") for i, g in enumerate(gaps)], own.alias("own"), "n")
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "t"))
    nll = F.ln(plus([F.exp(F.col(f"g{i}") / F.col("t")) for i in range(n_classes)])) - F.col("own") / F.col("t")
    loss = rows.groupBy("i").agg((F.sum(F.least(nll, F.lit(-math.log(EPS))) * F.col("n")) / F.sum("n")).alias("nll"))
    best = loss.agg(F.min_by("i", F.struct("nll", "i")).alias("i")).first()["i"]
    return grid[best] if best is not None else 1.0


@dataclass
class Calibrator:
    """Frozen calibration of one probability column."""

    method: str
    n_classes: int
    temperature: float = 1.0
    platt: dict[int, tuple[float, float]] = field(default_factory=dict)
    isotonic: dict[int, object] = field(default_factory=dict)

    def apply(self, df: DataFrame, probs: str, out: str) -> DataFrame:
        p = F.col(probs)
        if self.method == "none":
            return df.withColumn(out, p)
        if self.method == "temperature":
            return df.withColumn(out, soften(p, F.lit(self.temperature), self.n_classes))
        work, parts = df, []
        for c in range(self.n_classes):
            x = F.get(p, F.lit(c))
            if self.method == "platt" and c in self.platt:
                a, b = self.platt[c]
                parts.append(1.0 / (1.0 + F.exp(-(F.lit(a) * x + F.lit(b)))))
            elif self.method == "isotonic" and c in self.isotonic:
                model = self.isotonic[c]
                work = work.withColumn(f"__x{c}", x)
                work = model.setFeaturesCol(f"__x{c}").setPredictionCol(f"__i{c}").transform(work)
                parts.append(F.col(f"__i{c}"))
            else:
                parts.append(x)
        n = self.n_classes
        for c, v in enumerate(parts):
            work = work.withColumn(f"__v{c}", F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)))
        work = work.withColumn(out, scaled([F.col(f"__v{c}") for c in range(n)]))
        return work.drop(*[f"__{k}{c}" for k in "xiv" for c in range(n)])


def fit_calibrator(df: DataFrame, probs: str, truth: str, n_classes: int, method: str,
                   steps: int = 200, stage=cut_lineage) -> Calibrator:
    """Fit on validation rows; a class with only one outcome stays as it is.

    Counts per distinct score are staged, since every class reads them.
    """
    cal = Calibrator(method, n_classes)
    if method == "none":
        return cal
    if method == "temperature":
        cal.temperature = fit_temperature(df, probs, truth, n_classes, steps)
        return cal
    counts = stage(metrics.score_counts(df, probs, truth))
    both = {r["cls"] for r in metrics.class_totals(counts).collect() if r["n_pos"] > 0 and r["n_neg"] > 0}
    if method == "isotonic":
        blocks = stage(isotonic.rising_blocks(counts.filter(F.col("cls").isin(sorted(both))), ["cls"], stage=stage))
        cal.isotonic = isotonic.fit_models(blocks, "cls", sorted(both))
        return cal
    if method != "platt":
        raise ValueError(f"unknown calibration {method!r}")
    # One weighted row per distinct score and outcome.
    long = counts.select("cls", "score", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("w")),
        F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("w")))).alias("e"))
    long = long.select("cls", "score", "e.label", "e.w").filter("w > 0")
    for c in sorted(both):
        vec = long.filter(F.col("cls") == c).withColumn("features", array_to_vector(F.array("score")))
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1e-8,
                                maxIter=200).fit(vec)
        cal.platt[c] = (float(lr.coefficients[0]), float(lr.intercept))
    return cal


def fit_calibrators(df: DataFrame, models: Sequence[str], truth: str, n_classes: int,
                    settings: FusionSettings = FusionSettings()) -> dict[str, Calibrator]:
    chosen = dict(settings.calibrators)
    return {m: fit_calibrator(df, f"p_{m}", truth, n_classes, chosen.get(m, "isotonic"),
                              settings.temperature_steps) for m in models}


def apply_calibrators(df: DataFrame, calibrators: dict[str, Calibrator]) -> DataFrame:
    for m, cal in calibrators.items():
        df = cal.apply(df, f"p_{m}", f"p_{m}")
    return df


# -- fusion ------------------------------------------------------------------
def add_context(df: DataFrame, graph: TransitionGraph | None, classes: Sequence[str],
                prev: str = "prev_state") -> DataFrame:
    """``context``: probability of each class after the previous state."""
    if graph is None:
        return df.withColumn("context", F.array_repeat(F.lit(1.0 / max(len(classes), 2)), len(classes)))
    table = graph.outgoing(classes)
    if prev != "prev_state":
        df = df.withColumn("prev_state", F.col(prev))
    flat = F.array_repeat(F.lit(1.0 / max(graph.n_states, 1)), len(classes))
    return df.join(table, "prev_state", "left").withColumn("context", F.coalesce("context", flat))


def add_label_context(df: DataFrame, graph: TransitionGraph, classes: Sequence[str], models: Sequence[str],
                      session: str, ts: str, tie: Sequence[str]) -> DataFrame:
    """``k_<model>``: probability of the model's class after its own class on the session's previous row.

    ``graph`` counts transitions between labels of training rows. True labels of
    earlier rows are unknown when rows are scored, so each model follows its own
    path. A first row, and a row after one without probabilities, get 1/C. The
    square of the classes is the only table, a literal.
    """
    wanted = [str(c) for c in classes]
    flat = 1.0 / max(len(wanted), 2)
    after = {r["prev_state"]: r["context"] for r in graph.outgoing(wanted).filter(F.col("prev_state").isin(wanted)).collect()}
    square = F.array(*[F.array(*[F.lit(float(x)) for x in after.get(c) or [flat] * len(wanted)]) for c in wanted])
    own = [argmax(F.col(f"p_{m}")).cast("int") for m in models]
    work = previous_state(df, session, ts, tie, F.array(*own), "__path")
    return work.withColumns({f"k_{m}": F.coalesce(F.get(F.get(square, F.get("__path", F.lit(j))), own[j]), F.lit(flat))
                             for j, m in enumerate(models)}).drop("__path")


def _grid_counts(grid: Sequence[tuple[float, float, float]], quality: Sequence[float], temporal: Sequence[float], n: int):
    """Counts (triple, truth, fused class) of a task's rows, in the steps of ``Fusion.fuse``."""
    models, n_src, least = range(len(quality)), len(quality) + len(temporal), EPS

    def count(batches):
        found: dict = {}
        for pdf in batches:
            codes, truths = pd.factorize(pdf["y"], use_na_sentinel=False)
            col = lambda name: pdf[name].to_numpy(float)  # noqa: E731   a missing value is NaN
            p = [np.stack([col(f"p{j}_{i}") for i in range(n)]) for j in models]
            c, k = [col(f"c{j}") for j in models], [col(f"k{j}") for j in models]
            more = [x * col("at") for x in temporal]
            for g, (l1, l2, l3) in enumerate(grid):
                # A source without probabilities has no weight.
                q = [np.fmax(l1 * quality[j] + l2 * c[j] + l3 * (k[j] if l3 > 0 else 1.0 / max(n, 2)), 0.0) for j in models]
                total = functools.reduce(np.add, q + more)
                with np.errstate(invalid="ignore", divide="ignore"):
                    w = [np.where(total > least, x / total, 1.0 / n_src) for x in q]
                    mixed = functools.reduce(np.add, [w[j] * p[j] for j in models])
                    mass = functools.reduce(np.add, list(mixed))
                    pred = np.where(mass > least, np.argmax(mixed / mass, axis=0), 0)
                cells = np.bincount(codes * n + pred, minlength=len(truths) * n).reshape(len(truths), n)
                for y, per in zip(truths, cells):
                    key = (g, None if pd.isna(y) else int(y))
                    found[key] = found.get(key, 0) + per
        out = [(g, y, c, int(m)) for (g, y), per in found.items() for c, m in enumerate(per) if m]
        yield pd.DataFrame({name: pd.Series([r[i] for r in out], dtype=kind) for i, (name, kind) in enumerate(
            [("i", "int32"), ("y", "Int32"), ("pred", "int32"), ("n", "int64")])})
    return count


@dataclass
class Fusion:
    """Reliabilities Q, lambda weights and alert threshold, fitted on validation.

    The context term reads ``context`` (see ``add_context``) or, with ``by_model``,
    the columns of ``add_label_context``.
    """

    models: list[str]
    classes: list[str]
    benign: int
    temporal: bool = True
    lambdas: tuple = (0.5, 0.3, 0.2)
    quality: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    equal: bool = False
    by_model: bool = False

    def _context(self, model: str) -> Column:
        return F.col(f"k_{model}") if self.by_model else F.get("context", argmax(F.col(f"p_{model}")))

    @property
    def sources(self) -> list[str]:
        return [*self.models, *(("sp", "tc") if self.temporal else ())]

    def reliabilities(self, lambdas: Sequence[Column] | None = None) -> list[Column]:
        """One expression per source, not below zero."""
        l1, l2, l3 = lambdas or [F.lit(float(x)) for x in self.lambdas]
        n = len(self.classes)
        flat = F.lit(1.0 / max(n, 2))
        out = []
        for m in self.models:
            p = F.col(f"p_{m}")
            k = F.when(l3 > 0, self._context(m)).otherwise(flat)
            q = l1 * F.lit(float(self.quality.get(m, 0.0))) + l2 * confidence(p, n) + l3 * k
            out.append(F.greatest(q, F.lit(0.0)))
        if self.temporal:
            out += [F.lit(float(self.quality.get(s, 0.0))) * F.col("availability") for s in ("sp", "tc")]
        return out

    def fuse(self, df: DataFrame) -> DataFrame:
        """Add ``q`` and ``w`` (arrays in source order), ``fused``, ``risk``, ``pred``.

        Each step adds plain columns that the next one reads, so no expression
        is computed twice.
        """
        n, c, j = len(self.sources), len(self.classes), len(self.models)
        before = df.columns
        q = self.reliabilities()
        work = df.select("*", *[x.alias(f"__q{i}") for i, x in enumerate(q)])
        if self.equal:
            w = [F.lit(1.0 / n) for _ in q]
        else:
            work = work.withColumn("__t", plus([F.col(f"__q{i}") for i in range(n)]))
            w = [F.when(F.col("__t") > EPS, F.col(f"__q{i}") / F.col("__t")).otherwise(1.0 / n) for i in range(n)]
        work = work.select("*", *[x.alias(f"__w{i}") for i, x in enumerate(w)])
        w = [F.col(f"__w{i}") for i in range(n)]
        risk = plus([w[i] * (1.0 - F.get(f"p_{m}", F.lit(self.benign))) for i, m in enumerate(self.models)])
        if self.temporal:
            risk = risk + w[j] * F.col("sp") + w[j + 1] * F.col("tc")
        work = work.select("*", risk.alias("risk"), *[x.alias(f"__m{i}") for i, x in enumerate(self._mixed(w))])
        work = work.withColumn("__s", plus([F.col(f"__m{i}") for i in range(c)]))
        work = work.select("*", *[F.when(F.col("__s") > EPS, F.col(f"__m{i}") / F.col("__s")).otherwise(1.0 / c)
                                  .alias(f"__f{i}") for i in range(c)])
        fused = F.array(*[F.col(f"__f{i}") for i in range(c)])
        return work.select(*before, F.array(*[F.col(f"__q{i}") for i in range(n)]).alias("q"),
                           F.array(*w).alias("w"), "risk", fused.alias("fused"), argmax(fused).alias("pred"))

    def _mixed(self, w: list[Column]) -> list[Column]:
        """Weighted class sums of the models."""
        return [plus([w[j] * F.get(f"p_{m}", F.lit(i)) for j, m in enumerate(self.models)])
                for i in range(len(self.classes))]

    # -- fitting -------------------------------------------------------------
    def fit_quality(self, val: DataFrame, truth: str) -> "Fusion":
        """Macro-F1 per model; ROC-AUC of the temporal scores against benign."""
        long = val.select(F.col(truth).alias("y"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), argmax(F.col(f"p_{m}")).alias("pred"))
            for m in self.models])).alias("x")).select("y", "x.model", "x.pred")
        scores = metrics.summary_scores(metrics.confusion(long, "y", "pred", ["model"]), ["model"])
        self.quality = {r["model"]: float(r["macro_f1"]) for r in scores.collect()}
        if self.temporal:
            attack = F.col(truth) != self.benign
            rows = val.select(attack.alias("a"), F.explode(F.array(*[
                F.struct(F.lit(s).alias("source"), F.col(s).alias("s")) for s in ("sp", "tc")])).alias("x"))
            rows = rows.select("a", "x.source", "x.s")
            areas = metrics.ranking_areas(
                metrics.binary_counts(rows, "s", F.col("a"), ["source"]), ["source"])
            got = {r["source"]: r["roc_auc"] for r in areas.collect()}
            for s in ("sp", "tc"):
                self.quality[s] = float(got[s]) if got.get(s) is not None else 0.5
        return self

    def lambda_grid(self, step: float = 0.1) -> list[tuple[float, float, float]]:
        marks = [float(x) for x in np.arange(0.0, 1.0 + 1e-9, step)]
        return [(a, b, max(1.0 - a - b, 0.0)) for a in marks for b in marks
                if -1e-9 <= 1.0 - a - b <= 1.0 + 1e-9]

    def lambda_scores(self, val: DataFrame, truth: str, step: float = 0.1) -> DataFrame:
        """Validation macro-F1 of every lambda triple, in one job.

        Confidence and context are columns; a task then fuses a batch of rows under one
        triple after the other and counts what it predicts.
        """
        n, grid = len(self.classes), self.lambda_grid(step)
        base = val.select(
            F.col(truth).cast("int").alias("y"),
            *[F.get(f"p_{m}", F.lit(i)).cast("double").alias(f"p{j}_{i}") for j, m in enumerate(self.models) for i in range(n)],
            *[confidence(F.col(f"p_{m}"), n).alias(f"c{j}") for j, m in enumerate(self.models)],
            *[self._context(m).cast("double").alias(f"k{j}") for j, m in enumerate(self.models)],
            *([F.col("availability").cast("double").alias("at")] if self.temporal else []))
        counts = base.mapInPandas(
            _grid_counts(grid, [float(self.quality.get(m, 0.0)) for m in self.models],
                         [float(self.quality.get(s, 0.0)) for s in ("sp", "tc")] if self.temporal else [], n),
            "i int, y int, pred int, n long")
        table = F.array(*[F.struct(*[F.lit(float(x)).alias(f"l{j}") for j, x in enumerate(g, 1)]) for g in grid])
        conf = counts.groupBy("i", "y", "pred").agg(F.sum("n").alias("n")).withColumn("g", F.get(table, F.col("i")))
        keys = ["i", "l1", "l2", "l3"]
        return metrics.summary_scores(conf.select("i", "g.*", "y", "pred", "n"), keys).select(*keys, "macro_f1")

    def fit_lambdas(self, val: DataFrame, truth: str, step: float = 0.1) -> "Fusion":
        best = self.lambda_scores(val, truth, step).agg(
            F.max_by(F.struct("l1", "l2", "l3"), F.struct("macro_f1", -F.col("i"))).alias("b")).first()["b"]
        self.lambdas = (best["l1"], best["l2"], best["l3"])
        return self

    def threshold_scores(self, fused: DataFrame, truth: str, points: int = 101) -> DataFrame:
        """Binary macro-F1 and false-alarm rate of ``risk >= tau`` over a grid.

        Rows are counted by the highest grid mark they reach, then cumulated.
        """
        marks = [float(x) for x in np.linspace(0.0, 1.0, points)]
        reach = plus([(F.col("risk") >= F.lit(m)).cast("int") for m in marks])
        attack = (F.col(truth) != self.benign).cast("long")
        binned = fused.select(reach.alias("r"), attack.alias("a")).groupBy("r").agg(
            F.sum("a").alias("pos"), F.sum(1 - F.col("a")).alias("neg"))
        # A row that reaches r marks alarms at marks 0 .. r-1.
        table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("tau")) for i, m in enumerate(marks)])
        per = binned.select("r", "pos", "neg", F.explode(table).alias("g"))
        on = F.col("r") > F.col("g.i")
        t = per.groupBy(F.col("g.i").alias("i"), F.col("g.tau").alias("tau")).agg(
            F.sum(F.when(on, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(on, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(on, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(on, 0).otherwise(F.col("neg"))).alias("tn"))
        d1, d0 = 2 * F.col("tp") + F.col("fp") + F.col("fn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")
        f1 = F.when(d1 > 0, 2.0 * F.col("tp") / d1).otherwise(0.0)
        f0 = F.when(d0 > 0, 2.0 * F.col("tn") / d0).otherwise(0.0)
        present = (d1 > 0).cast("int") + (d0 > 0).cast("int")
        far = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0)
        return t.select("i", "tau", "tp", "fp", "fn", "tn", ((f1 + f0) / present).alias("macro_f1"), far.alias("far"))

    def fit_threshold(self, val: DataFrame, truth: str, settings: FusionSettings = FusionSettings()) -> "Fusion":
        t = self.threshold_scores(self.fuse(val), truth, settings.threshold_points)
        if settings.threshold_objective == "target_far":
            got = t.filter(F.col("far") <= settings.target_false_alarm_rate).agg(F.min("tau")).first()[0]
            self.threshold = float(got) if got is not None else 1.0
        else:
            self.threshold = float(t.agg(F.max_by("tau", F.struct("macro_f1", -F.col("i")))).first()[0])
        return self

    def fit(self, val: DataFrame, truth: str, settings: FusionSettings = FusionSettings(),
            tune: bool = True) -> "Fusion":
        self.fit_quality(val, truth)
        if tune:
            self.fit_lambdas(val, truth, settings.lambda_step)
        else:
            self.lambdas = settings.lambdas
        return self.fit_threshold(val, truth, settings)

    # -- variants and reports -------------------------------------------------
    def variants(self) -> dict[str, "Fusion"]:
        """Ablations: what each part of the weighting adds."""
        from dataclasses import replace
        l1, l2, l3 = self.lambdas
        best = max(self.models, key=lambda m: (self.quality.get(m, 0.0), -self.models.index(m)))

        def scaled(*ls):
            s = sum(ls)
            return tuple(x / s for x in ls) if s > 0 else (1.0, 0.0, 0.0)
        return {
            "single_best": replace(self, models=[best], temporal=False, equal=True),
            "equal_weights": replace(self, equal=True),
            "static_weights": replace(self, lambdas=(1.0, 0.0, 0.0)),
            "no_confidence": replace(self, lambdas=scaled(l1, 0.0, l3)),
            "no_context": replace(self, lambdas=scaled(l1, l2, 0.0)),
            "no_temporal": replace(self, temporal=False),
            "proposed": self,
        }

    def ablations(self, df: DataFrame, truth: str) -> DataFrame:
        """Scores of every variant on the same rows."""
        conf = [metrics.confusion(v.fuse(df), truth, "pred").select(F.lit(n).alias("variant"), "y", "pred", "n")
                for n, v in self.variants().items()]
        both = functools.reduce(lambda a, b: a.unionByName(b), conf)
        return metrics.summary_scores(both, ["variant"])

    def explain(self, df: DataFrame, row_id: str, value) -> DataFrame:
        """One row taken apart: per source quality, confidence, q, w, score and share; then the total."""
        fused = self.fuse(df.filter(F.col(row_id) == value))
        score = {m: 1.0 - F.get(f"p_{m}", F.lit(self.benign)) for m in self.models}
        n = len(self.classes)
        none = F.lit(None).cast("double")
        parts = F.array(*[F.struct(
            F.lit(s).alias("source"), F.lit(float(self.quality.get(s, 0.0))).alias("quality"),
            (confidence(F.col(f"p_{s}"), n) if s in score else none).alias("confidence"),
            F.get("q", F.lit(j)).alias("q"), F.get("w", F.lit(j)).alias("w"),
            (score[s] if s in score else F.col(s)).alias("score")) for j, s in enumerate(self.sources)])
        rows = fused.select(F.explode(parts).alias("x")).select("x.*").withColumn(
            "contribution", F.col("w") * F.col("score"))
        total = rows.agg(F.sum("w").alias("w"), F.sum("contribution").alias("contribution")).select(
            F.lit("TOTAL").alias("source"), none.alias("quality"), none.alias("confidence"), none.alias("q"), "w",
            none.alias("score"), "contribution")
        return rows.unionByName(total)

    def weight_table(self, fused: DataFrame, row_id: str) -> DataFrame:
        return fused.select(row_id, *[F.get("w", F.lit(j)).alias(f"w_{s}") for j, s in enumerate(self.sources)],
                            F.col("risk").alias("R_t"))

    def weight_summary(self, fused: DataFrame) -> DataFrame:
        """Mean, population deviation, smallest and largest weight per source."""
        names = literal_map({str(j): s for j, s in enumerate(self.sources)}, value_type="string")
        return (fused.select(F.posexplode("w").alias("j", "w"))
                .groupBy(F.element_at(names, F.col("j").cast("string")).alias("source"))
                .agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min"),
                     F.max("w").alias("max")))
