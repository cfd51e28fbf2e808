"""Classification metrics, curves, calibration errors and significance tests.

Everything starts from small counts: a confusion table, bin totals, or totals
per distinct score. ``keys`` are extra grouping columns (model, setting, seed),
so many variants are scored in one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.arrays import argmax
from flowmine.functions.columns import bins_below
from flowmine.operators.blocks import add_running
from flowmine.session import cut_lineage


def confusion(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Observed cells of the confusion matrix: keys, y, pred, n."""
    return df.groupBy(*keys, F.col(truth).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_grid(conf: DataFrame, n_classes: int) -> DataFrame:
    """All cells, with each row's share of its true class."""
    codes = F.array(*[F.lit(i) for i in range(n_classes)])
    grid = conf.sparkSession.range(n_classes).select(
        F.col("id").cast("int").alias("y"), F.explode(codes).alias("pred"))
    full = grid.join(F.broadcast(conf.select(F.col("y").cast("int"), F.col("pred").cast("int"), "n")),
                     ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    rows = full.groupBy("y").agg(F.sum("n").alias("__t"))
    return full.join(F.broadcast(rows), "y").select(
        "y", "pred", "n", (F.col("n") / F.greatest(F.col("__t"), F.lit(1))).alias("share"))


def per_class(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predicted, hits, precision, recall and F1 per label seen."""
    sides = F.array(
        F.struct(F.col("y").cast("int").alias("cls"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("t")),
        F.struct(F.col("pred").cast("int").alias("cls"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("t")))
    c = (conf.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, F.col("x.cls").alias("cls"))
         .agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.t").alias("hits")))
    zero = F.lit(0.0)
    c = (c.withColumn("precision", F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(zero))
         .withColumn("recall", F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(zero)))
    return c.withColumn("f1", F.when(
        F.col("support") + F.col("predicted") > 0,
        2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(zero))


def summary_scores(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro / weighted precision, recall, F1.

    Macro averages run over the labels present in truth or prediction.
    """
    c = per_class(conf, keys)
    w = F.sum("support")
    return c.groupBy(*keys).agg(
        w.alias("n_samples"), (F.sum("hits") / w).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / w).alias("weighted_f1"),
        (F.sum(F.col("precision") * F.col("support")) / w).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / w).alias("recall_weighted"))


def class_report(conf: DataFrame, classes: Sequence[str], rare: Sequence[str] = (),
                 keys: Sequence[str] = ()) -> DataFrame:
    """Per-class block over all canonical classes, rare ones flagged."""
    c = per_class(conf, keys)
    names = conf.sparkSession.createDataFrame(
        [(i, n, n in set(rare)) for i, n in enumerate(classes)], "cls int, class string, is_rare boolean")
    if keys:
        grid = conf.select(*keys).distinct().withColumn("__a", F.array(*[F.lit(i) for i in range(len(classes))]))
        names = grid.select(*keys, F.explode("__a").alias("cls")).join(F.broadcast(names), "cls")
    return names.join(c, [*keys, "cls"], "left").select(
        *keys, "class", F.coalesce("support", F.lit(0)).alias("support"),
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")], "is_rare")


def rare_recall(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall of the rare classes that occur."""
    return report.groupBy(*keys).agg(
        F.avg(F.when(F.col("is_rare") & (F.col("support") > 0), F.col("recall"))).alias("rare_class_recall_macro"))


# -- calibration -------------------------------------------------------------
def confidence_bins(df: DataFrame, probs: str, truth: str, n_bins: int = 15,
                    keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows, mean confidence and accuracy per equal bin (low, high] of the top score.

    With ``weight`` a row stands for that many.
    """
    p = F.col(probs)
    top = F.array_max(p)
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    rows = df.select(*keys, top.alias("__c"), (argmax(p) == F.col(truth)).cast("int").alias("__ok"),
                     *([F.col(weight).alias("__w")] if weight else []))
    n = F.sum("__w") if weight else F.count(F.lit(1))
    return (rows.filter(F.col("__c") > 0).groupBy(*keys, bins_below(F.col("__c"), edges).alias("bin"))
            .agg(n.alias("n"), _mean("__c", weight).alias("confidence"), _mean("__ok", weight).alias("accuracy")))


def _mean(value: str, weight: str | None) -> Column:
    """Mean of the values that are there, by ``__w`` if rows have a weight."""
    if weight is None:
        return F.avg(value)
    return F.sum(F.col(value) * F.col("__w")) / F.sum(F.when(F.col(value).isNotNull(), F.col("__w")))


def counted_rows(df: DataFrame, probs: str, truth: str) -> DataFrame:
    """(probs, truth, n): equal rows as one, for figures that only depend on both."""
    return df.groupBy(probs, truth).agg(F.count(F.lit(1)).alias("n"))


def calibration_error(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, probs: str, truth: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean squared distance to the one-hot truth; with ``weight`` a row stands for that many."""
    # |p|^2 - 2 p_y + 1, so the array is walked once.
    p = F.col(probs)
    sq = F.aggregate(p, F.lit(1.0), lambda a, x: a + x * x) - 2.0 * F.get(p, F.col(truth).cast("int"))
    rows = df.select(*keys, sq.alias("__sq"), *([F.col(weight).alias("__w")] if weight else []))
    return rows.groupBy(*keys).agg(_mean("__sq", weight).alias("brier"))


# -- curves ------------------------------------------------------------------
def score_counts(df: DataFrame, probs: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per (class, distinct score)."""
    x = df.select(*keys, F.col(truth).alias("__y"), F.posexplode(probs).alias("cls", "score"))
    hit = (F.col("__y") == F.col("cls")).cast("long")
    return x.groupBy(*keys, "cls", "score").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def binary_counts(df: DataFrame, score: str | Column, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col(score) if isinstance(score, str) else score
    hit = positive.cast("long")
    return (df.select(*keys, F.lit(1).alias("cls"), s.alias("score"), hit.alias("__h"))
            .groupBy(*keys, "cls", "score").agg(F.sum("__h").alias("pos"), F.sum(1 - F.col("__h")).alias("neg")))


def cumulative_counts(counts: DataFrame, keys: Sequence[str] = (), ranges: int = 64) -> DataFrame:
    """Running true and false positives from the highest score down.

    Distinct scores are cut into ranges of near-equal size, so a class with a
    great many scores is spread over ``ranges`` tasks.
    """
    group = [*keys, "cls"]
    marks = [i / ranges for i in range(1, ranges)]
    edges = counts.groupBy(*group).agg(F.percentile_approx(
        "score", F.array(*[F.lit(m) for m in marks]), 1000).alias("__edges"))
    work = counts.join(F.broadcast(edges), group).withColumn(
        "__blk", -F.size(F.filter("__edges", lambda e: e < F.col("score")))).drop("__edges")
    work = work.withColumn("__desc", -F.col("score"))
    return add_running(work, group, ["__desc"], "__blk", {
        "tp": F.col("pos"), "fp": F.col("neg")}).drop("__blk", "__desc")


def class_totals(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys, "cls").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def ranking_areas(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision per class that occurs."""
    group = [*keys, "cls"]
    cum = cumulative_counts(counts, keys).join(F.broadcast(class_totals(counts, keys)), group)
    roc = F.sum((F.col("neg") / F.col("n_neg")) * ((F.col("tp") - F.col("pos") / 2.0) / F.col("n_pos")))
    ap = F.sum((F.col("pos") / F.col("n_pos")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return (cum.filter("n_pos > 0").groupBy(*group).agg(
        F.min("n_neg").alias("__n"), roc.alias("__roc"), ap.alias("pr_auc"))
        .select(*group, F.when(F.col("__n") > 0, F.col("__roc")).alias("roc_auc"), "pr_auc"))


def macro_areas(areas: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean areas over classes; NULL with fewer than two classes."""
    enough = F.count(F.lit(1)) >= 2
    return areas.groupBy(*keys).agg(
        F.when(enough, F.avg("roc_auc")).alias("roc_auc_ovr_macro"),
        F.when(enough, F.avg("pr_auc")).alias("pr_auc_macro"))


def roc_points(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(class, score, fpr, tpr, precision, recall) at every distinct score."""
    cum = cumulative_counts(counts, keys).join(F.broadcast(class_totals(counts, keys)), [*keys, "cls"])
    return cum.filter("n_pos > 0").select(
        *keys, "cls", "score", (F.col("fp") / F.greatest("n_neg", F.lit(1))).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


# -- comparison --------------------------------------------------------------
def aggregate_seeds(tables: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one seed) and number of seeds."""
    return tables.groupBy(key).agg(
        *[F.avg(m).alias(m) for m in metrics],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in metrics],
        F.count(F.lit(1)).alias("n_seeds"))


def discordance(df: DataFrame, truth: str, preds: Sequence[str]) -> DataFrame:
    """For every pair of models: rows only the first, only the second has right."""
    pairs = [(a, b) for i, a in enumerate(preds) for b in preds[i + 1:]]
    ok = {m: F.col(m) == F.col(truth) for m in preds}
    wide = df.agg(*[F.count(F.when(ok[a] & ~ok[b], 1)).alias(f"x{i}") for i, (a, b) in enumerate(pairs)],
                  *[F.count(F.when(~ok[a] & ok[b], 1)).alias(f"y{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                               F.col(f"x{i}").alias("n01"), F.col(f"y{i}").alias("n10"))
                      for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def mcnemar(n01: int, n10: int) -> tuple[float, float]:
    """Statistic and p: exact binomial below 25 disagreements, else chi-square."""
    n = n01 + n10
    if n == 0:
        return 0.0, 1.0
    if n < 25:
        low = min(n01, n10)
        tail = sum(math.comb(n, i) for i in range(low + 1)) / 2.0 ** n
        return float(low), min(1.0, 2.0 * tail)
    stat = (abs(n01 - n10) - 1.0) ** 2 / n
    return stat, math.erfc(math.sqrt(stat / 2.0))


def _macro_f1(cells: np.ndarray, counts: np.ndarray, side: int) -> np.ndarray:
    """Macro F1 for many count vectors at once (one row per replicate)."""
    labels = np.unique(cells[:, [0, side]])
    f1, seen = np.zeros(len(counts)), np.zeros(len(counts))
    for c in labels:
        t = counts[:, cells[:, 0] == c].sum(1)
        p = counts[:, cells[:, side] == c].sum(1)
        h = counts[:, (cells[:, 0] == c) & (cells[:, side] == c)].sum(1)
        f1 += np.where(t + p > 0, 2.0 * h / np.maximum(t + p, 1), 0.0)
        seen += t + p > 0
    return f1 / np.maximum(seen, 1)


def bootstrap_difference(df: DataFrame, truth: str, a: str, b: str, iters: int = 1000,
                         seed: int = 42) -> dict[str, float]:
    """Paired bootstrap of the macro-F1 difference.

    Rows enter only through the counts of (truth, a, b), at most classes cubed;
    a replicate is one multinomial draw, and replicates run as Spark tasks.
    """
    cells = [(r[0], r[1], r[2], r[3]) for r in df.groupBy(truth, a, b).agg(
        F.count(F.lit(1)).alias("n")).orderBy(truth, a, b).collect()]
    codes = np.array([c[:3] for c in cells], dtype=np.int64)
    counts = np.array([c[3] for c in cells], dtype=np.int64)
    total = int(counts.sum())

    def draw(batches):
        for pdf in batches:
            rows = np.stack([np.random.default_rng([seed, int(i)]).multinomial(total, counts / total)
                             for i in pdf["id"]]) if len(pdf) else np.zeros((0, len(counts)), dtype=np.int64)
            yield pd.DataFrame({"diff": _macro_f1(codes, rows, 1) - _macro_f1(codes, rows, 2)})

    diffs = df.sparkSession.range(iters).mapInPandas(draw, "diff double")
    r = diffs.agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
                  F.avg((F.col("diff") <= 0).cast("int")).alias("lo"),
                  F.avg((F.col("diff") >= 0).cast("int")).alias("hi")).first()
    one = counts[None, :]
    observed = float((_macro_f1(codes, one, 1) - _macro_f1(codes, one, 2))[0])
    return {"observed_diff": observed, "ci_low": r["ci"][0], "ci_high": r["ci"][1],
            "p_value": min(1.0, 2 * min(r["lo"], r["hi"]))}


def compare_models(df: DataFrame, truth: str, preds: Sequence[str], test: str = "mcnemar",
                   alpha: float = 0.05, iters: int = 1000, seed: int = 42) -> DataFrame:
    """Significance of every pair of prediction columns."""
    spark = df.sparkSession
    if test == "bootstrap":
        rows = []
        for i, a in enumerate(preds):
            for b in preds[i + 1:]:
                r = bootstrap_difference(df, truth, a, b, iters, seed)
                rows.append((a, b, test, r["observed_diff"], r["ci_low"], r["ci_high"], r["p_value"],
                             r["p_value"] < alpha))
        return spark.createDataFrame(rows, "model_a string, model_b string, test string, observed_diff double, "
                                           "ci_low double, ci_high double, p_value double, significant boolean")
    rows = []
    for r in discordance(df, truth, preds).collect():
        stat, p = mcnemar(r["n01"], r["n10"])
        rows.append((r["model_a"], r["model_b"], test, r["n01"], r["n10"], stat, p, p < alpha))
    return spark.createDataFrame(rows, "model_a string, model_b string, test string, n01 long, n10 long, "
                                       "statistic double, p_value double, significant boolean")


def zero_day(df: DataFrame, truth: str, pred: str, held_out: int, benign: int,
             family: str = "") -> DataFrame:
    """Unseen family predicted as anything but benign; benign false alarms."""
    unseen, calm = F.col(truth) == held_out, F.col(truth) == benign
    alarm = (F.col(pred) != benign).cast("int")
    return df.agg(
        F.lit(family).alias("held_out_family"), F.count(F.when(unseen, 1)).alias("n_unseen"),
        F.coalesce(F.avg(F.when(unseen, alarm)), F.lit(0.0)).alias("unseen_detection_recall"),
        F.count(F.when(calm, 1)).alias("n_benign"),
        F.coalesce(F.avg(F.when(calm, alarm)), F.lit(0.0)).alias("false_alarm_rate"))


def outcome_counts(df: DataFrame, probs: str, truth: str, n_bins: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and sums per (keys, y, pred, bin of the top score): what confusion, calibration and Brier score need.

    At most classes squared times bins rows per key, combined before the shuffle.
    A top score of zero or less has no bin.
    """
    p = F.col(probs)
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    off = F.aggregate(p, F.lit(1.0), lambda a, x: a + x * x) - 2.0 * F.get(p, F.col(truth).cast("int"))
    rows = df.select(*keys, F.col(truth).alias("y"), argmax(p).alias("pred"), F.array_max(p).alias("__c"), off.alias("__off"))
    bin_ = F.when(F.col("__c") > 0, bins_below(F.col("__c"), edges))
    return rows.groupBy(*keys, "y", "pred", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__c").alias("confidence"), F.sum("__off").alias("distance"),
        F.count("__off").alias("n_distance"))


def evaluate(df: DataFrame, models: Sequence[str], truth: str, classes: Sequence[str], rare: Sequence[str] = (),
             n_bins: int = 15, stage: Callable[[DataFrame], DataFrame] = cut_lineage) -> dict[str, DataFrame]:
    """All metric tables for probability columns ``p_<model>``.

    The rows are read twice: for counts of outcomes and for counts per distinct
    score. Both are staged, and every table follows from them.
    """
    long = df.select(F.col(truth).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("probs")) for m in models])).alias("x"))
    long = long.select("y", "x.model", "x.probs")
    k = ["model"]
    outcomes, counts = stage(outcome_counts(long, "probs", "y", n_bins, k)), stage(score_counts(long, "probs", "y", k))
    conf = outcomes.groupBy(*k, "y", "pred").agg(F.sum("n").alias("n"))
    judged = F.when(F.col("y").isNotNull(), F.col("n"))
    bins = outcomes.filter(F.col("bin").isNotNull()).groupBy(*k, "bin").agg(
        F.sum("n").alias("n"), (F.sum("confidence") / F.sum("n")).alias("confidence"),
        (F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum(judged)).alias("accuracy"))
    distance = outcomes.groupBy(*k).agg((F.sum("distance") / F.sum("n_distance")).alias("brier"))
    report = class_report(conf, classes, rare, k)
    flat = summary_scores(conf, k)
    for part in (calibration_error(bins, k), distance, macro_areas(ranking_areas(counts, k), k), rare_recall(report, k)):
        flat = flat.join(part, k, "left")
    return {"metrics": flat, "per_class": report, "confusion": conf, "reliability": bins,
            "curves": roc_points(counts, k)}
