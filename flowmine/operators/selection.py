"""Votes over rankings, subset size, stability and ablations."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.operators import metrics
from flowmine.operators.rankers import RANKERS, fitting_rows, rank_pca, rank_pearson, with_vector
from flowmine.operators.redundancy import RedundancyFilter
from flowmine.operators.sampling import stratified_sample
from flowmine.session import cut_lineage
from flowmine.settings import Recipe, SelectionSettings


def union_scores(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Long table (ranker, feature, pos, score)."""
    out = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias("ranker"), "feature", "pos", "score")
        out = part if out is None else out.unionByName(part)
    return out


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` features of each ranker with a positive score; ties by position."""
    w = Window.partitionBy("ranker").orderBy(F.col("score").desc(), "pos")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_share(members: DataFrame, k: int) -> DataFrame:
    """Normalised rank: 1 for the first, 0 for the k-th."""
    nr = F.lit(1.0) if k <= 1 else 1.0 - (F.col("rank") - 1) / F.lit(float(k - 1))
    return members.withColumn("nr", nr)


def fuse_rankings(scores: DataFrame, rankers: Sequence[str], k: int, eta: int) -> DataFrame:
    """Votes and mean normalised rank per feature; the pool holds those with enough votes."""
    m = rank_share(top_k(scores, k), k)
    feats = scores.groupBy("feature").agg(F.min("pos").alias("pos"))
    wide = m.groupBy("feature").agg(
        F.count(F.lit(1)).alias("votes"), (F.sum("nr") / len(rankers)).alias("score"),
        *[F.max(F.when(F.col("ranker") == r, 1)).alias(f"in_{r}") for r in rankers],
        *[F.max(F.when(F.col("ranker") == r, F.round("nr", 6))).alias(f"nr_{r}") for r in rankers])
    t = feats.join(wide, "feature", "left").select(
        "feature", "pos", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("score", F.lit(0.0)).alias("score"),
        *[F.coalesce(f"in_{r}", F.lit(0)).alias(f"in_{r}") for r in rankers],
        *[F.coalesce(f"nr_{r}", F.lit(0.0)).alias(f"nr_{r}") for r in rankers])
    t = t.withColumn("in_pool", (F.col("votes") >= eta).cast("int"))
    w = Window.orderBy(F.col("in_pool").desc(), F.col("score").desc(), F.col("votes").desc(), "pos")
    return t.withColumn("place", F.row_number().over(w))


def pool_of(table: DataFrame) -> list[str]:
    """Pooled features in order; all features when the pool is empty."""
    rows = table.orderBy("place").select("feature", "in_pool").collect()
    return [r["feature"] for r in rows if r["in_pool"]] or [r["feature"] for r in rows]


def smallest_within(curve: DataFrame, delta: float) -> int:
    """Smallest N whose macro-F1 is within ``delta`` of the best."""
    best = curve.agg(F.max("macro_f1").alias("best"))
    return curve.join(F.broadcast(best)).filter(F.col("macro_f1") >= F.col("best") - F.lit(delta)).agg(
        F.min("N")).first()[0]


def probe_rows(train: DataFrame, features: Sequence[str], label: str, row_id: str, settings: SelectionSettings,
               seed: int) -> DataFrame:
    """Rows that probes of any of these features are fitted on."""
    return fitting_rows(train, features, label, row_id, settings.probe_max_rows, seed, 5)


def fit_probe(rows: DataFrame, features: Sequence[str], label: str, settings: SelectionSettings, seed: int):
    """Class-balanced forest on ``probe_rows``, used to compare feature subsets."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=8,
                                  numTrees=settings.probe_trees, seed=seed).fit(with_vector(rows, features))


def probe_scores(model, df: DataFrame, features: Sequence[str], label: str, minority: Sequence[int]) -> dict:
    t0 = time.perf_counter()
    out = model.transform(with_vector(df, features)).select(
        F.col(label).alias("y"), F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("p"))
    conf = metrics.confusion(out, "y", "pred")
    flat = metrics.summary_scores(conf).first()
    took = time.perf_counter() - t0
    per = {r["cls"]: r["recall"] for r in metrics.per_class(conf).collect()}
    areas = metrics.macro_areas(metrics.ranking_areas(metrics.score_counts(out, "p", "y"))).first()
    rec = sum(per.get(c, 0.0) for c in minority) / len(minority) if minority else None
    return {"macro_f1": flat["macro_f1"], "weighted_f1": flat["weighted_f1"], "minority_recall": rec,
            "pr_auc": areas["pr_auc_macro"], "inference_time_s": took,
            "inference_ms_per_flow": 1000.0 * took / max(flat["n_samples"], 1)}


CURVE = ("macro_f1 double, weighted_f1 double, minority_recall double, pr_auc double, "
         "inference_time_s double, inference_ms_per_flow double")


def minority_classes(train: DataFrame, label: str, share: float = 0.05) -> list:
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n = sum(counts.values())
    return sorted(c for c, v in counts.items() if v < share * n)


def select_size(table: DataFrame, train: DataFrame, val: DataFrame, label: str, row_id: str,
                settings: SelectionSettings, seed: int = 42) -> tuple[int, DataFrame]:
    """Probe every subset size on validation and pick the smallest good one."""
    pool = pool_of(table)
    grid = [n for n in settings.n_grid if n <= len(pool)] or [len(pool)]
    minority = minority_classes(train, label)
    rows, sample = [], probe_rows(train, pool[:max(grid)], label, row_id, settings, seed)
    for n in grid:
        model = fit_probe(sample, pool[:n], label, settings, seed)
        rows.append((n, *probe_scores(model, val, pool[:n], label, minority).values()))
    curve = train.sparkSession.createDataFrame(rows, "N int, " + CURVE)
    return smallest_within(curve, settings.delta), curve


@dataclass
class FeatureSelection:
    """Result: redundancy filter, scores per ranker, votes, curve and chosen list."""

    filter: RedundancyFilter
    scores: DataFrame
    votes: DataFrame
    curve: DataFrame | None
    chosen: list[str]
    timings: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        missing = [c for c in self.chosen if c not in df.columns]
        if missing:
            raise KeyError(f"features missing: {missing}")
        return df.select(*keep, *[F.col(f"`{c}`") for c in self.chosen])


def score_rankers(train: DataFrame, features: Sequence[str], label: str, row_id: str,
                  settings: SelectionSettings, seed: int = 42, timings: dict | None = None) -> DataFrame:
    tables = {}
    for name in settings.rankers:
        t0 = time.perf_counter()
        t = RANKERS[name](train, features, label, row_id, settings, seed)
        # One row per feature: held as literals so later steps do not refit.
        tables[name] = train.sparkSession.createDataFrame(
            [(r["feature"], r["pos"], float(r["score"])) for r in t.collect()], "feature string, pos int, score double")
        if timings is not None:
            timings[name] = time.perf_counter() - t0
    return union_scores(tables)


def select_features(train: DataFrame, val: DataFrame | None, features: Sequence[str], label: str, row_id: str,
                    settings: SelectionSettings = SelectionSettings(), seed: int = 42) -> FeatureSelection:
    """Filter, rank, vote, choose the subset size and freeze the list."""
    timings: dict[str, float] = {}
    flt = RedundancyFilter(settings).fit(train, features, row_id, seed)
    scores = score_rankers(train, flt.kept, label, row_id, settings, seed, timings)
    votes = fuse_rankings(scores, settings.rankers, settings.top_k, settings.vote_threshold)
    if val is None:
        return FeatureSelection(flt, scores, votes, None, pool_of(votes), timings)
    n, curve = select_size(votes, train, val, label, row_id, settings, seed)
    return FeatureSelection(flt, scores, votes, curve, pool_of(votes)[:n], timings)


def stability(train: DataFrame, features: Sequence[str], label: str, row_id: str, size: int,
              settings: SelectionSettings = SelectionSettings(), seed: int = 42) -> DataFrame:
    """Share of reruns on stratified subsamples that pick a feature."""
    total = train.count()
    picks = []
    for run in range(settings.stability_runs):
        s = seed + 1000 * (run + 1)
        sub = stratified_sample(train, label, int(total * settings.stability_frac), s, [row_id], 5)
        votes = fuse_rankings(score_rankers(sub, features, label, row_id, settings, s), settings.rankers,
                              settings.top_k, settings.vote_threshold)
        picks += [(f,) for f in pool_of(votes)[:size]]
    chosen = train.sparkSession.createDataFrame(picks, "feature string")
    base = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    freq = chosen.groupBy("feature").agg((F.count(F.lit(1)) / settings.stability_runs).alias("frequency"))
    return base.join(freq, "feature", "left").select("feature", F.coalesce("frequency", F.lit(0.0)).alias("frequency"))


def recipes_of(settings: SelectionSettings) -> list[Recipe]:
    """The recipes of the settings and, if asked for, those that leave a ranker out."""
    out = list(settings.recipes)
    if settings.leave_one_out and len(settings.rankers) > 1:
        out += [Recipe(f"without {r}", tuple(x for x in settings.rankers if x != r), max(1, settings.vote_threshold - 1), "pool")
                for r in settings.rankers]
    return out


def recipe_features(recipe: Recipe, scores: DataFrame, size: int, settings: SelectionSettings = SelectionSettings()) -> list[str]:
    """The ``size`` features a recipe gives; rankers without scores are left out, none if no score is there."""
    if recipe.read == "all":
        return [r["feature"] for r in scores.groupBy("feature").agg(F.min("pos").alias("p")).orderBy("p").collect()]
    scored = {r["ranker"] for r in scores.select("ranker").distinct().collect()}
    names = [r for r in recipe.rankers or settings.rankers if r in scored]
    if not names:
        return []
    votes = settings.vote_threshold if recipe.votes is None else recipe.votes
    table = fuse_rankings(scores.filter(F.col("ranker").isin(names)), names,
                          size if len(names) == 1 else settings.top_k, votes)
    if recipe.read == "pool":
        return pool_of(table)[:size]
    order = ("place",) if recipe.read == "place" else (F.col("votes").desc(), "place")
    rows = table.filter("votes > 0" if len(names) == 1 else "true") if recipe.read == "place" else table.filter("in_pool = 1")
    return [r["feature"] for r in rows.orderBy(*order).limit(size).collect()]


def comparison_scores(scores: DataFrame, train: DataFrame, features: Sequence[str], label: str, size: int) -> DataFrame:
    """``scores`` with those of the comparison's own rankers, correlation and principal components."""
    own = {"pearson": rank_pearson(train, features, label),
           "pca": rank_pca(train, features, components=min(size, len(features)) or 1)}
    for name, t in own.items():
        scores = scores.unionByName(t.select(F.lit(name).alias("ranker"), "feature", "pos", "score"))
    return cut_lineage(scores)


def ablation_subsets(scores: DataFrame, size: int, settings: SelectionSettings = SelectionSettings()) -> dict[str, list[str]]:
    """Feature lists of the comparison experiments by name, those that are not empty."""
    found = {r.name: recipe_features(r, scores, size, settings) for r in recipes_of(settings)}
    return {name: features for name, features in found.items() if features}


def ablations(subsets: Mapping[str, Sequence[str]], train: DataFrame, parts: Mapping[str, DataFrame], label: str,
              row_id: str, settings: SelectionSettings = SelectionSettings(), seed: int = 42) -> DataFrame:
    """Probe scores of every subset on each part."""
    minority = minority_classes(train, label)
    rows, every = [], list(dict.fromkeys(f for feats in subsets.values() for f in feats))
    sample = probe_rows(train, every, label, row_id, settings, seed)
    for name, feats in subsets.items():
        model = fit_probe(sample, feats, label, settings, seed)
        for part, df in parts.items():
            s = probe_scores(model, df, feats, label, minority)
            rows.append((name, part, len(feats), s["macro_f1"], s["weighted_f1"], s["minority_recall"]))
    return train.sparkSession.createDataFrame(
        rows, "experiment string, part string, n_features int, macro_f1 double, weighted_f1 double, minority_recall double")


def sensitivity_pools(scores: DataFrame, rankers: Sequence[str], ks: Sequence[int], etas: Sequence[int],
                      sizes: Sequence[int]) -> DataFrame:
    """Pool size for every (K, eta, N), with a note where the pool is too small."""
    grid = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(e).alias("eta"), F.lit(n).alias("N"))
                     for k in ks for e in etas for n in sizes])
    w = Window.partitionBy("ranker").orderBy(F.col("score").desc(), "pos")
    ranked = scores.filter("score > 0").withColumn("rank", F.row_number().over(w))
    hits = ranked.select("feature", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("K")).filter(
        F.col("rank") <= F.col("K")).groupBy("K", "feature").agg(F.count(F.lit(1)).alias("votes"))
    pools = hits.select("K", "votes", F.explode(F.array(*[F.lit(e) for e in etas])).alias("eta")).groupBy(
        "K", "eta").agg(F.sum((F.col("votes") >= F.col("eta")).cast("int")).alias("pool_size"))
    cells = scores.sparkSession.range(1).select(F.explode(grid).alias("g")).select("g.*")
    return cells.join(F.broadcast(pools), ["K", "eta"], "left").select(
        "K", "eta", "N", F.coalesce("pool_size", F.lit(0)).alias("pool_size"),
        F.when(F.coalesce("pool_size", F.lit(0)) < F.col("N"), "pool smaller than N").otherwise("").alias("note"))


def sensitivity(scores: DataFrame, train: DataFrame, val: DataFrame, label: str, row_id: str, ks, etas, sizes,
                settings: SelectionSettings = SelectionSettings(), seed: int = 42) -> DataFrame:
    """Validation macro-F1 over the grid; NULL where the pool is too small."""
    pools = sensitivity_pools(scores, settings.rankers, ks, etas, sizes)
    rows, seen, sample = [], {}, None
    for r in pools.collect():
        f1 = None
        if not r["note"]:
            feats = tuple(pool_of(fuse_rankings(scores, settings.rankers, r["K"], r["eta"]))[:r["N"]])
            if feats not in seen:
                if sample is None:
                    every = [x["feature"] for x in scores.select("feature").distinct().collect()]
                    sample = probe_rows(train, every, label, row_id, settings, seed)
                model = fit_probe(sample, feats, label, settings, seed)
                seen[feats] = probe_scores(model, val, feats, label, [])["macro_f1"]
            f1 = seen[feats]
        rows.append((r["K"], r["eta"], r["N"], r["pool_size"], f1, r["note"]))
    return train.sparkSession.createDataFrame(
        rows, "K int, eta int, N int, pool_size long, val_macro_f1 double, note string")


