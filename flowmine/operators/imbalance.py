"""Class weights, oversampling with small-class rules, neighbourhood cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import hash_unit, seeded_order
from flowmine.operators.blocks import smallest_by_hash
from flowmine.operators.neighbors import nearest
from flowmine.operators.sampling import cap_class
from flowmine.session import cut_lineage
from flowmine.settings import ImbalanceSettings


def class_weights(df: DataFrame, label: str, classes: Sequence | None = None) -> DataFrame:
    """(label, n, weight = N / (C * n)); classes that do not occur get 0."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        kind = df.schema[label].dataType.simpleString()
        grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])).alias(label))
        counts = grid.join(F.broadcast(counts), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", F.when(F.col("n") > 0, F.sum("n").over(every) / (
        F.count(F.lit(1)).over(every) * F.col("n"))).otherwise(F.lit(0.0)).alias("weight"))


def row_weights(df: DataFrame, label: str, weights: DataFrame, name: str = "weight") -> DataFrame:
    """Weight of each row's class; an unknown class weighs 1."""
    w = weights.select(label, F.col("weight").alias("__w"))
    return df.join(F.broadcast(w), label, "left").withColumn(name, F.coalesce("__w", F.lit(1.0))).drop("__w")


def oversampling_plan(counts: DataFrame, label: str, settings: ImbalanceSettings = ImbalanceSettings()) -> DataFrame:
    """Per class: target, method and number of neighbours, from a count table."""
    every = Window.partitionBy()
    s = settings
    top = F.max("n").over(every)
    goal = top if s.target_strategy == "full" else F.least(top, F.greatest(
        F.col("n"), F.ceil(F.col("n") * F.lit(float(s.max_oversample_ratio)))))
    big = F.col("n") >= s.min_samples_for_smote
    t = counts.select(label, "n", goal.cast("long").alias("target"), big.alias("__big"))
    k = F.when(F.col("__big"), F.least(F.lit(s.k_neighbors), F.col("n") - 1))
    enough = F.sum(F.col("__big").cast("int")).over(every) >= 2
    t = t.withColumn("k", k.cast("int")).withColumn("k_eff", F.greatest(
        F.lit(1), F.least(F.lit(s.k_neighbors), F.min("k").over(every))).cast("int"))
    method = (F.when(F.col("__big") & enough & (F.col("n") < F.col("target")), "smote")
              .when(~F.col("__big") & (F.col("n") < F.col("target")), s.small_class_fallback).otherwise("none"))
    return t.withColumn("method", method).drop("__big")


def copies(df: DataFrame, label: str, row_id: str, plan: DataFrame, seed: int) -> DataFrame:
    """Each row once per extra copy it owes its class (column ``copy`` = 1, 2, ...).

    Copies are spread evenly; the remainder goes to the rows first in md5 order.
    """
    need = plan.select(label, F.floor((F.col("target") - F.col("n")) / F.col("n")).alias("__each"),
                       ((F.col("target") - F.col("n")) % F.col("n")).alias("__rest"), "k_eff")
    rows = df.join(F.broadcast(need), label).withColumn("__d", seeded_order(seed, F.col(row_id)))
    extra = smallest_by_hash(rows.filter("__rest > 0").select(row_id, label, "__d"), [label], "__d",
                             need.filter("__rest > 0").select(label, F.col("__rest").alias("n"))).select(
        row_id, F.lit(1).alias("__one"))
    out = rows.join(extra, row_id, "left").withColumn(
        "__copies", F.col("__each") + F.coalesce("__one", F.lit(0)))
    return (out.filter("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .drop("__each", "__rest", "__d", "__one", "__copies"))


def random_oversample(df: DataFrame, label: str, row_id: str, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Copies of real rows up to the target of their class."""
    chosen = plan.filter("method = 'random_oversample'")
    return copies(df, label, row_id, chosen, seed).drop("k_eff").withColumn(
        row_id, F.concat_ws("+", F.col(row_id).cast("string"), F.col("copy").cast("string"))).drop("copy")


def smote(df: DataFrame, label: str, row_id: str, vector: str, plan: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """New rows on segments between a row and one of its ``k`` same-class neighbours."""
    chosen = plan.filter("method = 'smote'")
    part = df.join(F.broadcast(chosen.select(label)), label, "left_semi")
    near = nearest(part, k, row_id, vector, label, within=label, with_vectors=True).withColumnRenamed("id", "__id")
    seeds = copies(part, label, row_id, chosen, seed).withColumn("__id", F.col(row_id).cast("string")).join(near, "__id")
    h = seeded_order(f"{seed}s", F.col(row_id), F.col("copy"))
    pick = F.get("neighbours", F.floor(hash_unit(F.col("__h"), 1) * F.size("neighbours")).cast("int"))["other_x"]
    u = hash_unit(F.col("__h"), 9)
    new = seeds.withColumn("__h", h).withColumn("__nb", pick).withColumn("__u", u)
    mixed = F.zip_with(vector, "__nb", lambda a, b: a + F.col("__u") * (b - a))
    return new.select(F.concat_ws("~", F.col(row_id).cast("string"), F.col("copy").cast("string")).alias(row_id),
                      label, mixed.alias(vector))


def edited_neighbours(df: DataFrame, label: str, row_id: str, vector: str, k: int = 3) -> DataFrame:
    """Rows whose ``k`` nearest rows all share their class; the smallest class stays whole."""
    near = nearest(df, k, row_id, vector, label).withColumnRenamed("id", "__id")
    small = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by(label, F.struct("n", label)).alias("__small"))
    rows = df.withColumn("__id", F.col(row_id).cast("string")).join(near, "__id", "left").join(F.broadcast(small))
    agree = F.forall("neighbours", lambda s: s["other_y"] == F.col(label))
    return rows.filter((F.col(label) == F.col("__small")) | F.coalesce(agree, F.lit(True))).select(*df.columns)


def restore_lost(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Rows of ``before`` of every class that ``after`` no longer holds."""
    left = after.select(label).distinct()
    return before.join(F.broadcast(left), label, "left_anti").select(*before.columns)


def resample_report(before: DataFrame, after: DataFrame, plan: DataFrame, restored: DataFrame, label: str) -> DataFrame:
    """Counts before and after, method, neighbours and restored rows per class."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("after"))
    r = restored.groupBy(label).agg(F.count(F.lit(1)).alias("restored"))
    p = plan.select(label, "method", "k", "target")
    out = b.join(a, label, "full_outer").join(p, label, "left").join(r, label, "left")
    return out.select(label, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after", "restored")],
                      "method", "k", "target")


@dataclass
class Resampled:
    rows: DataFrame
    weights: DataFrame | None = None
    report: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def smote_enn(df: DataFrame, label: str, row_id: str, vector: str,
              settings: ImbalanceSettings = ImbalanceSettings(), seed: int = 42, stage=cut_lineage) -> Resampled:
    """Oversample, clean, restore: every row, unless ``majority_cap`` bounds the largest class."""
    s, notes = settings, []
    base = df.select(F.col(row_id).cast("string").alias(row_id), label, vector)
    if s.majority_cap:
        base = cap_class(base, label, s.majority_cap, seed, [row_id])
    base = stage(base)
    plan = stage(oversampling_plan(base.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, s))
    info = plan.collect()   # one row per class
    cols = [row_id, label, vector]
    full = base.select(*cols)
    if any(r["method"] == "smote" for r in info):
        k_eff = min(r["k_eff"] for r in info)
        full = full.unionByName(smote(base, label, row_id, vector, plan, k_eff, seed).select(*cols))
    else:
        notes.append("no class oversampled by interpolation")
    if any(r["method"] == "random_oversample" for r in info):
        full = full.unionByName(random_oversample(base, label, row_id, plan, seed).select(*cols))
    full = stage(full)
    kept = stage(edited_neighbours(full, label, row_id, vector, s.enn_neighbors))
    lost = restore_lost(full, kept, label) if s.protect_rare_classes else full.limit(0)
    out = kept.unionByName(lost)
    return Resampled(out, None, resample_report(df, out, plan, lost, label), notes)


def handle_imbalance(df: DataFrame, label: str, row_id: str, vector: str,
                     settings: ImbalanceSettings = ImbalanceSettings(), classes: Sequence | None = None,
                     seed: int = 42) -> Resampled:
    """``none``, ``class_weight``, ``smote_enn`` or ``both`` (weights after resampling)."""
    mode = settings.mode
    if mode not in ("none", "class_weight", "smote_enn", "both"):
        raise ValueError(f"unknown imbalance mode {mode!r}")
    out = smote_enn(df, label, row_id, vector, settings, seed) if mode in ("smote_enn", "both") else Resampled(df)
    if mode in ("class_weight", "both"):
        out.weights = class_weights(out.rows, label, classes)
    return out
