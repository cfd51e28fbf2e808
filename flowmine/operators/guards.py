"""Leakage guards: each returns violations ``(guard, n, example)``, empty if clean."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.arrays import array_sum
from flowmine.functions.columns import micros


class LeakageError(AssertionError):
    """A split, fit or probability table breaks a guard."""


def _report(bad: DataFrame, guard: str, example: Column) -> DataFrame:
    return (bad.agg(F.count(F.lit(1)).alias("n"), F.min(example.cast("string")).alias("example"))
            .filter(F.col("n") > 0).select(F.lit(guard).alias("guard"), "n", "example"))


def disjoint(df: DataFrame, row_id: str, split: str = "split") -> DataFrame:
    """A row may sit in one partition only."""
    parts = df.filter(F.col(split).isin("train", "val", "test"))
    bad = (parts.groupBy(row_id).agg(F.min(split).alias("a"), F.max(split).alias("b"))
           .filter(F.col("a") != F.col("b")))
    return _report(bad, "splits_disjoint", F.col(row_id))


def sessions_whole(df: DataFrame, session: str, split: str = "split",
                   exempt: str | None = "exempt") -> DataFrame:
    """A session may sit in one partition only, unless it is exempt."""
    parts = df.filter(F.col(split).isin("train", "val", "test"))
    if exempt:
        parts = parts.filter(~F.col(exempt))
    bad = (parts.groupBy(session).agg(F.min(split).alias("a"), F.max(split).alias("b"))
           .filter(F.col("a") != F.col("b")))
    return _report(bad, "sessions_whole", F.col(session))


def time_ordered(df: DataFrame, ts: str, group: str = "assign_group", split: str = "split") -> DataFrame:
    """Per group: train ends before val starts, val before test (ties allowed)."""
    us, s = micros(F.col(ts)), F.col(split)
    g = df.groupBy(group).agg(
        F.max(F.when(s == "train", us)).alias("tr_max"),
        F.min(F.when(s == "val", us)).alias("va_min"), F.max(F.when(s == "val", us)).alias("va_max"),
        F.min(F.when(s == "test", us)).alias("te_min"))
    bad = g.filter(F.col("tr_max").isNotNull() & F.col("te_min").isNotNull() & (
        (F.col("te_min") < F.col("tr_max"))
        | F.coalesce(F.col("va_min") < F.col("tr_max"), F.lit(False))
        | F.coalesce(F.col("te_min") < F.col("va_max"), F.lit(False))))
    return _report(bad, "time_ordering", F.col(group))


def fitted_on_train(fitted: DataFrame, df: DataFrame, row_id: str, split: str = "split") -> DataFrame:
    """Every fitted row must be a train row."""
    train = df.filter(F.col(split) == "train").select(row_id)
    return _report(fitted.select(row_id).join(train, row_id, "left_anti"), "fit_on_train_only",
                   F.col(row_id))


def not_resampled(before: DataFrame, after: DataFrame) -> DataFrame:
    """Evaluation partitions keep their row counts."""
    both = (before.select(F.lit(1).alias("b"), F.lit(0).alias("a"))
            .unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
            .agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")))
    return (both.filter(F.col("a") != F.col("b")).select(
        F.lit("eval_not_resampled").alias("guard"), F.abs(F.col("a") - F.col("b")).alias("n"),
        F.concat_ws("->", F.col("b").cast("string"), F.col("a").cast("string")).alias("example")))


def same_features(expected: Sequence[str], actual: Sequence[str], where: str = "") -> None:
    """The frozen feature list, in the same order."""
    if list(expected) != list(actual):
        raise LeakageError(f"frozen feature list differs at {where}: {list(expected)} / {list(actual)}")


def probabilities_valid(df: DataFrame, probs: str, row_id: str, tol: float = 1e-4,
                        sum_tol: float = 1e-3) -> DataFrame:
    """Finite, not below ``-tol`` and summing to one."""
    p = F.col(probs)
    broken = (F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < -tol))
              | (F.abs(array_sum(p) - 1.0) > sum_tol))
    return _report(df.filter(F.coalesce(broken, F.lit(True))), "probabilities_valid", F.col(row_id))


def weights_sum_to_one(df: DataFrame, weights: str, row_id: str, tol: float = 1e-6,
                       sum_tol: float = 1e-5) -> DataFrame:
    """Fusion weights are not negative and sum to one."""
    w = F.col(weights)
    broken = (F.exists(w, lambda x: x.isNull() | F.isnan(x) | (x < -tol))
              | (F.abs(array_sum(w) - 1.0) > sum_tol))
    return _report(df.filter(F.coalesce(broken, F.lit(True))), "weights_sum_to_one", F.col(row_id))


def combine(reports: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), reports)


def split_guards(df: DataFrame, row_id: str, session: str, ts: str,
                 strategy: str = "time_blocked", fitted: DataFrame | None = None) -> DataFrame:
    """All guards that apply to a split, as one violations table."""
    reports = [disjoint(df, row_id)]
    if strategy != "stratified_flow":
        reports.append(sessions_whole(df, session))
    if strategy in ("time_blocked", "leave_family_out"):
        reports.append(time_ordered(df, ts))
    if fitted is not None:
        reports.append(fitted_on_train(fitted, df, row_id))
    return combine(reports)


def enforce(violations: DataFrame) -> None:
    """Raise when any guard reports rows."""
    bad = violations.collect()
    if bad:
        raise LeakageError("; ".join(f"{r['guard']}: {r['n']} (e.g. {r['example']})" for r in bad))
