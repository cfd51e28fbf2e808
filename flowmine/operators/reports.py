"""Distribution tables, cleaning report and the data behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import INF, plus, quote

PARTS = ("train", "val", "test", "gap")


def class_grid(df: DataFrame, classes: Sequence[str], name: str = "class") -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{name} string, pos int")


def class_distribution(df: DataFrame, raw: str, group: str) -> DataFrame:
    """Raw label, class, records and share in percent (four decimals)."""
    t = df.groupBy(raw, group).agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy())
    return t.select(F.col(raw).alias("raw_label"), F.col(group).alias("grouped_class"), "records",
                    F.round(F.col("records") / total * 100, 4).alias("pct"))


def split_distribution(df: DataFrame, label: str, classes: Sequence[str], split: str = "split") -> DataFrame:
    """Rows per class and part, zero-filled, in class order."""
    counts = df.groupBy(F.col(label).alias("class")).agg(
        *[F.count(F.when(F.col(split) == p, 1)).alias(p) for p in PARTS])
    grid = class_grid(df, classes)
    filled = grid.join(F.broadcast(counts), "class", "left").orderBy("pos").select(
        "class", *[F.coalesce(p, F.lit(0)).alias(p) for p in PARTS])
    return filled.withColumn("total", plus([F.col(p) for p in PARTS]))


def grouped_totals(distribution: DataFrame) -> DataFrame:
    return (distribution.groupBy("grouped_class").agg(F.sum("records").alias("records"))
            .orderBy(F.col("records").desc(), "grouped_class"))


def cleaning_report(df: DataFrame, features: Sequence[str], sentinels: Sequence[str], session: str,
                    ts: str, label: str, content: Sequence[str]) -> DataFrame:
    """One row: rows, duplicates, infinities, negatives, sentinels, sessions, time range."""
    def count_if(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    inf = plus([F.coalesce((F.abs(quote(c)) == F.lit(INF)).cast("long"), F.lit(0)) for c in features])
    neg_cols = [c for c in features if c not in sentinels]
    neg = plus([F.coalesce(((quote(c) < 0) & (quote(c) > -INF)).cast("long"), F.lit(0)) for c in neg_cols])
    keep = [c for c in sentinels if c in features]
    kept = plus([F.coalesce((quote(c) < 0).cast("long"), F.lit(0)) for c in keep]) if keep else F.lit(0)
    # Copies are folded first, so every later figure is over distinct rows.
    folded = df.groupBy(*[quote(c) for c in content]).agg(
        F.count(F.lit(1)).alias("__copies"), F.min(F.col(ts)).alias("__ts")) if ts not in content else \
        df.groupBy(*[quote(c) for c in content]).agg(F.count(F.lit(1)).alias("__copies"),
                                                     F.first(F.col(ts)).alias("__ts"))
    main = folded.agg(
        F.sum("__copies").alias("rows_in"), F.count(F.lit(1)).alias("rows_out"),
        F.sum(inf).alias("inf_cells"), F.sum(neg).alias("negative_cells"),
        F.sum(kept).alias("sentinels_kept"),
        F.unix_micros(F.min("__ts")).alias("first_us"), F.unix_micros(F.max("__ts")).alias("last_us"))
    n_sessions = df.groupBy(session).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("sessions"))
    return main.join(F.broadcast(n_sessions)).select(
        "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("duplicates"),
        "inf_cells", "negative_cells", "sentinels_kept", "sessions", "first_us", "last_us")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order (a figure's bars)."""
    return df.orderBy(*order).limit(n)


def histogram(df: DataFrame, value: str, bins: int, *extra: Column) -> DataFrame:
    """Counts over equal bins of [0, 1]; the value 1 falls in the last bin."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *extra)


def calibration_change(df: DataFrame, before: str, after: str, truth: str, n_bins: int = 15,
                       weight: str | None = None) -> DataFrame:
    """Calibration error and Brier score of two probability columns, side by side.

    With ``weight`` a row stands for that many (``metrics.counted_rows``).
    """
    from flowmine.operators import metrics
    out = None
    for tag, col in (("before", before), ("after", after)):
        ece = metrics.calibration_error(metrics.confidence_bins(df, col, truth, n_bins, weight=weight))
        part = ece.join(F.broadcast(metrics.brier(df, col, truth, weight=weight))).select(
            F.round("ece", 6).alias(f"ece_{tag}"), F.round("brier", 6).alias(f"brier_{tag}"))
        out = part if out is None else out.join(F.broadcast(part))
    return out
