"""Samples drawn by md5 order: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import hash_slice, seeded_order
from flowmine.operators.blocks import cut_rows, smallest_by_hash, time_block
from flowmine.operators.sessions import session_table


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement (all rows when there are fewer)."""
    work = (df.withColumn("__one", F.lit(0))
            .withColumn("__d", seeded_order(seed, *[F.col(k) for k in keys])))
    wanted = df.sparkSession.range(1).select(F.lit(0).alias("__one"), F.lit(int(n)).alias("n"))
    return smallest_by_hash(work, ["__one"], "__d", wanted).drop("__one", "__d")


def stratified_allocation(counts: DataFrame, label: str, max_rows: int, floor: int = 1) -> DataFrame:
    """Rows to take per class: proportional, floored, largest classes trimmed."""
    everything = Window.partitionBy()
    c = counts.withColumn("__all", F.sum("n").over(everything))
    share = F.floor(F.col("n") / F.col("__all") * F.lit(int(max_rows))).cast("long")
    c = c.withColumn("__a", F.least(
        F.greatest(F.least(F.col("n"), F.lit(int(floor))), share), F.col("n")))
    c = c.withColumn("__over", F.greatest(F.sum("__a").over(everything) - F.lit(int(max_rows)), F.lit(0)))
    c = c.withColumn("__room", F.greatest(F.col("__a") - F.lit(int(floor)), F.lit(0)))
    before = F.coalesce(F.sum("__room").over(
        Window.orderBy(F.col("__a").desc(), F.col(label)).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    take = F.greatest(F.least(F.col("__over") - before, F.col("__room")), F.lit(0))
    return (c.withColumn("take", take)
            .select(label, "n", F.when(F.col("__all") <= int(max_rows), F.col("n"))
                    .otherwise(F.col("__a") - F.col("take")).cast("long").alias("alloc")))


def stratified_sample(df: DataFrame, label: str, max_rows: int | None, seed: int,
                      keys: Sequence[str], floor: int = 1) -> DataFrame:
    """Class-capped sample; no class falls below ``floor`` rows (or its size)."""
    if max_rows is None:
        return df
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    alloc = stratified_allocation(counts, label, max_rows, floor)
    work = df.withColumn("__d", seeded_order(seed, *[F.col(k) for k in keys]))
    return smallest_by_hash(work, [label], "__d",
                            alloc.select(label, F.col("alloc").alias("n"))).drop("__d")


def cap_class(df: DataFrame, label: str, cap: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows of the largest class (ties: first by name)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    top = counts.select(F.max_by(label, F.struct(F.col("size"), F.lit(0))).alias("m"),
                        F.max("size").alias("s"))
    first = counts.join(F.broadcast(top), F.col("size") == F.col("s")).agg(F.min(label).alias("m"))
    wanted = counts.join(F.broadcast(first), F.col(label) == F.col("m"), "left").select(
        label, F.when(F.col("m").isNotNull(), F.least(F.col("size"), F.lit(int(cap))))
        .otherwise(F.col("size")).alias("n"))
    work = df.withColumn("__d", seeded_order(seed, *[F.col(k) for k in keys]))
    return smallest_by_hash(work, [label], "__d", wanted).drop("__d")


def holdout(df: DataFrame, label: str, frac: float, seed: int, keys: Sequence[str],
            name: str = "holdout") -> DataFrame:
    """Mark a share of each class (``floor(n * frac)`` rows) as held out."""
    work = df.withColumn("__d", seeded_order(seed, *[F.col(k) for k in keys]))
    wanted = (df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
              .select(label, F.floor(F.col("__n") * F.lit(frac)).cast("long").alias("n")))
    targets = wanted.filter("n > 0").select(label, F.lit("n").alias("cut"), F.col("n").alias("target"))
    cuts = cut_rows(work.withColumn("__slice", hash_slice(F.col("__d"))), [label], ["__d"], "__slice",
                    F.lit(1), targets, {"__cut": F.col("__d")}).drop("cut")
    return (work.join(F.broadcast(cuts), label, "left")
            .withColumn(name, F.coalesce(F.col("__d") <= F.col("__cut"), F.lit(False)))
            .drop("__d", "__cut"))


def subsample_sessions(df: DataFrame, session: str, ts: str, label: str, classes: Sequence[str],
                       frac: float, min_rows: int, order: str = "time", seed: int = 42,
                       block_s: int = 3600) -> DataFrame:
    """Whole sessions per class until the wanted row count is reached.

    Earliest sessions first, or in random order; the session that crosses the
    target is kept.
    """
    sessions = session_table(df, session, ts, label, classes)
    if order == "random":
        sessions = sessions.withColumn("__o", seeded_order(seed, F.col(session)))
        sessions = sessions.withColumn("__blk", hash_slice(F.col("__o")))
    else:
        sessions = sessions.withColumn("__o", F.col("start_us")).withColumn(
            "__blk", time_block(F.col("start_us"), block_s))
    total = sessions.groupBy("primary_class").agg(F.sum("n_flows").alias("__t"))
    goal = F.greatest(F.lit(int(min_rows)), F.floor(F.col("__t") * F.lit(frac)))
    targets = total.select("primary_class", F.lit("x").alias("cut"),
                           F.least(goal, F.col("__t")).alias("target"))
    cuts = cut_rows(sessions, ["primary_class"], ["__o", session], "__blk", F.col("n_flows"),
                    targets, {"__cut": F.struct("__o", session)}).drop("cut")
    kept = (sessions.join(F.broadcast(cuts), "primary_class")
            .filter(F.struct("__o", session) <= F.col("__cut")).select(session))
    return df.join(kept, session, "left_semi")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
