"""Per-session windows, previous states and event sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import micros, quote
from flowmine.operators.blocks import add_lag, add_previous_rows
from flowmine.operators.slices import SLICE_ROWS, sliced


def session_windows(df: DataFrame, session: str, ts: str, tie: Sequence[str], features: Sequence[str],
                    length: int, name: str = "window", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Last ``length`` rows of the session at each row, oldest first.

    Short histories are padded with zero rows on the left; no window crosses
    into another session.
    """
    work = df.withColumn("__us", micros(F.col(ts)))
    step = F.array(*[quote(c).cast("double") for c in features])
    if length > 1:
        work, block = sliced(work, [session], ["__us", *tie], slice_rows)
        work = add_previous_rows(work, [session], ["__us", *tie], block, step, length - 1, "__before")
        seen = F.concat(F.col("__before"), F.array(step))
    else:
        seen = F.array(step)
    zero = F.array(*[F.lit(0.0) for _ in features])
    padded = F.concat(F.array_repeat(zero, F.lit(length) - F.size(seen)), seen)
    return work.withColumn(name, padded).drop("__us", "__blk", "__before")


def previous_state(df: DataFrame, session: str, ts: str, tie: Sequence[str], event: Column,
                   name: str = "prev_state", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Event of the previous row of the session, NULL on the first."""
    work, block = sliced(df.withColumn("__us", micros(F.col(ts))), [session], ["__us", *tie], slice_rows)
    return add_lag(work, [session], ["__us", *tie], block, {name: event}).drop("__us", "__blk")


def event_sequences(df: DataFrame, unit: str, ts: str, tie: Sequence[str], event: Column,
                    max_len: int = 50) -> DataFrame:
    """Most recent ``max_len`` events of every unit, in time order.

    The rank filter is applied on each input partition first, so a busy unit
    sends only its own ``max_len`` rows per partition.
    """
    rows = df.select(unit, micros(F.col(ts)).alias("__us"), *tie, event.cast("string").alias("__e"))
    recent = Window.partitionBy(unit).orderBy(F.col("__us").desc(), *[F.col(c).desc() for c in tie])
    kept = rows.withColumn("__rk", F.row_number().over(recent)).filter(F.col("__rk") <= int(max_len))
    return kept.groupBy(unit).agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("__rk")).alias("o"), F.col("__e").alias("e")))),
        lambda s: s["e"]).alias("events"))
