"""Slices of bounded row count for the few groups that are too large for one task.

A count with map-side combine finds the *hot* groups, those of more than ``rows``
rows. Without any, a plain window per group is the cheapest plan and nothing else
is done. Otherwise the rows of hot groups alone are sampled by a hash of their
order, every ``PER_SLICE``-th sampled row becomes a splitter, and a row's slice is
the number of splitters at or before it, found by binary search. A slice of a hot
group then holds about ``rows`` rows wherever they lie in time (more than twice as
many with a probability under 1e-10); rows equal in the whole order share one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.operators.blocks import BROADCAST_ROWS
from flowmine.session import cut_lineage

#: Rows that one task takes of a group, and sampled rows for each of them.
SLICE_ROWS, PER_SLICE = 1_000_000, 64
_SCALE = 1 << 40


def _hot_groups(df: DataFrame, group: Sequence[str], rows: int) -> DataFrame | None:
    """(group, n) of the groups with more than ``rows`` rows, None if there are none."""
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows)
    found = large.limit(BROADCAST_ROWS + 1).collect()
    if not found:
        return None
    if len(found) > BROADCAST_ROWS:
        return cut_lineage(large)
    return F.broadcast(df.sparkSession.createDataFrame(found, large.schema))


def _key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def splitters_before(splits: Column, key: Column) -> Column:
    """How many of the sorted ``splits`` are at or before ``key``; 0 for a null array."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(splits) + F.lit(1.0))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("low"), F.size(splits).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        past = (s["low"] < s["high"]) & (F.get(splits, middle) <= key)
        return F.struct(F.when(past, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(past | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))
    found = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(splits.isNull(), F.lit(0)).otherwise(found).cast("long")


def sliced(df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS,
           name: str = "__blk") -> tuple[DataFrame, str | None]:
    """``df`` with the slice number in ``name``, and that name; or ``df`` and None if no group needs slices.

    ``group`` columns must not be NULL. Slice numbers never fall as the order grows.
    """
    hot = _hot_groups(df, group, rows)
    if hot is None:
        return df, None
    share = min(1.0, PER_SLICE / rows)
    drawn = F.pmod(F.xxhash64(*group, *order), F.lit(_SCALE)) < F.lit(int(share * _SCALE))
    sample = df.filter(drawn).join(hot, list(group)).select(*group, _key(order).alias("__s"))
    every = max(1, round(share * rows))
    ranked = sample.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy("__s")))
    splits = cut_lineage(ranked.filter(F.col("__r") % every == 0).groupBy(*group).agg(
        F.sort_array(F.collect_list("__s")).alias("__splits")))
    marked = df.join(splits, list(group), "left")
    return marked.withColumn(name, splitters_before(F.col("__splits"), _key(order))).drop("__splits"), name
