"""Ordered per-group operators that stay balanced when one group is huge.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here a
key is cut into *blocks* (time slices, hash slices or value ranges that follow
the wanted order). Rows are partitioned by (key, block), a small table with one
row per non-empty (key, block) carries the running state from block to block,
and is joined back on the same two columns. The shuffle of the rows is the same
one the plain window needs; only the summary is shuffled besides. Operators that
get no block column (see ``slices``) are that plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import hash_slice
from flowmine.session import cut_lineage

#: Rows up to which a small table is broadcast.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A summary to join with: computed once, broadcast if it has at most ``limit`` rows, joined by shuffle if not."""
    found = df.limit(limit + 1).collect()
    if len(found) > limit:
        return cut_lineage(df)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def time_block(t_us: Column, seconds: int) -> Column:
    """Number of the time slice an instant falls in."""
    return F.floor(t_us / F.lit(int(seconds) * 1_000_000)).cast("long")


def _earlier(group: Sequence[str], block: str):
    return (Window.partitionBy(*group).orderBy(block)
            .rowsBetween(Window.unboundedPreceding, -1))


def add_lag(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str | None,
            cols: Mapping[str, Column]) -> DataFrame:
    """Values of the previous row of the group, NULL on its first row."""
    names = list(cols)
    if block is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({n: F.lag(cols[n]).over(w) for n in names})
    payload = F.struct(*[cols[n].alias(n) for n in names])
    last = (df.groupBy(*group, block)
            .agg(F.max_by(payload, F.struct(*order)).alias("__last")))
    w = Window.partitionBy(*group).orderBy(block)
    carry = last.select(*group, block, F.lag("__last").over(w).alias("__carry"))
    inside = Window.partitionBy(*group, block).orderBy(*order)
    out = (df.join(carry, [*group, block], "left")
           .withColumn("__prev", F.coalesce(F.lag(payload).over(inside), F.col("__carry"))))
    for n in names:
        out = out.withColumn(n, F.col("__prev")[n])
    return out.drop("__prev", "__carry")


def add_running(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str | None,
                sums: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums in order within each group."""
    names = list(sums)
    if block is None:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(sums[n]).over(upto) for n in names})
    work = df
    for n in names:
        work = work.withColumn(f"__v_{n}", sums[n])
    totals = work.groupBy(*group, block).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    w = _earlier(group, block)
    offsets = totals.select(
        *group, block,
        *[F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(f"__o_{n}") for n in names])
    inside = (Window.partitionBy(*group, block).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = work.join(offsets, [*group, block], "left")
    for n in names:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside))
    return out.drop(*[f"__v_{n}" for n in names], *[f"__o_{n}" for n in names])


def _plain_runs(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column,
                is_break: Callable[[Column, Column], Column], opens_piece: Callable[[Column], Column]) -> DataFrame:
    """``ordered_runs`` by windows over whole groups."""
    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__val", value)
    rows = rows.withColumn("__rn", F.row_number().over(inside)).withColumn("__lagged", F.lag("__val").over(inside))
    rows = rows.withColumn("__brk", (F.col("__rn") == 1) | F.coalesce(
        is_break(F.col("__lagged"), F.col("__val")), F.lit(True)))
    rows = rows.withColumn("run_pos", (F.col("__rn") - F.max(F.when(F.col("__brk"), F.col("__rn"))).over(upto)).cast("long"))
    return rows.withColumn("run_no", F.sum(F.col("__brk").cast("long")).over(upto)).withColumn(
        "piece_no", F.sum((F.col("__brk") | opens_piece(F.col("run_pos"))).cast("long")).over(upto)).drop(
        "__val", "__rn", "__lagged", "__brk")


def ordered_runs(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str | None,
                 value: Column, is_break: Callable[[Column, Column], Column],
                 cap: int = 0, cap_mode: str = "block") -> DataFrame:
    """Cut each group into runs wherever ``is_break(previous, current)`` holds.

    Adds ``run_no`` (1, 2, ... within the group), ``run_pos`` (0, 1, ... within
    the run) and ``piece_no``, which numbers the pieces that remain when a run is
    also cut every ``cap`` rows ("block") or at each row past it ("singleton").

    Group and block must not be NULL. With blocks the source is read twice: once for the rows, once for a
    summary per (group, block) that says how many rows and breaks each block contributes.
    """
    def extra(pos: Column) -> Column:
        """Whether a row that continues a run opens a new piece."""
        if cap <= 0:
            return F.lit(False)
        return (pos >= cap) if cap_mode == "singleton" else (pos % cap == 0)

    if block is None:
        return _plain_runs(df, group, order, value, is_break, extra)
    inside = Window.partitionBy(*group, block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__val", value)
    rows = (rows.withColumn("__rn", F.row_number().over(inside))
            .withColumn("__lagged", F.lag("__val").over(inside)))
    rows = rows.withColumn("__brk", (F.col("__rn") > 1) & F.coalesce(
        is_break(F.col("__lagged"), F.col("__val")), F.lit(True)))
    rows = rows.withColumn("__from", F.max(F.when(F.col("__brk"), F.col("__rn"))).over(upto))
    inner = F.col("__from").isNotNull() & (
        F.col("__brk") | extra(F.col("__rn") - F.col("__from")))
    summary = rows.groupBy(*group, block).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by("__val", F.struct(*order)).alias("__v0"),
        F.max_by("__val", F.struct(*order)).alias("__v1"),
        F.sum(F.col("__brk").cast("long")).alias("__nb"),
        F.count(F.when(F.col("__from").isNull(), 1)).alias("__lead"),
        F.max("__from").alias("__lastbrk"),
        F.sum(inner.cast("long")).alias("__inner"))
    w = Window.partitionBy(*group).orderBy(block)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = (summary
         .withColumn("__rank", F.row_number().over(w))
         .withColumn("__pv", F.lag("__v1").over(w))
         .withColumn("__off", F.coalesce(F.sum("__n").over(past), F.lit(0))))
    s = s.withColumn("__b0", (F.col("__rank") == 1) | F.coalesce(
        is_break(F.col("__pv"), F.col("__v0")), F.lit(True)))
    # Rows of the group up to and including the last run start seen in the block.
    s = s.withColumn("__mark", F.coalesce(
        F.col("__off") + F.col("__lastbrk"), F.when(F.col("__b0"), F.col("__off") + 1)))
    s = s.withColumn("__p0", F.when(F.col("__b0"), F.lit(0)).otherwise(
        F.col("__off") + 1 - F.max("__mark").over(past)))
    end = F.col("__p0") + F.col("__lead")
    if cap <= 0:
        lead_new = F.col("__b0").cast("long")
    elif cap_mode == "singleton":
        lead_new = (F.col("__b0").cast("long") + F.greatest(end - cap, F.lit(0))
                    - F.greatest(F.col("__p0") - cap, F.lit(0)))
    else:
        lead_new = F.floor((end - 1) / cap) - F.floor((F.col("__p0") - 1) / cap)
    s = s.withColumn("__new", lead_new + F.col("__inner"))
    carry = s.select(
        *group, block, "__b0", "__p0",
        F.coalesce(F.sum(F.col("__nb") + F.col("__b0").cast("long")).over(past), F.lit(0)).alias("__or"),
        F.coalesce(F.sum("__new").over(past), F.lit(0)).alias("__on"))
    out = rows.join(carry, [*group, block])
    out = out.withColumn("run_pos", F.coalesce(
        F.col("__rn") - F.col("__from"), F.col("__p0") + F.col("__rn") - 1).cast("long"))
    opens = F.col("__brk") | ((F.col("__rn") == 1) & F.col("__b0"))
    out = out.withColumn("run_no", F.col("__or") + F.sum(opens.cast("long")).over(upto))
    out = out.withColumn("piece_no", F.col("__on") + F.sum(
        (opens | extra(F.col("run_pos"))).cast("long")).over(upto))
    return out.drop("__val", "__rn", "__lagged", "__brk", "__from", "__b0", "__p0", "__or", "__on")


def add_previous_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str | None,
                      payload: Column, k: int, name: str = "previous") -> DataFrame:
    """Array of up to ``k`` preceding rows' payloads, oldest first."""
    if block is None:
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(-k, -1)
        return df.withColumn(name, F.collect_list(payload).over(before))
    work = df.withColumn("__p", payload)
    desc = Window.partitionBy(*group, block).orderBy(*[F.col(c).desc() for c in order])
    tails = (work.withColumn("__rk", F.row_number().over(desc)).filter(F.col("__rk") <= k)
             .groupBy(*group, block)
             .agg(F.transform(
                 F.sort_array(F.collect_list(F.struct((-F.col("__rk")).alias("o"), F.col("__p").alias("p")))),
                 lambda s: s["p"]).alias("__tail")))
    # Every block holds at least one row, so k earlier blocks are enough.
    w = Window.partitionBy(*group).orderBy(block).rowsBetween(-k, -1)
    carry = tails.select(
        *group, block, F.flatten(F.collect_list("__tail").over(w)).alias("__carry"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(-k, -1)
    joined = work.join(carry, [*group, block], "left")
    both = F.concat(F.col("__carry"), F.collect_list("__p").over(inside))
    return (joined.withColumn("__all", both)
            .withColumn(name, F.when(F.size("__all") > k, F.slice("__all", -k, k))
                        .otherwise(F.col("__all")))
            .drop("__p", "__carry", "__all"))


def add_neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str | None, payload: Column,
                   k: int, before: str = "before", after: str = "after") -> DataFrame:
    """Arrays of up to ``k`` preceding and ``k`` following rows' payloads, both in order.

    A slice gets the last ``k`` rows before it and the first ``k`` behind it; each of
    up to ``k`` slices on either side may hold as little as one of them.
    """
    if block is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({before: F.collect_list(payload).over(w.rowsBetween(-k, -1)),
                               after: F.collect_list(payload).over(w.rowsBetween(1, k))})
    work = df.withColumn("__p", payload)
    inside = Window.partitionBy(*group, block).orderBy(*order)
    ranked = work.withColumn("__up", F.row_number().over(inside)).withColumn(
        "__down", F.count(F.lit(1)).over(Window.partitionBy(*group, block)) - F.col("__up") + 1)

    def gathered(rank: str, sign: int) -> Column:
        rows = F.collect_list(F.when(F.col(rank) <= k, F.struct((F.col(rank) * sign).alias("o"), F.col("__p").alias("p"))))
        return F.transform(F.sort_array(rows), lambda s: s["p"])

    ends = ranked.filter(F.least("__up", "__down") <= k).groupBy(*group, block).agg(
        gathered("__up", 1).alias("__head"), gathered("__down", -1).alias("__tail"))
    w = Window.partitionBy(*group).orderBy(block)
    ends = ends.select(*group, block, F.flatten(F.collect_list("__tail").over(w.rowsBetween(-k, -1))).alias("__left"),
                       F.flatten(F.collect_list("__head").over(w.rowsBetween(1, k))).alias("__right"))
    left = F.concat(F.col("__left"), F.collect_list("__p").over(inside.rowsBetween(-k, -1)))
    right = F.concat(F.collect_list("__p").over(inside.rowsBetween(1, k)), F.col("__right"))
    out = work.join(ends, [*group, block]).withColumns({"__l": left, "__r": right})
    return out.withColumns({before: F.when(F.size("__l") > k, F.slice("__l", -k, k)).otherwise(F.col("__l")),
                            after: F.slice("__r", 1, k)}).drop("__p", "__left", "__right", "__l", "__r")


def cut_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], block: str,
             weight: Column, targets: DataFrame, keep: Mapping[str, Column]) -> DataFrame:
    """First row of each group at which the running weight reaches a target.

    ``targets`` has the group columns, ``cut`` (a name) and ``target``; it must
    hold a few rows per group, since it is broadcast. Only the block in which a
    target is crossed is ever ordered row by row. Returns one row per
    (group, cut) with the ``keep`` columns of the crossing row.
    """
    work = df.withColumn("__w", weight)
    totals = work.groupBy(*group, block).agg(F.sum("__w").alias("__t"))
    w = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    cum = totals.withColumn("__cum", F.sum("__t").over(w))
    crossing = (
        (cum.join(F.broadcast(targets), list(group)) if group else cum.join(F.broadcast(targets)))
        .filter((F.col("__cum") >= F.col("target")) & (F.col("__cum") - F.col("__t") < F.col("target")))
        .select(*group, block, "cut", "target", (F.col("__cum") - F.col("__t")).alias("__before")))
    rows = work.join(F.broadcast(crossing), [*group, block])
    inside = (Window.partitionBy(*group, "cut").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    picked = (rows.withColumn("__run", F.col("__before") + F.sum("__w").over(inside))
              .filter(F.col("__run") >= F.col("target")))
    return picked.groupBy(*group, "cut").agg(
        *[F.min_by(c, F.struct(*order)).alias(n) for n, c in keep.items()])


def smallest_by_hash(df: DataFrame, group: Sequence[str], digest: str,
                     wanted: DataFrame) -> DataFrame:
    """Rows whose digest is among the ``n`` smallest of their group.

    ``wanted`` has the group columns and ``n`` (a few groups, broadcast). The
    n-th smallest digest is found from slice counts, then rows are only
    compared with it: no sort of a whole group.
    """
    work = df.withColumn("__slice", hash_slice(F.col(digest)))
    targets = wanted.select(*group, F.lit("n").alias("cut"), F.col("n").alias("target"))
    cuts = cut_rows(work, group, [digest], "__slice", F.lit(1),
                    targets.filter(F.col("target") > 0), {"__cut": F.col(digest)})
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    limits = sizes.join(F.broadcast(wanted), list(group)) if group else sizes.join(F.broadcast(wanted))
    limits = limits.join(F.broadcast(cuts.drop("cut")), list(group), "left") if group else \
        limits.join(F.broadcast(cuts.drop("cut")), how="left")
    limits = limits.select(*group, "__cut", (F.col("n") >= F.col("__size")).alias("__whole"))
    out = df.join(F.broadcast(limits), list(group)) if group else df.join(F.broadcast(limits))
    return (out.filter(F.col("__whole") | (F.col(digest) <= F.col("__cut")))
            .drop("__cut", "__whole"))
