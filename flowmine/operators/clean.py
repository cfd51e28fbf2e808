"""Repair of messy tables: types, clocks, labels, invalid cells, copies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.columns import INF, any_of, lookup, normalise_text, quote
from flowmine.operators.blocks import add_running, bounded
from flowmine.operators.slices import SLICE_ROWS
from flowmine.session import cut_lineage
from flowmine.settings import (
    AFTERNOON_TOKENS, CLASS_ORDER, DST_PORT_COLUMNS, IDENTIFIER_COLUMNS, LABEL_GROUPS, UNLABELLED,
    WEEKDAYS)

#: Ranges that a global order is cut into at most, unless they would hold more than ``SLICE_ROWS`` rows.
MAX_RANGES = 200
# Layouts of a time stamp, day first and month first.
DAY_FIRST = ["d/M/yyyy H:m:s", "d/M/yyyy h:m:s a", "d/M/yyyy H:m", "d/M/yyyy h:m a", "yyyy-M-d H:m:s"]
MONTH_FIRST = ["M/d/yyyy H:m:s", "M/d/yyyy h:m:s a", "M/d/yyyy H:m", "M/d/yyyy h:m a", "yyyy-M-d H:m:s"]


# -- damaged numeric columns -------------------------------------------------
def numeric_rates(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Long table (source, column, cells, filled, parsed): how much of a text column is numeric.

    ``cells`` are all rows, ``filled`` those with a value.
    """
    parts = [F.count(F.lit(1)).alias("\u0001rows")]
    for c in columns:
        text = F.trim(quote(c).cast("string"))
        parts += [F.count(text).alias(f"{c}\u0001n"),
                  F.count(text.try_cast("double")).alias(f"{c}\u0001p")]
    wide = df.groupBy(source).agg(*parts)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), quote(f"{c}\u0001n").alias("filled"),
                                 quote(f"{c}\u0001p").alias("parsed")) for c in columns])
    return (wide.select(source, quote("\u0001rows").alias("cells"), F.explode(entries).alias("e"))
            .select(source, "e.column", "cells", "e.filled", "e.parsed"))


def repair_numeric(df: DataFrame, columns: Sequence[str], source: str,
                   min_rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Text columns that are mostly numbers in a file become numbers there.

    Cells that do not parse turn to NULL where at least ``min_rate`` of all
    cells, empty ones included, are numbers, or every filled cell is one; any
    other column is left as it is. A column that is numeric in every file gets
    type double. Returns the table and the report (source, column, cells,
    filled, parsed, numeric).
    """
    report = cut_lineage(numeric_rates(df, columns, source).withColumn(
        "numeric", (F.col("parsed") == F.col("filled")) | (F.col("parsed") >= F.lit(min_rate) * F.col("cells"))))
    everywhere = {r["column"] for r in report.groupBy("column").agg(
        F.bool_and("numeric").alias("all")).filter("all").collect()}
    # One row per file, a few flags each.
    flags = report.groupBy(source).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "numeric"))).alias("__numeric"))
    joined = df.join(bounded(flags), source)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(quote(c))
        elif c in everywhere:
            out.append(F.trim(quote(c).cast("string")).try_cast("double").alias(c))
        else:
            text = quote(c).cast("string")
            bad = F.element_at("__numeric", F.lit(c)) & F.trim(text).try_cast("double").isNull()
            out.append(F.when(~F.coalesce(bad, F.lit(False)), text).alias(c))
    return joined.select(*out), report


def to_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Single precision at rest."""
    pick = set(columns)
    return df.select(*[quote(c).cast("float").alias(c) if c in pick else quote(c) for c in df.columns])


# -- clocks ------------------------------------------------------------------
def is_afternoon(source: Column, tokens: Sequence[str] = AFTERNOON_TOKENS) -> Column:
    return any_of([F.contains(F.lower(source), F.lit(t)) for t in tokens])


def weekday_of(source: Column) -> Column:
    """Monday 0 ... Friday 4 from a file name, NULL when it names none."""
    low = F.lower(source)
    out = F.lit(None).cast("int")
    for i in range(len(WEEKDAYS) - 1, -1, -1):
        out = F.when(F.contains(low, F.lit(WEEKDAYS[i])), F.lit(i)).otherwise(out)
    return out


def _parse(c: Column, layouts: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in layouts])


def fix_timestamps(df: DataFrame, text: str, source: str, name: str = "ts",
                   tokens: Sequence[str] = AFTERNOON_TOKENS, shift_h: int = 12,
                   below_h: int = 12, file_name: str | None = None) -> DataFrame:
    """Read day-first stamps; a file that yields none is read month-first.

    Hours below 12 in files named after the afternoon move by 12 hours, since
    their clock has no AM/PM. ``source`` tells files apart; ``file_name`` holds
    their names where that is another column.
    """
    usable = df.groupBy(source).agg(F.count(_parse(quote(text), DAY_FIRST)).alias("__day_first"))
    ts = F.when(F.col("__day_first") > 0, _parse(quote(text), DAY_FIRST)).otherwise(
        _parse(quote(text), MONTH_FIRST))
    late = is_afternoon(quote(file_name or source), tokens) & (F.hour("__ts") < below_h)
    return (df.join(bounded(usable), source).withColumn("__ts", ts)
            .withColumn(name, F.when(late, F.col("__ts") + F.make_dt_interval(hours=F.lit(shift_h)))
                        .otherwise(F.col("__ts")))
            .drop("__ts", "__day_first"))


def fill_clocks(df: DataFrame, source: str, row_in_source: str, start: str, name: str = "ts",
                file_name: str | None = None) -> DataFrame:
    """Stand-in time for all rows of the files in which no row has a time; other files keep theirs."""
    usable = df.groupBy(source).agg(F.count(name).alias("__usable"))
    stand_in = synthesise_timestamps(df.join(bounded(usable), source), file_name or source, row_in_source, start, "__made")
    return (stand_in.withColumn(name, F.when(F.col("__usable") == 0, F.col("__made")).otherwise(F.col(name)))
            .drop("__usable", "__made"))


def synthesise_timestamps(df: DataFrame, source: str, row_in_source: str, start: str,
                          name: str = "ts") -> DataFrame:
    """Stand-in time: start, plus weekday, plus half a day, plus one second per row."""
    day = F.coalesce(weekday_of(quote(source)), F.lit(0)) * 86400
    half = F.when(is_afternoon(quote(source), ["afternoon"]), F.lit(43200)).otherwise(F.lit(0))
    base = F.unix_timestamp(F.lit(start).cast("timestamp"))
    return df.withColumn(name, F.timestamp_seconds(base + day + half + F.col(row_in_source)))


def number_rows(df: DataFrame, source: str, block: str, order: str, name: str = "row_in_source") -> DataFrame:
    """Position of a row in its file, from block offsets (no file-wide sort)."""
    out = add_running(df, [source], [order], block, {"__pos": F.lit(1)})
    return out.withColumn(name, F.col("__pos") - 1).drop("__pos")


# -- labels ------------------------------------------------------------------
def group_labels(df: DataFrame, label: str, groups: Mapping[str, str] = LABEL_GROUPS,
                 classes: Sequence[str] = CLASS_ORDER, drop_unlabelled: bool = True,
                 validate: bool = True) -> DataFrame:
    """Map label spellings to classes: adds ``label_raw``, ``label_group``, ``y``.

    Blank and header-like labels are dropped; any other unknown spelling is an
    error that names it.
    """
    unknown_classes = sorted(set(groups.values()) - set(classes))
    if unknown_classes:
        raise ValueError(f"grouped classes missing from the class order: {unknown_classes}")
    table = {re.sub("[^a-z0-9]+", " ", k.lower()).strip(): v for k, v in groups.items()}
    norm = normalise_text(F.coalesce(quote(label).cast("string"), F.lit("")))
    code = {c: i for i, c in enumerate(classes)}
    work = (df.withColumn("__norm", norm)
            .withColumn("label_group", lookup(table, F.col("__norm"), value_type="string")))
    header = re.sub("[^a-z0-9]+", " ", label.lower()).strip()
    blank = F.col("__norm").isin([*UNLABELLED, header])
    if drop_unlabelled:
        work = work.filter(F.col("label_group").isNotNull() | ~blank)
    if validate:
        bad = [r[0] for r in work.filter(F.col("label_group").isNull())
               .select(quote(label)).distinct().limit(20).collect()]
        if bad:
            raise ValueError(f"labels without a class: {sorted(map(str, bad))}")
    return (work.withColumn("label_raw", quote(label))
            .withColumn("y", lookup(code, F.col("label_group"), value_type="int")).drop("__norm"))


def unlabelled_counts(df: DataFrame, label: str, groups: Mapping[str, str]) -> DataFrame:
    """Rows, rows without a label, rows with an unknown one."""
    table = {re.sub("[^a-z0-9]+", " ", k.lower()).strip(): v for k, v in groups.items()}
    norm = normalise_text(F.coalesce(quote(label).cast("string"), F.lit("")))
    header = re.sub("[^a-z0-9]+", " ", label.lower()).strip()
    known, blank = norm.isin(list(table)), norm.isin([*UNLABELLED, header])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~known & blank, 1)).alias("unlabelled"),
                  F.count(F.when(~known & ~blank, 1)).alias("unmapped"))


# -- columns and cells -------------------------------------------------------
def feature_columns(columns: Sequence[str], exclude: Sequence[str] = (), use_dst_port: bool = False,
                    identifiers: Sequence[str] = IDENTIFIER_COLUMNS) -> list[str]:
    """All columns but identifiers, bookkeeping and (by default) the target port."""
    out = {*identifiers, *exclude} | (set() if use_dst_port else set(DST_PORT_COLUMNS))
    return [c for c in columns if c not in out]


def blank_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite (and NaN) cells become NULL."""
    pick = set(columns)
    return df.select(*[
        F.when(~F.isnan(quote(c)) & (F.abs(quote(c)) != F.lit(INF)), quote(c)).alias(c)
        if c in pick else quote(c) for c in df.columns])


def blank_negative(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ()) -> DataFrame:
    """Negative cells become NULL, except in columns where -1 means "not seen"."""
    pick = set(columns) - set(sentinels)
    return df.select(*[F.when(quote(c) >= 0, quote(c)).alias(c) if c in pick else quote(c)
                       for c in df.columns])


def invalid_counts(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ()) -> DataFrame:
    """Long table (column, infinite, negative, kept) from one aggregate."""
    parts = []
    for c in columns:
        v = quote(c)
        parts += [F.count(F.when(F.abs(v) == F.lit(INF), 1)).alias(f"{c}\u0001i"),
                  F.count(F.when((v < 0) & (v > F.lit(-INF)), 1)).alias(f"{c}\u0001n")]
    wide = df.agg(*parts)
    zero = F.lit(0).cast("long")
    entries = F.array(*[F.struct(
        F.lit(c).alias("column"), quote(f"{c}\u0001i").alias("infinite"),
        (zero if c in sentinels else quote(f"{c}\u0001n")).alias("negative"),
        (quote(f"{c}\u0001n") if c in sentinels else zero).alias("kept")) for c in columns])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def drop_copies(df: DataFrame, content: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per distinct content, the first in order.

    A grouped minimum, so copies are folded before the shuffle and a row with a
    great many copies costs no more than another. Missing values of the order
    come last. Zeros of either sign are copies; the row that stays keeps its own.
    """
    rest = [c for c in df.columns if c not in content]
    lead = list(order) + [c for c in rest if c not in order]
    flags = [quote(c).isNull().alias(f"__null{i}") for i, c in enumerate(order)]
    ranked = [x for i, c in enumerate(order) for x in (flags[i], quote(c))]
    # Grouping returns 0.0 for -0.0, so the signs of zeros travel with the row.
    floats = [c for c, kind in df.dtypes if c in content and kind in ("double", "float")]
    signs = [F.array(*[F.coalesce((quote(c) == 0) & (quote(c).cast("string") == "-0.0"), F.lit(False)) for c in floats])
             .alias("__signs")] if floats else []
    kept = df.groupBy(*[quote(c) for c in content]).agg(
        F.min(F.struct(*ranked, *[quote(c) for c in lead[len(order):]], *signs)).alias("__first"))

    def own(c: str) -> Column:
        if c not in floats:
            return quote(c)
        return F.when(F.get(F.col("__first")["__signs"], F.lit(floats.index(c))), -quote(c)).otherwise(quote(c)).alias(c)

    return kept.select(*[own(c) if c in content else F.col("__first")[c].alias(c) for c in df.columns])


def order_key(ts: str, source: str, row: str) -> list[Column]:
    """Deterministic global order: time (missing last), file, row in file."""
    return [F.col(ts).asc_nulls_last(), F.col(source).asc(), F.col(row).asc()]


def number_in_order(df: DataFrame, ts: str, source: str, row: str, name: str = "row_no",
                    rows: int = SLICE_ROWS) -> DataFrame:
    """``name`` counts the rows from 1 in the global order of ``order_key``.

    Beyond ``rows`` rows the order is cut into ranges, at most ``MAX_RANGES`` of that
    many; a row's number is its place in its range plus the rows of the ranges
    before. Rows equal in all three columns are numbered in any order.
    """
    work = cut_lineage(df.withColumns({"__all": F.lit(0), "__late": quote(ts).isNull(), "__ts": quote(ts),
                                       "__source": quote(source), "__row": quote(row)}))
    order = ["__late", "__ts", "__source", "__row"]
    n, block = work.count(), None
    ranges = min(-(-n // rows), max(MAX_RANGES, -(-n // SLICE_ROWS)))
    if ranges > 1:
        block = "__range"      # rises with the order, and is staged, since other plans deal the rows anew
        work = cut_lineage(work.repartitionByRange(ranges, *order).withColumn(block, F.spark_partition_id()))
    out = add_running(work, ["__all"], order, block, {"__no": F.lit(1).cast("long")})
    return out.select(*[quote(c) for c in df.columns], F.col("__no").cast("long").alias(name))
