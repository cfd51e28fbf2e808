"""Train / validation / test splits, as a ``split`` column on the rows.

Cut points are found from slice totals (:func:`cut_rows`), collected as one row
per class, and applied as comparisons. No split orders a whole class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.columns import hash_slice, literal_map, micros, seeded_order
from flowmine.operators.blocks import cut_rows, time_block
from flowmine.operators.sessions import (
    class_sizes, rarity_ranks, session_counts, session_table, with_primary_class)
from flowmine.session import cut_lineage
from flowmine.settings import SplitSettings

BLOCK_S = 3600

#: Group of rows or sessions without a class.
NO_CLASS = "\u0000"



@dataclass
class TimeBlocks:
    """Fitted boundaries: one entry per class that owns sessions."""

    bounds: dict[str, dict] = field(default_factory=dict)

    @property
    def flow_level_classes(self) -> list[str]:
        return [c for c, b in self.bounds.items() if b["flow_level"]]


def _place(start: Column, end: Column, t1: Column, t2: Column, gap: Column) -> Column:
    return (F.when(end <= t1, "train")
            .when((start > t1 + gap) & (end <= t2), "val")
            .when(start > t2 + gap, "test")
            .otherwise("gap"))


def _unit_bounds(units: DataFrame, settings: SplitSettings) -> dict[str, dict]:
    """T1, T2 and gap (microseconds) per class from (cls, start, end, n, id) units."""
    units = units.withColumn("__blk", time_block(F.col("start_us"), BLOCK_S))
    span = units.groupBy("cls").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_units"),
        F.min("start_us").alias("first"),
        F.max_by("end_us", F.struct("start_us", "id")).alias("last_end"))
    fractions = F.array(
        F.struct(F.lit("t1").alias("cut"), F.lit(settings.train_frac).alias("f")),
        F.struct(F.lit("t2").alias("cut"),
                 F.lit(settings.train_frac + settings.val_frac).alias("f")))
    targets = (span.select("cls", "total", F.explode(fractions).alias("x"))
               .select("cls", F.col("x.cut").alias("cut"),
                       F.greatest(F.lit(1.0), F.col("total") * F.col("x.f")).alias("target")))
    cuts = cut_rows(units, ["cls"], ["start_us", "id"], "__blk", F.col("n"), targets,
                    {"at": F.col("end_us")})
    out: dict[str, dict] = {}
    for r in span.collect():
        out[r["cls"]] = {"n_units": r["n_units"], "total": r["total"],
                         "gap": (r["last_end"] - r["first"]) * settings.gap_frac}
    for r in cuts.collect():
        out[r["cls"]][r["cut"]] = r["at"]
    return out


def _bound(bounds: dict[str, dict], key: str, cls: Column) -> Column:
    pairs = {c: float(b[key]) for c, b in bounds.items()}
    return F.element_at(literal_map(pairs), cls)


def _own_counts(placed: DataFrame) -> dict[str, set]:
    """Partitions that hold rows labelled with the owning class."""
    seen: dict[str, set] = {}
    for r in placed.groupBy("cls", "part").agg(F.sum("own").alias("own")).collect():
        if r["own"] and r["part"] != "gap":
            seen.setdefault(r["cls"], set()).add(r["part"])
    return seen


def _absent(seen: dict[str, set], cls: str) -> list[str]:
    return [p for p in ("train", "val", "test") if p not in seen.get(cls, set())]


def fit_time_blocks(df: DataFrame, session: str, ts: str, label: str, row_id: str,
                    classes: Sequence[str], settings: SplitSettings = SplitSettings(),
                    held_out: str | None = None,
                    stage: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[TimeBlocks, DataFrame]:
    """Cut each class's sessions by time; returns boundaries and session table.

    A class whose sessions cannot fill all three parts (or that has too few
    rows) is cut by single rows instead, and in the last resort without a gap.
    Sessions holding a row of ``held_out`` take no part. ``stage`` writes the
    session table out, since it is read several times.
    """
    counts = stage(session_counts(df, session, ts, label, classes))
    held = F.get("class_counts", F.lit(list(classes).index(held_out))) > 0 if held_out else F.lit(False)
    sizes = class_sizes(counts.filter(~held), classes)
    sessions = with_primary_class(
        counts, rarity_ranks(sizes, classes), classes).withColumn("held", held)
    free = sessions.filter(~F.col("held"))
    units = free.select(
        F.col("primary_class").alias("cls"), "start_us", "end_us",
        F.col("n_flows").alias("n"), F.col(session).alias("id"), "n_own")
    bounds = _unit_bounds(units, settings)
    blocks = TimeBlocks()

    def place(rows: DataFrame, table: dict[str, dict]) -> DataFrame:
        c = F.col("cls")
        return rows.filter(c.isin(list(table))).withColumn("part", _place(
            F.col("start_us"), F.col("end_us"), _bound(table, "t1", c), _bound(table, "t2", c),
            _bound(table, "gap", c)))

    seen = _own_counts(place(units.withColumn("own", F.col("n_own")), bounds))
    retry = []
    for cls, b in bounds.items():
        tiny = (sizes[cls] < settings.tiny_class_min_flows
                and settings.tiny_class_policy == "flow_level")
        missing = settings.require_all_classes and bool(_absent(seen, cls))
        b.update(n_flows=sizes[cls], flow_level=False, absent=_absent(seen, cls), tiny=tiny)
        if tiny or missing:
            retry.append(cls)
    if retry:
        owner = free.filter(F.col("primary_class").isin(retry)).select(session, "primary_class")
        flows = df.join(owner, session).select(
            F.col("primary_class").alias("cls"), micros(F.col(ts)).alias("start_us"),
            micros(F.col(ts)).alias("end_us"), F.lit(1).cast("long").alias("n"),
            F.col(row_id).alias("id"), (F.col(label) == F.col("primary_class")).cast("long").alias("own"))
        by_flow = _unit_bounds(flows, settings)
        seen_gap = _own_counts(place(flows, by_flow))
        tight = {c: {**b, "gap": 0.0} for c, b in by_flow.items()}
        seen_tight = _own_counts(place(flows, tight))
        for cls in retry:
            # A tiny class is cut by rows from the start and is not retried.
            loose = bounds[cls]["tiny"] or not _absent(seen_gap, cls)
            table, found = (by_flow, seen_gap) if loose else (tight, seen_tight)
            bounds[cls].update(table[cls], flow_level=True, absent=_absent(found, cls))
    blocks.bounds = bounds
    return blocks, sessions


def apply_time_blocks(df: DataFrame, sessions: DataFrame, blocks: TimeBlocks, session: str,
                      ts: str, held_out: str | None = None) -> DataFrame:
    """Add ``split`` and ``assign_group`` (the class that owns the session)."""
    joined = df.join(
        sessions.select(session, F.col("primary_class").alias("assign_group"), "held",
                        F.col("start_us").alias("__s"), F.col("end_us").alias("__e")), session)
    by_flow = ~F.col("held") & F.col("assign_group").isin(blocks.flow_level_classes)
    us = micros(F.col(ts))
    start = F.when(by_flow, us).otherwise(F.col("__s"))
    end = F.when(by_flow, us).otherwise(F.col("__e"))
    c = F.col("assign_group")
    b = blocks.bounds
    placed = _place(start, end, _bound(b, "t1", c), _bound(b, "t2", c), _bound(b, "gap", c))
    return (joined.withColumn("split", F.when(F.col("held"), "test").otherwise(placed))
            .withColumn("exempt", by_flow)
            .withColumn("assign_group", F.when(F.col("held"), F.lit(held_out)).otherwise(c))
            .drop("__s", "__e", "held"))


def time_blocked_split(df: DataFrame, session: str, ts: str, label: str, row_id: str,
                       classes: Sequence[str], settings: SplitSettings = SplitSettings(),
                       **kw) -> DataFrame:
    """Whole sessions of each class placed in time order: train, val, test or gap."""
    df = cut_lineage(df)                    # read for the session table and again for the rows
    blocks, sessions = fit_time_blocks(df, session, ts, label, row_id, classes, settings, **kw)
    return apply_time_blocks(df, sessions, blocks, session, ts)


def boundary_report(split_df: DataFrame, blocks: TimeBlocks, session: str, ts: str) -> DataFrame:
    """Per class: rows, units, block ends, gap, dropped units, fallback, absences."""
    us = micros(F.col(ts))
    per_unit = split_df.withColumn(
        "__unit", F.when(F.col("exempt"), F.lit(None)).otherwise(F.col(session)))
    agg = per_unit.groupBy("assign_group").agg(
        F.max(F.when(F.col("split") == "train", us)).alias("train_end_us"),
        F.max(F.when(F.col("split") == "val", us)).alias("val_end_us"),
        F.max(F.when(F.col("split") == "test", us)).alias("test_end_us"),
        F.count(F.when((F.col("split") == "gap") & F.col("exempt"), 1)).alias("__gap_flows"))
    gap_sessions = (split_df.filter((F.col("split") == "gap") & ~F.col("exempt"))
                    .groupBy("assign_group", session).agg(F.count(F.lit(1)).alias("__n"))
                    .groupBy("assign_group").agg(F.count(F.lit(1)).alias("__gap_sessions")))
    c = F.col("assign_group")
    b = blocks.bounds
    return agg.join(gap_sessions, "assign_group", "left").select(
        c.alias("class"),
        F.element_at(literal_map({k: v["n_flows"] for k, v in b.items()}, value_type="long"), c).alias("n_flows"),
        F.element_at(literal_map({k: v["n_units"] for k, v in b.items()}, value_type="long"), c).alias("n_units"),
        "train_end_us", "val_end_us", "test_end_us",
        F.round(_bound(b, "gap", c) / F.lit(1e6), 3).alias("gap_s"),
        (F.coalesce("__gap_sessions", F.lit(0)) + F.col("__gap_flows")).alias("gap_units_dropped"),
        c.isin(blocks.flow_level_classes).alias("flow_level"),
        F.element_at(literal_map({k: ",".join(v["absent"]) for k, v in b.items()},
                                 value_type="string"), c).alias("absent_from"))


def stratified_session_split(df: DataFrame, session: str, ts: str, label: str,
                             classes: Sequence[str], settings: SplitSettings = SplitSettings()) -> DataFrame:
    """Whole sessions in random order, filled per class to the wanted shares.

    Sessions without a known class are a group of their own.
    """
    sessions = (session_table(df, session, ts, label, classes)
                .withColumn("__group", F.coalesce("primary_class", F.lit(NO_CLASS)))
                .withColumn("__d", seeded_order(settings.seed, F.col(session)))
                .withColumn("__slice", hash_slice(F.col("__d"))))
    cuts = _share_cuts(sessions, "__group", F.col("n_flows"), settings)
    d = F.struct("__d", session)
    placed = sessions.join(F.broadcast(cuts), "__group").select(
        session, F.col("primary_class").alias("assign_group"),
        F.when(d <= F.col("c1"), "train").when(d <= F.col("c2"), "val").otherwise("test").alias("split"))
    return df.join(placed, session)


def _share_cuts(rows: DataFrame, group: str, weight: Column, settings: SplitSettings) -> DataFrame:
    """Digest structs at which train and validation end, one row per group."""
    key = [c for c in rows.columns if c not in ("__d", "__slice")][0]
    total = rows.groupBy(group).agg(F.sum(weight).alias("total"))
    f = F.array(F.struct(F.lit("c1").alias("cut"), F.lit(settings.train_frac).alias("f")),
                F.struct(F.lit("c2").alias("cut"),
                         F.lit(settings.train_frac + settings.val_frac).alias("f")))
    targets = (total.select(group, "total", F.explode(f).alias("x"))
               .select(group, F.col("x.cut").alias("cut"), (F.col("total") * F.col("x.f")).alias("target")))
    cuts = cut_rows(rows, [group], ["__d", key], "__slice", weight, targets,
                    {"at": F.struct("__d", key)})
    return cuts.groupBy(group).agg(
        F.max(F.when(F.col("cut") == "c1", F.col("at"))).alias("c1"),
        F.max(F.when(F.col("cut") == "c2", F.col("at"))).alias("c2"))


def stratified_flow_split(df: DataFrame, row_id: str, label: str,
                          settings: SplitSettings = SplitSettings()) -> DataFrame:
    """Single rows at random per class; tears sessions apart on purpose.

    Rows without a label are a class of their own.
    """
    group, label = label, "__group"
    df = df.withColumn(label, F.coalesce(F.col(group).cast("string"), F.lit(NO_CLASS)))
    rows = df.select(row_id, label).withColumn("__d", seeded_order(settings.seed, F.col(row_id)))
    rows = rows.withColumn("__slice", hash_slice(F.col("__d")))
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    f = F.array(F.struct(F.lit("c1").alias("cut"), F.lit(settings.train_frac).alias("f")),
                F.struct(F.lit("c2").alias("cut"),
                         F.lit(settings.train_frac + settings.val_frac).alias("f")))
    targets = (counts.filter(F.col("__n") >= 3).select(label, "__n", F.explode(f).alias("x"))
               .select(label, F.col("x.cut").alias("cut"),
                       F.floor(F.col("__n") * F.col("x.f")).alias("target"))
               .filter(F.col("target") > 0))
    cuts = cut_rows(rows, [label], ["__d"], "__slice", F.lit(1), targets, {"at": F.col("__d")})
    cuts = cuts.groupBy(label).agg(
        F.max(F.when(F.col("cut") == "c1", F.col("at"))).alias("c1"),
        F.max(F.when(F.col("cut") == "c2", F.col("at"))).alias("c2"))
    limits = counts.join(F.broadcast(cuts), label, "left")
    d = seeded_order(settings.seed, F.col(row_id))
    return (df.join(F.broadcast(limits), label)
            .withColumn("split", F.when(F.col("__n") < 3, "train")
                        .when(d <= F.coalesce(F.col("c1"), F.lit("")), "train")
                        .when(d <= F.coalesce(F.col("c2"), F.lit("")), "val").otherwise("test"))
            .drop("__n", "c1", "c2", "__group"))


def leave_family_out_split(df: DataFrame, session: str, ts: str, label: str, row_id: str,
                           classes: Sequence[str], held_out: str,
                           settings: SplitSettings = SplitSettings(), **kw) -> DataFrame:
    """Every session with a row of ``held_out`` goes to test; the rest by time."""
    blocks, sessions = fit_time_blocks(df, session, ts, label, row_id, classes, settings, held_out, **kw)
    if sessions.filter("held").isEmpty():
        raise ValueError(f"family {held_out!r} is absent from the data")
    if not blocks.bounds:
        raise ValueError(f"holding out {held_out!r} leaves no data")
    return apply_time_blocks(df, sessions, blocks, session, ts, held_out)


def make_split(df: DataFrame, strategy: str, *, session: str, ts: str, label: str, row_id: str,
               classes: Sequence[str], settings: SplitSettings = SplitSettings(),
               held_out: str | None = None, **kw) -> DataFrame:
    """The split named by ``strategy``."""
    if strategy == "time_blocked":
        return time_blocked_split(df, session, ts, label, row_id, classes, settings, **kw)
    if strategy == "stratified_session":
        return (stratified_session_split(df, session, ts, label, classes, settings)
                .withColumn("exempt", F.lit(False)))
    if strategy == "stratified_flow":
        return (stratified_flow_split(df, row_id, label, settings)
                .withColumn("assign_group", F.col(label)).withColumn("exempt", F.lit(True)))
    if strategy == "leave_family_out":
        if not held_out:
            raise ValueError("leave_family_out needs held_out")
        return leave_family_out_split(df, session, ts, label, row_id, classes, held_out, settings, **kw)
    raise ValueError(f"unknown split strategy {strategy!r}")
