"""Sessions: symmetric communication keys, idle timeouts, length caps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.columns import micros
from flowmine.operators.blocks import ordered_runs
from flowmine.operators.slices import sliced
from flowmine.session import cut_lineage
from flowmine.settings import SessionSettings


#: Stands for a missing time: later than any other.
NEVER = (1 << 63) - 1


def communication_key(mode: str, src: Column, dst: Column, src_port: Column | None = None,
                      dst_port: Column | None = None, protocol: Column | None = None) -> Column:
    """Key shared by both directions of a conversation.

    ``five_tuple`` keeps both ports, ``service_port`` the lower one only and
    ``host_pair`` none. Unreadable ports count as -1, absent columns as 0.
    """
    a = F.coalesce(src.cast("string"), F.lit("nan"))
    b = F.coalesce(dst.cast("string"), F.lit("nan"))
    parts = [F.least(a, b), F.greatest(a, b)]
    if mode == "host_pair":
        return F.concat_ws("|", *parts)

    def number(c: Column | None) -> Column:
        if c is None:
            return F.lit(0).cast("long")
        return F.coalesce(c.cast("string").try_cast("double").cast("long"), F.lit(-1).cast("long"))

    if src_port is None or dst_port is None:
        low = high = F.lit(0).cast("long")
    else:
        p, q = number(src_port), number(dst_port)
        low, high = F.least(p, q), F.greatest(p, q)
    parts.append(low)
    if mode == "five_tuple":
        parts.append(high)
    elif mode != "service_port":
        raise ValueError(f"unknown session key mode {mode!r}")
    parts.append(number(protocol))
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def sessionize(df: DataFrame, key: str, ts: str, tie: Sequence[str],
               settings: SessionSettings = SessionSettings(),
               name: str = "session_id") -> DataFrame:
    """Split every key into sub-sessions ``key#1``, ``key#2``, ...

    A new one starts when the gap to the previous row of the key exceeds the
    timeout, or when ``max_flows`` rows are reached. ``cap_mode="block"`` starts
    a new session every ``max_flows`` rows of a run; ``"singleton"`` makes each
    row beyond the cap a session of its own. Rows without a time come after
    all others of their key and go on with its last session.
    """
    timeout, cap = settings.timeout_s or 0, settings.max_flows or 0
    if timeout <= 0 and cap <= 0:
        return df.withColumn(name, F.col(key))
    limit = F.lit(float(timeout)) if timeout > 0 else F.lit(float("inf"))
    never = F.lit(NEVER)
    us = micros(F.col(ts))
    work = (df.withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("")))
            .withColumn("__us", F.coalesce(us, never)))
    work, block = sliced(work, ["__k"], ["__us", *tie], settings.slice_rows)
    runs = ordered_runs(
        work, ["__k"], ["__us", *tie], block, F.col("__us"),
        lambda before, now: (now != never) & ((now - before) / F.lit(1e6) > limit), cap, settings.cap_mode)
    return (runs.withColumn(name, F.concat_ws("#", F.col(key), F.col("piece_no").cast("string")))
            .drop("__k", "__us", "__blk", "run_no", "run_pos", "piece_no"))


def run_length_sessions(df: DataFrame, source: str, row_in_source: str, keys: Sequence[Column],
                        max_len: int = 50, rows_per_block: int = 100_000,
                        name: str = "session_id") -> DataFrame:
    """Stand-in sessions for tables without addresses.

    Neighbouring rows of a file with equal keys form a run; a run is cut every
    ``max_len`` rows. Runs are numbered per file, so files stay independent.
    """
    same = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("-1")) for k in keys])
    work = (df.withColumn("__same", same)
            .withColumn("__blk", F.floor(F.col(row_in_source) / F.lit(int(rows_per_block)))))
    runs = ordered_runs(work, [source], [row_in_source], "__blk", F.col("__same"),
                        lambda before, now: before != now)
    cut = F.floor(F.col("run_pos") / F.lit(max(1, int(max_len))))
    return (runs.withColumn(name, F.concat(
        F.col(source), F.lit("|S"), (F.col("run_no") - 1).cast("string"), F.lit("_"), cut.cast("string")))
        .drop("__same", "__blk", "run_no", "run_pos", "piece_no"))


def session_counts(df: DataFrame, session: str, ts: str, label: str,
                   classes: Sequence[str]) -> DataFrame:
    """One row per session: start, end, rows, and rows of every class (an array)."""
    us = micros(F.col(ts))
    return df.groupBy(session).agg(
        F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count(F.lit(1)).alias("n_flows"),
        F.array(*[F.count(F.when(F.col(label) == c, 1)) for c in classes]).alias("class_counts"))


def class_sizes(counts: DataFrame, classes: Sequence[str]) -> dict[str, int]:
    """Rows per class, summed from a session table; absent classes left out."""
    row = counts.agg(*[F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}")
                       for i in range(len(classes))]).first()
    return {c: row[i] for i, c in enumerate(classes) if row[i]}


def rarity_ranks(sizes: dict[str, int], classes: Sequence[str]) -> dict[str, int]:
    """0 for the most frequent class, growing with rarity; ties by class order."""
    ordered = sorted(sizes, key=lambda c: (-sizes[c], list(classes).index(c)))
    return {c: i for i, c in enumerate(ordered)}


def with_primary_class(counts: DataFrame, ranks: dict[str, int], classes: Sequence[str]) -> DataFrame:
    """Name each session after its rarest class and count that class's rows."""
    rank_of = F.array(*[F.lit(ranks.get(c, -1)) for c in classes])
    present = F.zip_with("class_counts", rank_of, lambda n, r: F.when(n > 0, r).otherwise(F.lit(-1)))
    best = F.array_max(present)
    at = (F.array_position(present, best) - 1).cast("int")
    return counts.select(
        *[c for c in counts.columns if c != "class_counts"],
        F.when(best >= 0, F.get(F.array(*[F.lit(c) for c in classes]), at)).alias("primary_class"),
        F.when(best >= 0, F.get("class_counts", at)).alias("n_own"), "class_counts")


def session_table(df: DataFrame, session: str, ts: str, label: str, classes: Sequence[str],
                  stage: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """One row per session: start, end, rows, its rarest class, rows of that class.

    Rarity needs class totals over all sessions, so the counts are staged once.
    """
    counts = stage(session_counts(df, session, ts, label, classes))
    ranks = rarity_ranks(class_sizes(counts, classes), classes)
    return with_primary_class(counts, ranks, classes)


def session_quality(df: DataFrame, session: str, limit: float = 0.9) -> DataFrame:
    """Sessions, rows and whether sessions are nearly as many as rows."""
    per = df.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    t = per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("flows"))
    return t.withColumn("degenerate", F.col("sessions") > F.lit(limit) * F.col("flows"))
