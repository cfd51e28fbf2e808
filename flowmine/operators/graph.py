"""Time-causal session graph: nodes, edges and feature propagation."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import micros, quote
from flowmine.operators.blocks import add_previous_rows, cut_rows, time_block
from flowmine.operators.slices import sliced
from flowmine.session import cut_lineage

BLOCK_S = 900
#: Sessions of one host that one task links: each of them stands for several edges.
HOST_SLICE_ROWS = 250_000


def session_nodes(df: DataFrame, session: str, ts: str, features: Sequence[str],
                  label: str | None = None) -> DataFrame:
    """One node per session: mean features, first time, majority class.

    Equal counts go to the class seen first, then to the smaller label.
    """
    us = micros(F.col(ts))
    nodes = df.groupBy(session).agg(
        F.min(us).alias("t0"), *[F.avg(quote(c)).alias(c) for c in features])
    if label is None:
        return nodes
    votes = df.groupBy(session, label).agg(F.count(F.lit(1)).alias("__n"), F.min(us).alias("__t"))
    # min_by orders by (most votes, earliest, label), all ascending
    majority = votes.groupBy(session).agg(
        F.min_by(F.col(label), F.struct(-F.col("__n"), F.col("__t"), F.col(label))).alias("node_label"))
    return nodes.join(majority, session)


def session_edges(df: DataFrame, session: str, ts: str, host: str, max_in_degree: int = 10,
                  max_gap_s: float | None = 900.0, slice_rows: int = HOST_SLICE_ROWS) -> DataFrame:
    """Edges (src, dst) from earlier to later sessions that share a host.

    Per host a session is linked from at most ``max_in_degree`` sessions, the
    most recent ones, if they began no longer than ``max_gap_s`` before it.
    """
    pairs = df.groupBy(session, host).agg(F.min(micros(F.col(ts))).alias("__t"))
    seen = cut_lineage(pairs.select(session, host, F.min("__t").over(Window.partitionBy(session)).alias("t0")))
    linked = _linked(seen, session, host, session, max_in_degree, slice_rows)
    edges = linked.select(F.explode("__before").alias("b"), F.col(session).alias("dst"),
                          F.col("t0").alias("t_dst"))
    edges = edges.select("b.src", "dst", F.col("b.ts").alias("t_src"), "t_dst")
    if max_gap_s:
        edges = edges.filter((F.col("t_dst") - F.col("t_src")) / F.lit(1e6) <= F.lit(float(max_gap_s)))
    # Hardly a pair occurs twice: folded before the shuffle, a task would hold all its pairs at once.
    return edges.repartition("src", "dst").groupBy("src", "dst").agg(F.min("t_dst").alias("t_dst"))


def _linked(seen: DataFrame, session: str, host: str, name: str, k: int, slice_rows: int) -> DataFrame:
    """(session, host, t0) with the ``name`` and time of up to ``k`` sessions before each on its host."""
    seen, block = sliced(seen.filter(F.col(host).isNotNull() & F.col("t0").isNotNull()), [host], ["t0", session], slice_rows)
    if block:
        seen = cut_lineage(seen)        # read for the rows and again for the ends of the slices
    return add_previous_rows(seen, [host], ["t0", session], block,
                             F.struct(F.col(name).alias("src"), F.col("t0").alias("ts")), k, "__before")


def numbered(nodes: DataFrame, session: str, name: str = "number") -> DataFrame:
    """Staged nodes with a number each, in no given order; rows without a session are no node."""
    return cut_lineage(nodes.filter(F.col(session).isNotNull()).withColumn(name, F.monotonically_increasing_id()))


def numbered_edges(df: DataFrame, nodes: DataFrame, session: str, host: str, max_in_degree: int = 10,
                   max_gap_s: float | None = 900.0, number: str = "number",
                   slice_rows: int = HOST_SLICE_ROWS) -> DataFrame:
    """``session_edges`` as distinct (src, dst) of the ``numbered`` nodes.

    There are several edges to a session, so their shuffles and sorts are most of
    the work on the graph: numbers stand for the names, and the edges of a session
    travel as one array to the task that folds them.
    """
    seen = df.select(session, host).filter(F.col(host).isNotNull()).distinct()
    seen = cut_lineage(seen.join(nodes.select(session, "t0", number), session))
    linked = _linked(seen, session, host, number, max_in_degree, slice_rows)
    before = F.col("__before")
    if max_gap_s:
        before = F.filter(before, lambda b: (F.col("t0") - b["ts"]) / F.lit(1e6) <= F.lit(float(max_gap_s)))
    arrays = linked.select(F.col(number).alias("dst"), F.transform(before, lambda b: b["src"]).alias("__srcs"))
    arrays = arrays.filter(F.size("__srcs") > 0).repartition("dst")
    return arrays.select(F.explode("__srcs").alias("src"), "dst").distinct()


def limit_edges(edges: DataFrame, budget: int, block_s: int = BLOCK_S) -> DataFrame:
    """The first ``budget`` edges by (time, src, dst)."""
    work = edges.withColumn("__g", F.lit(0)).withColumn("__blk", time_block(F.col("t_dst"), block_s))
    target = edges.sparkSession.range(1).select(
        F.lit(0).alias("__g"), F.lit("n").alias("cut"), F.lit(int(budget)).alias("target"))
    cut = cut_rows(work, ["__g"], ["t_dst", "src", "dst"], "__blk", F.lit(1), target,
                   {"__last": F.struct("t_dst", "src", "dst")}).drop("cut")
    out = work.join(F.broadcast(cut), "__g", "left")
    return out.filter(F.col("__last").isNull() | (F.struct("t_dst", "src", "dst") <= F.col("__last"))).select(
        *edges.columns)


def _messages(nodes: DataFrame, edges: DataFrame, node: str, direction: str, folded: bool) -> DataFrame:
    """Distinct (src, dst), with a message of each node to itself, from one shuffle by receiver."""
    ways = [F.struct("src", "dst")]
    if direction == "both":
        ways.append(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    elif direction != "causal":
        raise ValueError(f"unknown direction {direction!r}")
    own = nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"))
    if folded and direction == "causal":
        return edges.select("src", "dst").unionByName(own).filter(F.col("dst").isNotNull())
    m = edges.select(F.explode(F.array(*ways)).alias("e")).select("e.src", "e.dst").unionByName(own)
    return m.filter(F.col("dst").isNotNull()).repartition("dst").distinct()


def propagate(nodes: DataFrame, edges: DataFrame, node: str, features: Sequence[str], hops: int = 2,
              direction: str = "causal", folded: bool = False) -> DataFrame:
    """Degree-normalised neighbourhood sums of the features, ``hops`` times.

    Every node also hears itself. Degrees are bounded by the edge rule, so the
    joins stay balanced. A sender is divided by the root of its degree before and
    a receiver after the sum, where its degree is the number of messages it got.
    ``folded`` edges hold no pair twice and none from a node to itself.
    """
    m = _messages(nodes, edges, node, direction, folded)
    degree = m.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("__d"))
    names = [f"__g{i}" for i in range(len(features))]
    root = F.sqrt("__d")
    sent = nodes.select(F.col(node).alias("src"), *[quote(c).alias(g) for c, g in zip(features, names)]).join(
        degree, "src").select("src", *[(F.col(g) / root).alias(g) for g in names], F.lit(1).alias("__one"))
    for left in reversed(range(hops)):
        # Messages of unknown senders count in the degree only.
        got = m.join(sent, "src", "left").drop("src").repartition("dst").groupBy("dst").agg(
            F.count(F.lit(1)).alias("__d"), F.count("__one").alias("__heard"), *[F.sum(g).alias(g) for g in names])
        got = got.filter(F.col("__heard") > 0)
        if left:
            sent = got.select(F.col("dst").alias("src"), *[(F.col(g) / F.col("__d")).alias(g) for g in names],
                              F.lit(1).alias("__one"))
    return got.select(F.col("dst").alias(node), *[(F.col(g) / root).alias(c) for c, g in zip(features, names)])


def to_rows(df: DataFrame, per_node: DataFrame, session: str) -> DataFrame:
    """Node values on every row of their session."""
    return df.join(per_node, session)
