"""Connected components of an edge table, without gathering it anywhere.

Alternates large-star and small-star steps: every node links its larger
neighbours, then its smaller ones, to the smallest node it sees. Each step is a
grouped minimum (combined before the shuffle) and a join on the node, which
adaptive execution splits where one node has many edges. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges with ``a > b``."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
             .filter("a <> b").distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(
        F.struct(F.col("a"), F.col("m").alias("b")),
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node.

    Edges may repeat, point either way or be loops; edges with a null end are
    ignored and a node with loops only is left out.
    """
    now = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        now = stage(_stars(now))
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def find_roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of the nodes ``x`` in a task's forest of parents."""
    up = parent[x]
    while True:
        nxt = parent[up]
        if np.array_equal(nxt, up):
            return up
        up = nxt


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang the larger root under the smaller until all pairs agree."""
    while True:
        ra, rb = find_roots(parent, a), find_roots(parent, b)
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
