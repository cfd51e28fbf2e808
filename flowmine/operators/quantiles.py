"""Exact quantiles that do not gather a column in one task.

Approximate percentiles bracket each wanted rank, counts prove the bracket, and
only values inside it are ordered. Brackets that are still large are narrowed
again. Columns of few distinct values are counted by value instead, in one pass, and
tables of a checked small size use the built-in exact percentile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.functions.columns import finite_or_null, quote
from flowmine.operators.blocks import add_running
from flowmine.operators.slices import SLICE_ROWS, sliced
from flowmine.session import cut_lineage

SMALL_ROWS = 2_000_000
BRACKET_ROWS = 2_000_000
ACCURACY = 10_000


def _counted(vals: DataFrame, columns: Sequence[int], ranks: dict[tuple[int, int], tuple[int, int, float]],
             slice_rows: int = SLICE_ROWS) -> dict[tuple[int, int, int], float]:
    """The value at both ranks of each (column, probability), from running counts of the distinct values."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in columns])
    counts = cut_lineage(vals.select(F.explode(cells).alias("e")).select("e.*").filter("v IS NOT NULL").groupBy("i", "v").agg(
        F.count(F.lit(1)).alias("c")))
    marked, block = sliced(counts, ["i"], ["v"], slice_rows)
    cum = add_running(marked, ["i"], ["v"], block, {"cum": F.col("c")})
    return _at_ranks(cum, {(i, j, s): ranks[(i, j)][s] for i, j in ranks if i in columns for s in (0, 1)})


def _at_ranks(cum: DataFrame, ranks: dict[tuple[int, int, int], int]) -> dict[tuple[int, int, int], float]:
    targets = cum.sparkSession.createDataFrame([(*k, int(r)) for k, r in ranks.items()], "i int, j int, side int, r long")
    hits = (cum.join(F.broadcast(targets), ["i", "j"] if "j" in cum.columns else ["i"])
            .filter((F.col("cum") > F.col("r")) & (F.col("cum") - F.col("c") <= F.col("r"))))
    return {(r["i"], r["j"], r["side"]): r["v"] for r in hits.collect()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    small_rows: int = SMALL_ROWS, bracket_rows: int = BRACKET_ROWS,
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, NULL, NaN and infinities left out."""
    if not columns:
        return {}
    vals = df.select(*[finite_or_null(quote(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    head = vals.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    n = {i: head[f"n{i}"] for i in range(len(columns))}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    live = [i for i in n if n[i] > 0]
    if not live:
        return out
    if max(n.values()) <= small_rows:
        row = vals.agg(*[F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}")
                         for i in live]).first()
        for i in live:
            out[columns[i]] = list(row[f"q{i}"])
        return out
    # ranks (0-based) below and above each wanted position
    want: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i in live:
        for j, p in enumerate(probs):
            pos = p * (n[i] - 1)
            want[(i, j)] = (math.floor(pos), math.ceil(pos), pos - math.floor(pos))
    different = vals.agg(*[F.approx_count_distinct(f"v{i}").alias(f"d{i}") for i in live]).first()
    few = [i for i in live if different[f"d{i}"] <= bracket_rows]
    if few:
        got = _counted(vals, few, want)
        for i, j in [k for k in want if k[0] in few]:
            a, b, f = got[(i, j, 0)], got[(i, j, 1)], want.pop((i, j))[2]
            out[columns[i]][j] = a + (b - a) * f
    if not want:
        return out
    lo = {k: -math.inf for k in want}
    hi = {k: math.inf for k in want}
    below = {k: 0 for k in want}          # rows strictly below lo
    size = {k: n[k[0]] for k in want}     # rows inside [lo, hi]
    slack = 2
    while True:
        wide = [k for k in want if size[k] > bracket_rows and lo[k] < hi[k]]
        if not wide:
            break
        picks = []
        for k in wide:
            v = F.col(f"v{k[0]}")
            a = max(0.0, (want[k][0] - below[k]) / size[k] - slack / accuracy)
            b = min(1.0, (want[k][1] + 1 - below[k]) / size[k] + slack / accuracy)
            inside = F.when((v >= lo[k]) & (v <= hi[k]), v)
            picks.append(F.percentile_approx(inside, F.array(F.lit(a), F.lit(b)), accuracy)
                         .alias(f"b{k[0]}_{k[1]}"))
        found = vals.agg(*picks).first()
        trial = {k: tuple(found[f"b{k[0]}_{k[1]}"]) for k in wide}
        checks = []
        for k in wide:
            v, (a, b) = F.col(f"v{k[0]}"), trial[k]
            checks += [F.count(F.when(v < a, 1)).alias(f"l{k[0]}_{k[1]}"),
                       F.count(F.when((v >= a) & (v <= b), 1)).alias(f"s{k[0]}_{k[1]}")]
        seen = vals.agg(*checks).first()
        moved = False
        for k in wide:
            under, held = seen[f"l{k[0]}_{k[1]}"], seen[f"s{k[0]}_{k[1]}"]
            if under <= want[k][0] and want[k][1] < under + held and held < size[k]:
                lo[k], hi[k] = trial[k]
                below[k], size[k] = under, held
                moved = True
        if not moved:
            if slack > accuracy:
                break
            slack *= 8
    keys = sorted(want)
    entries = F.array(*[
        F.when((F.col(f"v{i}") >= lo[(i, j)]) & (F.col(f"v{i}") <= hi[(i, j)]),
               F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("v")))
        for i, j in keys])
    counts = (vals.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")
              .groupBy("i", "j", "v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("cum", F.sum("c").over(w))
    got = _at_ranks(cum, {(i, j, s): want[(i, j)][s] - below[(i, j)] for i, j in keys for s in (0, 1)})
    for i, j in keys:
        a, b, f = got[(i, j, 0)], got[(i, j, 1)], want[(i, j)][2]
        out[columns[i]][j] = a + (b - a) * f
    return out
