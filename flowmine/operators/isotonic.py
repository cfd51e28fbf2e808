"""Rising least-squares fits over any number of distinct scores.

Adjacent scores whose rates fall are pooled. Scores pooled inside a stretch of the
score axis stay together whatever lies outside it, so each slice of a class is
pooled in a task of its own, and neighbouring slices are pooled again, a few at a
time, until one is left per group. The blocks that remain have rising, distinct
rates of whole numbers, so n rows leave at most about n^(2/3) of them (fewer than
0.9 million of a billion rows): a bound that a task can hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.operators.slices import SLICE_ROWS, sliced
from flowmine.session import cut_lineage

#: Neighbouring slices that one task pools.
FAN_IN = 16


def pool_adjacent(pos: Sequence[int], size: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Blocks (first, last, positives, rows) of rising rates; whole numbers, so ties are exact."""
    blocks: list[tuple[int, int, int, int]] = []
    for i, (p, n) in enumerate(zip(pos, size)):
        first = i
        while blocks and blocks[-1][2] * n >= p * blocks[-1][3]:
            first, _, before, rows = blocks.pop()
            p, n = p + before, n + rows
        blocks.append((first, i, p, n))
    return blocks


def _pooled(pdf: pd.DataFrame, group: Sequence[str]) -> pd.DataFrame:
    pdf = pdf.sort_values("low", ignore_index=True)
    found = np.array(pool_adjacent(pdf["pos"].tolist(), pdf["n"].tolist()), dtype=np.int64)
    keys = {c: np.repeat(pdf[c].to_numpy()[:1], len(found)) for c in [*group, "part"]}
    return pd.DataFrame({**keys, "low": pdf["low"].to_numpy()[found[:, 0]], "high": pdf["high"].to_numpy()[found[:, 1]],
                         "pos": found[:, 2], "n": found[:, 3]})


def rising_blocks(counts: DataFrame, group: Sequence[str], score: str = "score", rows: int = SLICE_ROWS,
                  stage=cut_lineage) -> DataFrame:
    """Blocks (group, low, high, pos, n) of the rising fit of ``pos / (pos + neg)`` on the score.

    ``counts`` has one row per group and distinct score, with whole ``pos`` and
    ``neg``. Its group columns must not be NULL; scores that are NULL or NaN and
    scores without a row are left out. No row in gives no row out.
    """
    points = counts.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.col("pos") + F.col("neg") > 0)).select(
        *group, F.col(score).alias("low"), F.col(score).alias("high"), F.col("pos").cast("long").alias("pos"),
        (F.col("pos") + F.col("neg")).cast("long").alias("n"))
    points, block = sliced(points, group, ["low"], rows, "part")
    if block is None:
        points = points.withColumn("part", F.lit(0).cast("long"))
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "part", "low", "high", "pos", "n"])
    while True:
        points = points.groupBy(*group, "part").applyInPandas(lambda pdf: _pooled(pdf, group), schema)
        if block is None:
            return points.drop("part")
        points = stage(points)
        last = points.agg(F.max("part")).first()[0]
        if not last:
            return points.drop("part")
        points = points.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))


def fit_models(blocks: DataFrame, group: str, values: Sequence[int], score: str = "score") -> dict[int, IsotonicRegressionModel]:
    """One model per value of ``group``, fitted on both ends of each of its blocks.

    The ends rise already, so the library only joins them: between blocks the
    calibrated value runs straight from one rate to the next.
    """
    rate = F.col("pos") / F.col("n")
    ends = F.array(F.col("low"), F.col("high"))
    points = blocks.select(group, F.explode(F.array_distinct(ends)).alias(score), rate.alias("label"),
                           (F.col("n") / F.size(F.array_distinct(ends))).alias("w"))
    return {v: IsotonicRegression(featuresCol=score, labelCol="label", weightCol="w").fit(
        points.filter(F.col(group) == v)) for v in values}
