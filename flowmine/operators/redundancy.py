"""Redundant features: near-constant, duplicate and rank-correlated columns."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.functions.columns import quote
from flowmine.operators.blocks import add_running
from flowmine.operators.slices import SLICE_ROWS, sliced
from flowmine.session import cut_lineage
from flowmine.settings import SelectionSettings

#: Ranked values of a column up to which they are broadcast (about 100 MB).
RANK_ROWS = 1_000_000


def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Population variances, all columns in one aggregate."""
    row = df.agg(*[F.var_pop(quote(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def column_digests(df: DataFrame, row_id: str, columns: Sequence[str]) -> dict[str, tuple]:
    """Order-free digest of every column: two xor-ed hashes of (row, value)."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.bit_xor(F.xxhash64(F.col(row_id), quote(c))).alias(f"a{i}"),
                  F.bit_xor(F.xxhash64(quote(c), F.lit(17), F.col(row_id))).alias(f"b{i}")]
    row = df.agg(*parts).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


def average_ranks(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(i, v, r): average rank, from 1, of each distinct value of the i-th column; equal values share theirs."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), quote(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    counts = cut_lineage(df.select(F.explode(cells).alias("e")).groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n")))
    marked, block = sliced(counts, ["i"], ["v"], slice_rows)
    upto = add_running(marked, ["i"], ["v"], block, {"upto": F.col("n")})
    return cut_lineage(upto.select("i", "v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("r")))


def rank_correlation(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS) -> np.ndarray:
    """Spearman matrix over all rows (features squared); undefined entries are 0.

    Values are ranked once each by running counts; the rows then look their ranks
    up, in a broadcast table unless a column has more than ``RANK_ROWS`` values.
    Missing cells are an error.
    """
    ranks = average_ranks(df, columns, slice_rows)
    sizes = {r["i"]: (r["n"], r["gaps"]) for r in ranks.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v").isNull() | F.isnan("v"), 1)).alias("gaps")).collect()}
    gaps = [columns[i] for i, (_, g) in sizes.items() if g]
    if gaps:
        raise ValueError(f"missing values in {gaps}")
    rows = df.select(*[quote(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    varied = {i: n for i, (n, _) in sorted(sizes.items()) if n > 1}
    for i, n in varied.items():
        table = ranks.filter(F.col("i") == i).select(F.col("v").alias(f"f{i}"), F.col("r").alias(f"r{i}"))
        rows = rows.join(F.broadcast(table) if n <= RANK_ROWS else table, f"f{i}").drop(f"f{i}")
    pairs = list(itertools.combinations(varied, 2))
    m = np.eye(len(columns))
    found = rows.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else {}
    for i, j in pairs:
        m[i, j] = m[j, i] = found[f"c{i}_{j}"]
    return m


@dataclass
class RedundancyFilter:
    """Keeps the first column of every redundant group."""

    settings: SelectionSettings = field(default_factory=SelectionSettings)
    kept: list[str] = field(default_factory=list)
    dropped: dict[str, tuple[str, str | None, float | None]] = field(default_factory=dict)

    def fit(self, train: DataFrame, columns: Sequence[str], row_id: str, seed: int = 42) -> "RedundancyFilter":
        s = self.settings
        for c, v in variances(train, columns).items():
            if v is None or not np.isfinite(v) or v <= s.variance_epsilon:
                self.dropped[c] = ("low_variance", None, v)
        cols = [c for c in columns if c not in self.dropped]
        first: dict[tuple, str] = {}
        digests = column_digests(train, row_id, cols) if cols else {}
        twins = {c: first[digests[c]] for c in cols
                 if first.setdefault(digests[c], c) != c}
        if twins:
            # Digests only propose; equality is counted.
            row = train.agg(*[F.count(F.when(~quote(c).eqNullSafe(quote(t)), 1)).alias(f"d{i}")
                              for i, (c, t) in enumerate(twins.items())]).first()
            for i, (c, t) in enumerate(twins.items()):
                if row[i] == 0:
                    self.dropped[c] = ("duplicate", t, None)
        cols = [c for c in cols if c not in self.dropped]
        if len(cols) > 1 and s.spearman_threshold < 1.0:
            strong = np.abs(rank_correlation(train, cols))
            for j in range(1, len(cols)):
                # The strongest earlier partner counts, even if it was dropped itself.
                partner = int(np.argmax(strong[:j, j]))
                if strong[partner, j] > s.spearman_threshold:
                    self.dropped[cols[j]] = ("spearman", cols[partner], float(strong[partner, j]))
        self.kept = [c for c in cols if c not in self.dropped]
        return self

    def report(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            [(c, r, p, v) for c, (r, p, v) in self.dropped.items()],
            "feature string, reason string, partner string, value double")
