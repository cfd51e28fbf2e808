"""Train-fitted imputation, scaling, one-hot encoding and binning.

``fit`` reads train rows and keeps a few numbers per column; ``transform`` only
applies them and never looks at the data it is given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.columns import bins_below, finite_or_null, quote
from flowmine.operators.blocks import add_running
from flowmine.operators.quantiles import exact_quantiles
from flowmine.operators.slices import SLICE_ROWS, sliced
from flowmine.session import cut_lineage


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without values gets 0."""
    q = exact_quantiles(df, columns, [0.5])
    return {c: q[c][0] if q[c][0] is not None else 0.0 for c in columns}


def impute(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.select(*[
        F.coalesce(finite_or_null(quote(c)), F.lit(float(values[c]))).alias(c) if c in values else quote(c)
        for c in df.columns])


def ranges(df: DataFrame, columns: Sequence[str], fill: Mapping[str, float]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column; the fill value counts where cells are missing."""
    row = df.agg(*[f(finite_or_null(quote(c))).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"] if row[f"a{i}"] is not None else fill[c],
                row[f"b{i}"] if row[f"b{i}"] is not None else fill[c]) for i, c in enumerate(columns)}


def positions(values: DataFrame, value: str, rows: int = SLICE_ROWS) -> DataFrame:
    """(value, position): place of each distinct value in sorted order, from 0, counted slice by slice."""
    marked, block = sliced(values.withColumn("__all", F.lit(0)), ["__all"], [value], rows)
    out = add_running(marked, ["__all"], [value], block, {"__no": F.lit(1).cast("long")})
    return out.select(F.col(value).alias("value"), (F.col("__no") - 1).cast("long").alias("position"))


@dataclass
class Preprocessor:
    """Median imputation, min-max scaling and one-hot encoding.

    A categorical column of up to ``wide`` values becomes a 0/1 column per value.
    One of more becomes a single sparse vector column ``<name>=*``, whose positions
    are a staged table of the sorted values, joined when rows are transformed: no
    value goes through the driver or into the plan. Values unseen in training and
    missing ones are all zeros in either form.
    """

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    wide: int = 1000
    clip: bool = True
    constant_value: float = 0.0
    medians_: dict[str, float] | None = None
    ranges_: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories_: dict[str, list] = field(default_factory=dict)
    positions_: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Preprocessor":
        self.medians_ = medians(train, self.numeric)
        self.ranges_ = ranges(train, self.numeric, self.medians_) if self.numeric else {}
        for c in self.categorical:
            values = train.select(quote(c).alias("value")).filter(F.col("value").isNotNull()).distinct()
            found = [r[0] for r in values.limit(self.wide + 1).collect()]
            if len(found) <= self.wide:
                self.categories_[c] = sorted(found)
            else:
                table = cut_lineage(positions(values, "value"))
                self.positions_[c] = (table, table.count())
        return self

    @property
    def output_columns(self) -> list[str]:
        """Numeric columns and those of narrow categories."""
        return [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in self.categories_.get(c, ())]]

    @property
    def vector_columns(self) -> list[str]:
        return [f"{c}=*" for c in self.positions_]

    def _scaled(self, c: str) -> Column:
        low, high = self.ranges_[c]
        if high - low <= 0:
            return F.lit(float(self.constant_value)).alias(c)
        x = F.coalesce(finite_or_null(quote(c)), F.lit(float(self.medians_[c])))
        x = (x - F.lit(low)) / F.lit(high - low)
        if self.clip:
            x = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
        return x.alias(c)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns as they are, then the output columns, then the vector columns."""
        if self.medians_ is None:
            raise RuntimeError("transform before fit")
        cols = [quote(c) for c in keep] + [self._scaled(c) for c in self.numeric]
        for c in self.categorical:
            cols += [F.coalesce((quote(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}={v}")
                     for v in self.categories_.get(c, ())]
        for i, (c, (table, size)) in enumerate(self.positions_.items()):
            found = table.select(F.col("value").alias(f"__v{i}"), F.col("position").alias(f"__p{i}"))
            df = df.join(found, quote(c) == F.col(f"__v{i}"), "left")
            # Positions past the last one are left out of the vector.
            df = df.withColumn(f"__p{i}", F.coalesce(f"__p{i}", F.lit(size)).cast("double"))
            one = df.sparkSession.range(1).select(F.lit(float(size - 1)).alias(f"__p{i}"))
            df = OneHotEncoder(inputCol=f"__p{i}", outputCol=f"__o{i}", handleInvalid="keep").fit(one).transform(df)
            cols.append(F.col(f"__o{i}").alias(f"{c}=*"))
        return df.select(*cols)

    def parameters(self, df: DataFrame) -> DataFrame:
        """Fitted numbers as a table (column, median, low, high)."""
        rows = [(c, float(self.medians_[c]), float(self.ranges_[c][0]), float(self.ranges_[c][1]))
                for c in self.numeric]
        return df.sparkSession.createDataFrame(rows, "column string, median double, low double, high double")


@dataclass
class FlowStates:
    """Discretises up to three columns into a state such as ``D0|B2|P1``."""

    columns: dict[str, str | None]
    bins: int = 3
    edges_: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "FlowStates":
        have = [c for c in self.columns.values() if c]
        probs = [i / self.bins for i in range(1, self.bins)]
        q = exact_quantiles(train, have, probs)
        for key, c in self.columns.items():
            self.edges_[key] = sorted({v for v in q[c] if v is not None}) if c else []
        return self

    def state(self) -> Column:
        parts = []
        for key, c in self.columns.items():
            b = bins_below(F.coalesce(finite_or_null(quote(c)), F.lit(0.0)), self.edges_[key]) if c else F.lit(0)
            parts.append(F.concat(F.lit(key), b.cast("string")))
        return F.concat_ws("|", *parts)

    def transform(self, df: DataFrame, name: str = "event") -> DataFrame:
        return df.withColumn(name, self.state())
