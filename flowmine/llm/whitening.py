"""Whitening of vectors on the grid of 1/64: blockwise QR, bidiagonal qd solver.

Every entry c becomes the integer x = floor(64 c) + 1000000. The fit takes each
distinct x vector once: n vectors with per-dimension sums S, so n x - S is the
centred vector times n, exact in integers. Tasks reduce blocks of centred rows to
triangles by QR and hand on one triangle each; those are stacked and reduced in
two more rounds. What is left, R with R^T R = n V, is solved by ``bidiagonal``:
Householder bidiagonalisation, dqds for the singular values, twisted
factorisations for the vectors. The covariance V is never formed.

Vectors of each length are a space of their own with its own fit; the fits are
small (length times components) and broadcast while they are together under
``MAX_SHIPPED`` numbers, beyond that rows meet their fit in a join of blocks.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries
are left out. Components without variance to working precision (all of them if
there is one distinct vector) are left out too, so such a table gives no rows.
Entries of more than about 1.4e17 are taken as that (x stays within 63 bits). A
deviation beyond 63 bits is null. Rows that repeat, have the same id or none are
all returned. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmine.llm.bidiagonal import right_singular
from flowmine.llm.common import stage

COMPONENTS, GRID, OFFSET = 16, 64, 1_000_000
#: Rows of a block of QR, and fits that a round of merging takes together.
BLOCK, FAN = 2048, 64
#: Numbers of all fits together that are broadcast.
MAX_SHIPPED = 4_000_000
_LIMIT = 1 << 62
_PART = "dims int, part long, r array<double>"
_REPORT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType()))])


class Fit(NamedTuple):
    """n and exact sums of the fit list; unit vectors in columns, their variances and the share of all variance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def gridded(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of every row with a sound vector."""
    e = F.col(vector).cast("array<double>")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(
        e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    far = float(1 << 57)
    x = F.transform(e, lambda c: F.floor(F.least(F.greatest(c, F.lit(-far / 2)), F.lit(far / 2)) * F.lit(GRID)) + F.lit(OFFSET))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, their vectors) for each length in the batch's column x."""
    lists = batch.column("x")
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(starts)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        for lo in range(0, len(at), BLOCK):
            rows = at[lo:lo + BLOCK]
            yield d, rows, flat[starts[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, n, high, low) of a task: sums of x as high * 2^32 + low, exact for up to 2^30 rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for d, _, x in _by_length(batch):
            n, high, low = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            held[d] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
    if held:
        yield pa.RecordBatch.from_pydict({
            "dims": pa.array(list(held), pa.int32()), "n": pa.array([h[0] for h in held.values()], pa.int64()),
            "high": pa.array([h[1] for h in held.values()], pa.list_(pa.int64())),
            "low": pa.array([h[2] for h in held.values()], pa.list_(pa.int64()))})


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit where it fits, Python integers beyond."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + max(map(abs, sums.tolist()), default=0) < _LIMIT:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _row(dims: int, part: int, r: np.ndarray) -> dict:
    return {"dims": dims, "part": part, "r": r.ravel().tolist()}


def _reduce(means: dict[int, tuple[int, np.ndarray]]):
    """A task's blocks of centred rows to one triangle for each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                n, sums = means[d]
                block = centred(x, n, sums).astype(float) / n
                held[d] = _triangle(np.vstack([held[d], block]) if d in held else block)
        if held:
            rows = [_row(d, part, r) for d, r in held.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("dims", pa.int32()), ("part", pa.int64()), ("r", pa.list_(pa.float64()))]))
    return run


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    d = key[0].as_py()
    whole = None
    for r in rows.sort_by("part").column("r"):
        r = r.values.to_numpy().reshape(-1, d)
        whole = r if whole is None else _triangle(np.vstack([whole, r]))
    return pa.Table.from_pylist([_row(d, key[1].as_py() if len(key) > 1 else 0, whole)], rows.schema)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length over the rows of ``x`` (column x, taken as they are)."""
    parts = x.select("x").mapInArrow(_sums, "dims int, n long, high array<long>, low array<long>")
    parts = stage(parts)
    totals = {r["dims"]: r["n"] for r in parts.groupBy("dims").agg(F.sum("n").alias("n")).collect()}
    means: dict[int, tuple[int, np.ndarray]] = {d: (n, np.zeros(d, object)) for d, n in totals.items()}
    pairs = parts.select("dims", F.posexplode(F.arrays_zip("high", "low")).alias("at", "p"))
    for r in pairs.groupBy("dims", "at").agg(F.sum("p.high").alias("h"), F.sum("p.low").alias("l")).collect():
        means[r["dims"]][1][r["at"]] = (r["h"] << 32) + r["l"]
    triangles = x.select("x").mapInArrow(_reduce(means), _PART)
    triangles = triangles.groupBy("dims", F.floor(F.col("part") / FAN).alias("f")).applyInArrow(_merge, _PART)
    out = {}
    for r in triangles.groupBy("dims").applyInArrow(_merge, _PART).toLocalIterator():       # length x length each
        n, sums = means[r["dims"]]
        squares, vectors, total = right_singular(np.array(r["r"]).reshape(-1, r["dims"]), components)
        out[r["dims"]] = Fit(n, sums, vectors, squares / n, squares / total if total else squares)
    return out


def _apply(fitted: Fit, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
    """(deviations, whitened rows)."""
    exact = centred(x, fitted.n, fitted.sums)
    real = exact.astype(float)
    if (real ** 2).sum(axis=1).max(initial=0.0) < _LIMIT:
        deviations = (exact.astype(np.int64) ** 2).sum(axis=1).tolist()
    else:
        deviations = [v if v < 1 << 63 else None for v in ((exact.astype(object) ** 2).sum(axis=1)).tolist()]
    return deviations, real / fitted.n @ fitted.vectors / np.sqrt(fitted.variances)


def _whitened(ids, places, fitted: Fit, x: np.ndarray) -> pa.RecordBatch:
    deviations, white = _apply(fitted, x)
    k, m = white.shape[1], len(white)
    offsets = pa.array(np.arange(m + 1) * k, pa.int32())
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(places)), pa.array([fitted.n] * m, pa.int64()), pa.array(deviations, pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
        pa.ListArray.from_arrays(offsets, pa.array(np.tile(fitted.explained, m)))],
        ["id", "n", "deviation", "whitened", "explained"])


def transform(rows: DataFrame, fits: dict[int, Fit], max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(id, n, deviation, whitened, explained) of every row of ``gridded``: arrays by component."""
    spark = rows.sparkSession
    if sum(f.vectors.size + 2 * len(f.sums) for f in fits.values()) <= max_shipped:
        shipped = spark.sparkContext.broadcast(fits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, places, x in _by_length(batch):
                    yield _whitened(batch.column("id"), places, shipped.value[d], x)
        return rows.select("id", "x").mapInArrow(run, _REPORT)

    import pickle

    blocks = {d: -(-f.n // (BLOCK * 8)) for d, f in fits.items()}
    table = spark.createDataFrame([(d, b, pickle.dumps(f)) for d, f in fits.items() for b in [blocks[d]]],
                                  "dims int, blocks long, fit binary")
    dealt = (rows.withColumn("dims", F.size("x")).join(table.select("dims", "blocks"), "dims")
             .withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("blocks"))))
    sent = table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not left.num_rows:
            return to_arrow_schema(_REPORT).empty_table()
        fitted = pickle.loads(right.column("fit")[0].as_py())
        out = [_whitened(batch.column("id"), places, fitted, x)
               for batch in left.combine_chunks().to_batches() for _, places, x in _by_length(batch)]
        return pa.Table.from_batches(out)
    return dealt.select("dims", "block", "id", "x").groupBy("dims", "block").cogroup(
        sent.groupBy("dims", "block")).applyInArrow(meet, _REPORT)


def identity_error(distinct: DataFrame, fits: dict[int, Fit]) -> float:
    """Largest absolute entry, over all fits, of the covariance of the whitened fit list minus the identity."""
    shipped = distinct.sparkSession.sparkContext.broadcast(
        {d: f._replace(explained=np.zeros(0)) for d, f in fits.items() if len(f.variances)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                if d in shipped.value:
                    white = _apply(shipped.value[d], x)[1]
                    held[d] = held.get(d, 0) + white.T @ white
        yield pa.RecordBatch.from_pylist(
            [_row(d, 0, m) for d, m in held.items()],
            pa.schema([("dims", pa.int32()), ("part", pa.int64()), ("r", pa.list_(pa.float64()))]))

    parts = distinct.select("x").mapInArrow(run, _PART).select("dims", F.posexplode("r").alias("at", "v"))
    worst = 0.0
    products: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dims", "at").agg(F.sum("v").alias("v")).collect():      # components squared for each length
        k = len(fits[r["dims"]].variances)
        products.setdefault(r["dims"], np.zeros(k * k))[r["at"]] = r["v"]
    for d, m in products.items():
        k = len(fits[d].variances)
        worst = max(worst, float(np.abs(m.reshape(k, k) / fits[d].n - np.eye(k)).max()))
    return worst


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                     components: int = COMPONENTS, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every sound row and component."""
    rows = stage(gridded(vectors, id_col, vector))
    distinct = stage(rows.select("x").distinct())
    fits = fit(distinct, components)
    error = identity_error(distinct, fits)
    out = transform(rows, fits, max_shipped)
    return out.select("id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "v")).select(
        "id", (F.col("k") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained",
        F.lit(error).alias("identity_error"))
