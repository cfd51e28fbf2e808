"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells.

Equal vectors are folded first. Spark's k-means with cosine distance is fitted
on a sample of at most ``FIT_ROWS`` vectors; every vector goes to its nearest
centre (its home) and also, as a guest, to each cell whose bounding plane it is
within the margin of. Two vectors at angle t with different homes lie on the two
sides of the plane between these; the angles at which they rise over it add up
to at most t, so the lower one is at most sin(t / 2) away from it and visits the
other's home. With that margin (``spill`` = 1, the least that is taken) every
pair within the threshold is found, in any number of dimensions. A pair is looked
at where one of the two is at home, and counts in the lower of the two homes if
both see it.

The members of a cell at home and its guests are dealt to blocks of about
``BLOCK``; a block of members meets each block of the cell in a task of its own,
guests never meet guests. A task returns link counts and a spanning forest, never
its pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and stay; vectors of another length than most
link among their own length only. Rows that repeat an id count as vectors of
their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import stage
from flowmine.llm.components import connected_components, find_roots, unite

THRESHOLD = 0.95
FIT_ROWS, CELL_ROWS, MAX_CELLS = 50_000, 500, 4096
SPILL = 1.0
BLOCK, STRIP = 4000, 250
#: Rows of a batch that placing gives out.
COPIES = 10_000


def _folded(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, key, e): key is equal for equal vectors and null for those that link with nothing."""
    e = F.col(vector).cast("array<double>")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.when(sound, F.md5(F.array_join(e, ","))).alias("key"), F.when(sound, e).alias("e"))


def fit_cells(reps: DataFrame, n: int, dims: int, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS,
              seed: int = 11) -> np.ndarray:
    """Unit centres, about one for ``cell_rows`` vectors, from a bounded sample of them."""
    k = min(MAX_CELLS, n // cell_rows)
    if k < 2:
        return np.zeros((1, dims))
    part = reps.select(array_to_vector("e").alias("features"))
    if n > fit_rows:
        part = part.sample(fraction=fit_rows / n, seed=seed)
    model = KMeans(k=k, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine").fit(part)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def _placed(reps: DataFrame, centres: np.ndarray, dims: int, threshold: float, spill: float,
            whole: bool = True) -> DataFrame:
    """A row for each cell a vector goes to, with its home; at home also all its cells. Not ``whole``: cell and home only."""
    # The small terms keep rounding on the safe side.
    reach = min(1.0, spill * math.sqrt(max(0.0, (1 - threshold) / 2) + 1e-14))
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0) + 1e-12) * reach + 1e-12

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("e")
            sizes = np.diff(lists.offsets.to_numpy())
            usual = np.flatnonzero(sizes == dims)
            home, cells = -sizes.astype(np.int64), [[-int(s)] for s in sizes]
            flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for lo in range(0, len(usual), 1000):
                rows = usual[lo:lo + 1000]
                x = flat[starts[rows][:, None] + np.arange(dims)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sims = x @ centres.T
                own = sims.argmax(axis=1)
                near = sims[np.arange(len(rows)), own][:, None] - sims <= apart[own]
                near[np.arange(len(rows)), own] = True
                home[rows] = own
                for r, mask in zip(rows.tolist(), near):
                    cells[r] = np.flatnonzero(mask).tolist()
            at = np.repeat(np.arange(n), [len(c) for c in cells])
            cell, homes = np.concatenate(cells), home[at]
            for lo in range(0, len(at), COPIES):
                part, to = at[lo:lo + COPIES], slice(lo, lo + COPIES)
                columns = {"cell": pa.array(cell[to], pa.int64()), "home": pa.array(homes[to])}
                if whole:
                    out = batch.take(pa.array(part))
                    columns |= {"id": out.column("id"), "m": out.column("m"), "e": out.column("e"), "cells": pa.array(
                        [cells[i] if h else None for i, h in zip(part.tolist(), (cell[to] == homes[to]).tolist())],
                        pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "cell long, home long" + (", id long, m long, e array<double>, cells array<long>" if whole else "")
    return reps.select("id", "m", "e").mapInArrow(run, schema)


def _compare(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cell, left, right = (k.as_py() for k in key)
        n = rows.num_rows
        rows = rows.combine_chunks()
        ids, weight = rows.column("id").to_numpy(), rows.column("m").to_numpy().astype(float)
        home, part = rows.column("home").to_numpy(), rows.column("part").to_numpy()
        x = rows.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = [c or [] for c in rows.column("cells").to_pylist()]         # guests have none
        cells = np.full((n, max(map(len, lists))), np.iinfo(np.int64).min)
        for i, c in enumerate(lists):
            cells[i, :len(c)] = c
        links, parent = np.zeros(n), np.arange(n)
        at_home = home == cell
        a, b = np.flatnonzero(part == left), np.flatnonzero(part == right)
        # The left block is at home; the right one may be of guests.
        for strip in (a[lo:lo + STRIP] for lo in range(0, len(a), STRIP)):
            i, j = np.nonzero(x[strip] @ x[b].T >= threshold)
            i, j = strip[i], b[j]
            if left == right:
                once = i < j
                i, j = i[once], j[once]
            seen_there = (cells[i] == home[j][:, None]).any(axis=1)
            own = at_home[j] | ~seen_there | (cell < home[j])
            i, j = i[own], j[own]
            links += np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
            unite(parent, i, j)
        roots = find_roots(parent, np.arange(n))
        some = np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(ids[some]), "root": pa.array(ids[roots[some]]),
                         "links": pa.array(links[some].astype(np.int64))})
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                           threshold: float = THRESHOLD, spill: float = SPILL, cell_rows: int = CELL_ROWS,
                           block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    if spill < 1:
        raise ValueError("a spill of under 1 misses pairs")
    rows = stage(_folded(vectors, id_col, vector))
    sound = rows.filter(F.col("key").isNotNull())
    reps = stage(sound.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"),
                                          F.first("e").alias("e"))
                 .select("key", F.xxhash64("key").alias("id"), "first", "m", "e"))
    usual = reps.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           F.lit(True).alias("kept"))
    dims, n = usual["d"], usual["count"]
    centres = fit_cells(reps.filter(F.size("e") == dims), n, dims, fit_rows, cell_rows)
    at_home = F.col("cell") == F.col("home")
    sizes = stage(_placed(reps, centres, dims, threshold, spill, whole=False).groupBy("cell").agg(
        F.ceil(F.count_if(at_home) / block).alias("homes"), F.ceil(F.count_if(~at_home) / block).alias("guests")))
    # Blocks of members come first, then those of guests; guests meet members only.
    homes, guests = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) for c in ("homes", "guests"))
    dealt = (_placed(reps, centres, dims, threshold, spill).join(sizes, "cell", "left")
             .withColumn("part", F.when(at_home, F.pmod(F.xxhash64("id"), homes))
                         .otherwise(homes + F.pmod(F.xxhash64("id"), guests)))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(at_home, homes + guests)
                                                   .otherwise(homes) - 1)))
             .select("id", "m", "e", "cell", "home", "cells", "part",
                     F.least("part", "o").alias("left"), F.greatest("part", "o").alias("right")))
    found = stage(dealt.groupBy("cell", "left", "right").applyInArrow(
        _compare(threshold), "id long, root long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("id", "root"), "id", "root")
    told = (reps.select("key", "id", "first", "m").join(links, "id", "left")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select("key", "first", F.coalesce("root", "id").alias("root"),
                    (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    told = told.join(told.groupBy("root").agg(F.min("first").alias("component_id")), "root") \
        .select("key", "n_links", "component_id")
    return rows.select("id", "key").join(told, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
