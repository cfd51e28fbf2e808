"""SentencePiece encoding with N-best segmentations, and decoding.

The lattice of a text falls into units (see ``pieces``). For each unit the
forward Viterbi pass gives the best score up to every position; backward scores
give the loss of the second best path. A text's N best paths change at most the
N - 1 units whose second path loses least; only for those does A* search the
unit backwards from its end with the forward scores as exact estimate, and the
lists are merged best first.

Scores within 1e-7 count as tied (see ``pieces.nbest``), so paths closer than that
may come in either order.

Edge cases: a null text is encoded like an empty one (no pieces, one path, score
zero) and decoding a null list gives null; decoding what was encoded gives the
text back, whatever characters it holds. Repeated rows are encoded alike, an
empty table gives an empty result, and clashing columns of the input are not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import Numbers
from flowmine.llm.pieces import MODEL, UNIT, Pieces, forward, lattice, load_pieces, nbest
from flowmine.llm.trellis import LONGEST, Trellis

NBEST = 4
#: Characters encoded at a time; each distinct unit among them is searched once.
BATCH_CHARS = 1_000_000

ENCODED = ("n_pieces long, score double, ids array<int>, "
           "alternatives array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>")


def _best(trellis: Trellis, units: list[str]):
    """(ids, bounds, scores, losses) of the best paths; units too long to stack go one by one."""
    flat, bounds, scores, losses = trellis.best_paths(units)
    far = [i for i, u in enumerate(units) if len(u) > LONGEST]
    if far:
        parts = np.split(flat, bounds[1:-1])
        for i in far:
            ways = nbest(lattice(trellis.pieces, units[i]), 2)
            parts[i], scores[i] = np.array(ways[0][1], np.int64), ways[0][0]
            losses[i] = ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf
        flat, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return flat, bounds, scores, losses


def _paths(pieces: Pieces, unit: str, own: tuple[int, ...], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """(loss, ids) of the n best paths of a unit, its best one first."""
    edges = lattice(pieces, unit)
    best = forward(edges)
    others = [(max(best[-1] - s, 0.0), ids) for s, ids in nbest(edges, n, best) if ids != own]
    return [(0.0, own), *others[:n - 1]]


def _merged(lists: list[tuple[int, list]], n: int) -> list[tuple[float, tuple]]:
    """The n least summed losses, one choice per list; each with the choices that are not the first."""
    best: list[tuple[float, tuple]] = [(0.0, ())]
    for place, options in lists:
        best = heapq.nsmallest(n, ((loss + o[0], chosen + ((place, o[1]),) if k else chosen)
                                   for loss, chosen in best for k, o in enumerate(options)))
    return best


class _Alternatives:
    """The column of next best paths, gathered in flat arrays."""

    def __init__(self):
        self.scores, self.at, self.n, self.ids = array("d"), array("i"), array("i"), array("i")
        self.ways, self.edits, self.ends = array("i", [0]), array("i", [0]), array("i", [0])

    def add(self, ways: list[tuple[float, list]]) -> None:
        """A row's paths: (score, [(at, n, ids)])."""
        for score, edits in ways:
            self.scores.append(score)
            for at, n, ids in edits:
                self.at.append(at)
                self.n.append(n)
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
            self.edits.append(len(self.at))
        self.ways.append(len(self.scores))

    def column(self) -> pa.ListArray:
        def flat(values: array) -> pa.Array:
            return pa.array(np.array(values))

        ids = pa.ListArray.from_arrays(flat(self.ends), flat(self.ids))
        edits = pa.StructArray.from_arrays([flat(self.at), flat(self.n), ids], ["at", "n", "ids"])
        ways = pa.StructArray.from_arrays(
            [flat(self.scores), pa.ListArray.from_arrays(flat(self.edits), edits)], ["score", "edits"])
        return pa.ListArray.from_arrays(flat(self.ways), ways)


def units_of(text: str) -> list[str]:
    return UNIT.findall(" " + text) if text else []


def _encode_all(texts: list[str], trellis: Trellis, n: int) -> list[pa.Array]:
    """Columns of ``ENCODED`` for some texts."""
    known = Numbers()
    numbers = [np.fromiter(map(known.__getitem__, u), np.int64, len(u)) for u in map(units_of, texts)]
    names = list(known)
    flat, stops, scores, losses = _best(trellis, names)
    ids, totals, alternatives = [], [], _Alternatives()
    for k in numbers:
        lengths = stops[k + 1] - stops[k]
        ends = np.cumsum(lengths)
        size = int(ends[-1]) if len(k) else 0
        ids.append(flat[np.repeat(stops[k] - (ends - lengths), lengths) + np.arange(size)])
        total = float(scores[k].sum())
        totals.append(total)
        loss = losses[k]
        if n < 2 or not len(k):
            near = []
        elif len(k) < n:
            near = range(len(k))
        else:                                                 # ties at the bound go to the earlier unit
            bound = np.partition(loss, n - 2)[n - 2]
            under = np.flatnonzero(loss < bound)
            near = sorted([*under, *np.flatnonzero(loss == bound)[:n - 1 - len(under)]])
        lists = [(int(p), _paths(trellis.pieces, names[k[p]], tuple(flat[stops[k[p]]:stops[k[p] + 1]].tolist()), n))
                 for p in near if np.isfinite(loss[p])]
        alternatives.add([(total - extra, [(int(ends[p] - lengths[p]), int(lengths[p]), new) for p, new in chosen])
                          for extra, chosen in _merged(lists, n)[1:]])
    counts = [len(x) for x in ids]
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
    return [pa.array(counts, pa.int64()), pa.array(totals, pa.float64()), pa.ListArray.from_arrays(offsets, values),
            alternatives.column()]


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NBEST, model: str = MODEL,
           check: bool = True) -> DataFrame:
    """(doc_id, n_pieces, score, ids, alternatives, round_trip) of every row.

    ``ids`` is the best segmentation and ``score`` its log-probability.
    ``alternatives`` are the next best ``n - 1``, fewer where the text has fewer
    paths: each replaces ``n`` ids from position ``at`` in the best one by its
    ``ids``. ``round_trip`` tells whether the decoded ids are the text again.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(load_pieces(model))       # bounded: one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shipped.value
        trellis = Trellis(pieces)
        raw = np.array(pieces.bytes_of(), object)
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(lengths) // BATCH_CHARS
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                rows = batch.slice(int(at[0]), len(at))
                texts = rows.column(1).to_pylist()
                columns = _encode_all(texts, trellis, n)
                ids = columns[2]
                ok = [_decoded(raw, ids[i].values.to_numpy()) == t for i, t in enumerate(texts)] if check else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *columns, pa.array(ok, pa.bool_())],
                    ["doc_id", "n_pieces", "score", "ids", "alternatives", "round_trip"])
                del texts, columns, ids
            pa.default_memory_pool().release_unused()          # workers wait for later stages with little

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {ENCODED}, round_trip boolean")


def _decoded(raw: np.ndarray, ids: np.ndarray) -> str:
    """The text of some ids: their bytes without the blank put before the text."""
    return b"".join(raw[ids].tolist())[1:].decode("utf-8", "replace")


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text of the id lists in ``ids``; null lists give null."""
    shipped = df.sparkSession.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("string")
    def texts(lists):
        raw = np.array(shipped.value.bytes_of(), object)
        return lists.map(lambda x: None if x is None else _decoded(raw, np.asarray(x, np.int64)))

    return df.withColumn(out, texts(F.col(ids)))
