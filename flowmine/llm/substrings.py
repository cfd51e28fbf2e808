"""Substring dedup: repeated windows of words are found by Rabin-Karp hashes and cut out.

Documents are dealt into chunks by ranges of their id, and those of an id with
more text than a chunk by the hash of their text, so that an earlier chunk holds
earlier documents. A chunk rolls a Rabin-Karp hash over every window of
``window`` words, keeps each distinct hash once, sorts them and sends them to
the hash's bucket as packed differences (about six bytes a window). A bucket
counts in how many chunks a hash occurs and answers each chunk with one bit a
hash: an earlier chunk has it. The chunk then knows for each of its windows
whether the same words start earlier, merges those windows into maximal
intervals and removes the words in them. The text is shuffled once, to its
chunk; the passage that a third of all documents share is sent once per chunk.

Windows with equal 64-bit hashes count as equal: over n windows about
n * n / 2 ** 65 pairs are taken for equal by chance.

Edge cases: a null or blank text has no words and nothing is removed; a text
with fewer words than a window keeps all. Documents without an id come after
all others. Rows that share an id or have none follow each other in the order of
their texts' xxhash64, then text, so a repeated row loses what the first one keeps. An
empty table gives an empty result; other columns are carried along unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmine.llm.chunks import CHUNK_BYTES, pack_sorted, range_chunks, text_bytes, unpack_sorted
from flowmine.llm.common import WORD_PATTERN, Numbers, unused

WINDOW = 20
BASE = 0x9E3779B97F4A7C15
#: Windows that one bucket should hold, and the mean bytes of a word behind that.
BUCKET_WINDOWS, WORD_BYTES = 1_000_000, 6
_WORD = re.compile(WORD_PATTERN)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window of word hashes: the sum of w[i+j] * BASE^(window-1-j) modulo 2^64, mixed."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    sums = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    sums[0] = 1
    np.cumprod(sums, out=sums)
    sums *= words
    np.cumsum(sums, out=sums)
    sums[window:] -= sums[:-window].copy()
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    up *= sums
    h = up[window - 1:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_hash(text: str | None) -> int:
    """Spark's xxhash64 of a text, by which ``range_chunks`` deals."""
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class _Chunk:
    """Windows of the texts of one chunk, in order of (id, hash of the text, text)."""

    def __init__(self, rows: pa.Table, id_col: str, text: str, window: int, buckets: int):
        ids = rows.column(id_col)
        hashes = np.zeros(rows.num_rows, np.int64)
        if ids.null_count or len(pc.unique(ids)) < len(ids):
            hashes = np.fromiter((text_hash(t.as_py()) for t in rows.column(text)), np.int64, rows.num_rows)
        keys = pa.table([ids, pa.array(hashes), rows.column(text)], ["id", "hash", "text"])
        self.rows = rows.take(pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in keys.column_names]))
        self.texts = self.rows.column(text)
        numbers, parts = Numbers(), []
        for t in self.texts:
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        del numbers, parts
        rolled = window_hashes(hashes[ids], window)
        del ids, hashes
        inside = np.ones(len(rolled), bool)                          # windows inside one text
        for before in range(1, window):
            ends = self.offsets[1:] - before
            inside[ends[(ends >= 0) & (ends < len(rolled))]] = False
        self.starts = np.flatnonzero(inside).astype(np.int32)
        rolled = rolled[inside]
        del inside
        self.order = np.argsort(rolled, kind="stable").astype(np.int32)
        rolled = rolled[self.order]
        self.fresh = np.ones(len(rolled), bool)
        self.fresh[1:] = rolled[1:] != rolled[:-1]
        self.distinct = rolled[self.fresh]
        del rolled
        step = np.uint64(64 - (buckets.bit_length() - 1))
        edges = np.arange(1, buckets, dtype=np.uint64) << step if buckets > 1 else np.zeros(0, np.uint64)
        self.cuts = np.concatenate(([0], np.searchsorted(self.distinct, edges), [len(self.distinct)]))

    def removed(self, earlier: np.ndarray, window: int) -> np.ndarray:
        """Per word of the chunk, whether a window over it starts earlier elsewhere."""
        again = ~self.fresh | earlier[np.cumsum(self.fresh) - 1]
        starts = self.starts[self.order[again]]
        edges = np.bincount(starts, minlength=self.offsets[-1] + 1)
        edges -= np.bincount(starts + window, minlength=self.offsets[-1] + 1)
        return np.cumsum(edges)[:-1] > 0


def _send(id_col: str, text: str, window: int, buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, id_col, text, window, buckets)
        used = [b for b in range(buckets) if chunk.cuts[b] < chunk.cuts[b + 1]]
        pa.default_memory_pool().release_unused()               # workers wait for later stages with little
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "packed": pa.array([pack_sorted(chunk.distinct[chunk.cuts[b]:chunk.cuts[b + 1]]) for b in used], pa.binary())})
    return run


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("chunk")
    parts = [unpack_sorted(p.as_py()) for p in rows.column("packed")]
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")                        # equal hashes stay in order of chunk
    earlier = np.zeros(len(hashes), bool)
    earlier[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    ends = np.cumsum([len(p) for p in parts])
    flags = np.split(earlier, ends[:-1])
    hit = [i for i, f in enumerate(flags) if f.any()]
    chunks = rows.column("chunk").to_pylist()
    return pa.table({
        "chunk": pa.array([chunks[i] for i in hit], pa.int64()),
        "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()),
        "bits": pa.array([np.packbits(flags[i]).tobytes() for i in hit], pa.binary())})


def intervals(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words as (first, one past the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words of the runs; a run goes with the separators after its words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, stop in runs:
        out.append(text[at:spans[first][0]])
        at = spans[stop][0] if stop < len(spans) else len(text)
    return "".join(out) + text[at:]


def _finish(id_col: str, text: str, window: int, buckets: int, digest: bool, out: pa.Schema):
    def run(rows: pa.Table, bits: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        chunk = _Chunk(rows, id_col, text, window, buckets)
        earlier = np.zeros(len(chunk.distinct), bool)
        for b, packed in zip(bits.column("bucket").to_pylist(), bits.column("bits")):
            lo, hi = chunk.cuts[b], chunk.cuts[b + 1]
            earlier[lo:hi] = np.unpackbits(np.frombuffer(packed.as_py(), np.uint8), count=hi - lo).astype(bool)
        gone = chunk.removed(earlier, window)
        counts = np.add.reduceat(np.append(gone, False).astype(np.int64), chunk.offsets[:-1]) * (chunk.lengths > 0)
        columns: dict[str, list] = {"n_removed": counts.tolist(), "intervals": [], "kept": [], "digest": []}
        for i, t in enumerate(chunk.texts):
            mask = gone[chunk.offsets[i]:chunk.offsets[i + 1]]
            runs = intervals(mask) if counts[i] else []
            columns["intervals"].append([{"start": a, "stop": b} for a, b in runs])
            if digest:
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept = compress(words, (~mask).tolist()) if runs else words
                columns["digest"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            else:
                columns["kept"].append(cut(t.as_py(), runs) if runs else t.as_py())
        if digest:
            return pa.table([chunk.rows.column(id_col), pa.array(chunk.lengths), pa.array(columns["n_removed"]),
                             pa.array(columns["digest"]), pa.array(columns["intervals"], out.field(4).type)], schema=out)
        table = chunk.rows.set_column(chunk.rows.schema.get_field_index(text), text, pa.array(columns["kept"], pa.string()))
        return table.select(out.names[:-1]).append_column(
            out.names[-1], pa.array(columns["n_removed"], pa.int64())).cast(out)
    return run


def _deduplicated(docs: DataFrame, id_col: str, text: str, window: int, chunk_bytes: int, digest: bool,
                  schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    total = text_bytes(docs, text)
    buckets = 1
    while buckets * BUCKET_WINDOWS * WORD_BYTES < total:
        buckets *= 2
    name = unused(docs, "chunk_")
    dealt = range_chunks(docs, id_col, name, total, chunk_bytes, text)
    sent = dealt.groupBy(name).applyInArrow(
        _send(id_col, text, window, buckets), "bucket int, chunk long, packed binary")
    bits = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, bits binary")
    finish = _finish(id_col, text, window, buckets, digest, to_arrow_schema(schema))
    return dealt.groupBy(name).cogroup(bits.groupBy("chunk")).applyInArrow(finish, schema)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, intervals) of every document.

    ``intervals`` are the maximal runs of removed words, [start, stop) by word.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        T.StructField("intervals", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])
    return _deduplicated(rows, "doc_id", "text", window, chunk_bytes, True, schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                chunk_bytes: int = CHUNK_BYTES, count: str = "n_removed") -> DataFrame:
    """``docs`` with repeated windows cut out of the text, and the number of words removed."""
    count = unused(docs, count)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField(count, T.LongType())])
    return _deduplicated(docs, id_col, text, window, chunk_bytes, False, schema)
