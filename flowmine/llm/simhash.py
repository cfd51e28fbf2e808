"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints within four
bits agree in one segment up to two bits, so the Hamming balls of radius one
around their values in that segment share a key. Every distinct fingerprint is
stored and looked up under the 33 keys of the ball in each segment (66 rows,
whatever the data), keys that meet are compared in full, and only links with
the whole distance at most four count. A task hands on a spanning forest of the
links it found, never all pairs of a group. A key with more fingerprints than
``RUN`` is dealt out again in blocks, all pairs of blocks in separate tasks.

Edge cases: null and blank texts have fingerprint zero and link like any other;
texts of one to three words hash the whole sequence. Copies share a
fingerprint and are compared once. An empty table gives an empty result; rows
with a null id keep their row and take the smallest non-null id of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import stage, unused
from flowmine.llm.components import connected_components, find_roots, unite

SHINGLE = 4
RADIUS = 4
SEED = 42
RUN = 20_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n, bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, h) of every row; h is the xxhash64 of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((fingerprint(t.as_py()) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, batch.column(2)], ["id", "fp", "h"])

    body = F.col(text).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("h"))
    return rows.mapInArrow(run, "id long, fp long, h long")


def ball_keys(fp: Column) -> Column:
    """The keys of the radius-one balls around both segments."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))
    flips = [0] + [1 << i for i in range(32)]
    return F.array(*[seg.bitwiseXOR(F.lit(m)) for seg in (low, high) for m in flips])


def _links(run: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between fingerprints of the same run.

    ``run`` is sorted. A pair counts only at the smallest key both balls hold,
    so that it is not joined again under each of the others.
    """
    nodes, local = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    high = (key >> np.uint64(32)).astype(bool)
    seg = np.where(high, (fp >> np.uint64(32)) | np.uint64(1 << 32), fp & np.uint64(0xFFFFFFFF))
    at = np.arange(len(run))
    shift = 1
    while True:
        at = at[at + shift < len(run)]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            break
        other = at + shift
        hit = np.bitwise_count(fp[at] ^ fp[other]) <= RADIUS
        i, j = at[hit], other[hit]
        apart = seg[i] ^ seg[j]
        first = apart & (~apart + np.uint64(1))                    # lowest differing bit
        d = np.bitwise_count(apart)
        least = np.where(d == 0, seg[i], np.where(d == 1, np.minimum(seg[i], seg[j]),
                                                  np.minimum(seg[i] ^ first, seg[j] ^ first)))
        own = (key[i] == least) & (d <= 2)
        unite(parent, local[i[own]], local[j[own]])
        shift += 1
    roots = find_roots(parent, np.arange(len(nodes)))
    linked = roots != np.arange(len(nodes))
    return nodes[linked], nodes[roots[linked]]


def _compare(limit: int | None):
    """Batches of (block, key, fp), sorted, to edges (false, a, b) and rows of long runs (true, key, fp)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []          # (3, n) arrays that no finished run has used yet
        size, long_run = 0, None

        def out(hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), hot)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                ["hot", "a", "b"])

        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1] > 1:
                change = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
                ids = np.concatenate(([0], np.cumsum(change)))
                many = np.bincount(ids)[ids] > 1
                if many.any():
                    a, b = _links(ids[many], rows[1][many], rows[2][many])
                    if len(a):
                        yield out(False, a, b)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)])
            if not rows.shape[1]:
                continue
            if long_run is not None:
                same = (rows[0] == long_run[0]) & (rows[1] == long_run[1])
                if same.any():
                    yield out(True, rows[1][same], rows[2][same])
                    rows = rows[:, ~same]
                if not rows.shape[1]:
                    continue
                long_run = None
            held.append(rows)
            rows = np.concatenate(held, axis=1)
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(last))
            yield from close(rows[:, :cut])
            rest = rows[:, cut:]
            size = rest.shape[1]
            if limit is not None and size > limit:
                long_run = (rest[0][0], rest[1][0])
                yield out(True, rest[1], rest[2])
                held = []
            else:
                held = [rest]
        if held:
            yield from close(np.concatenate(held, axis=1))

    return run


def _compared(rows: DataFrame, limit: int | None) -> DataFrame:
    return (rows.repartition("key", "block").sortWithinPartitions("block", "key", "fp")
            .select("block", "key", "fp").mapInArrow(_compare(limit), "hot boolean, a long, b long"))


def fingerprint_links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """Edges (a, b) that join all fingerprints of ``fps`` (distinct, column fp) within the radius."""
    keyed = fps.select("fp", F.explode(ball_keys(F.col("fp"))).alias("key")).withColumn("block", F.lit(0).cast("long"))
    found = stage(_compared(keyed, run))
    hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    edges = found.filter("not hot").select("a", "b")
    if hot.isEmpty():
        return edges
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / run).alias("n"))
    dealt = (hot.join(blocks, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
             .select("key", "fp", (F.least("c", "o") * F.col("n") + F.greatest("c", "o")).alias("block")))
    return edges.unionAll(_compared(dealt, None).select("a", "b"))


def _placed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, h, fp, root, component_id) of every row; h is the hash of its text, equal roots are one component."""
    prints = stage(with_fingerprints(docs, id_col, text))
    least = stage(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(fingerprint_links(least.select("fp")))
    placed = (least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; the component is its smallest id."""
    return _placed(docs, id_col, text).select("id", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; columns unchanged.

    Of rows that repeat the smallest id with other texts, that with the smallest
    hash of the text is kept; of those that repeat the text as well, one, chosen by
    a hash of all columns. A group without any id keeps one row in the same way.
    """
    counted = _placed(docs, id_col, text).groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("copies"))
    key = F.struct(F.col("id").isNull().alias("late"), "id", "h", "copies")
    heads = stage(counted.groupBy("root").agg(F.min(key).alias("k")).select("k.id", "k.h", "k.copies"))
    head, hashed = unused(docs, "head_id"), unused(docs, "head_hash")
    rows = docs.withColumns({head: F.col(id_col).cast("long"), hashed: F.xxhash64(F.col(text).cast("string"))})
    # Few heads repeat or have no id; only their rows are grouped.
    single, many = (heads.filter(f"id is not null and copies {which}").select(
        F.col("id").alias(head), F.col("h").alias(hashed)) for which in ("= 1", "> 1"))
    unnamed = heads.filter("id is null").select(F.col("h").alias(hashed))
    kept = rows.join(single, [head, hashed], "left_semi").select(*docs.columns)
    some = heads.agg(F.expr("count_if(id is null)"), F.expr("count_if(id is not null and copies > 1)")).first()

    def one_each(found: DataFrame, *keys: str) -> DataFrame:
        own = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
        return found.groupBy(*keys).agg(own.alias("row")).select("row.*")

    if some[1]:
        kept = kept.unionAll(one_each(rows.join(many, [head, hashed], "left_semi"), head, hashed))
    if some[0]:
        kept = kept.unionAll(one_each(rows.filter(F.col(head).isNull()).join(unnamed, hashed, "left_semi"), hashed))
    return kept
