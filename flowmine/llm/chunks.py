"""Documents dealt into chunks of bounded size, so that a task holds one chunk's text at a time."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
#: Bounds that the driver may hold; with more text than this many chunks, chunks grow.
MAX_CHUNKS = 200_000
#: Chunk numbers that a range of ids has where one id is dealt further.
_WITHIN = 1 << 32


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def range_chunks(docs: DataFrame, id_col: str, name: str, total: int, chunk_bytes: int = CHUNK_BYTES,
                 text: str = "text") -> DataFrame:
    """``docs`` with a chunk number that never falls as (id, xxhash64 of the text) grows; a null id comes last.

    The bounds are approximate quantiles of the ids (one pass over that column).
    Where ids are missing or one spans several quantiles, the rows of each id with
    more text than a chunk are dealt further by ranges of their text's hash; only
    copies of a row stay together then.
    """
    n = min(MAX_CHUNKS, -(-total // chunk_bytes))
    if n <= 1:
        return docs.withColumn(name, F.when(F.col(id_col).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    ids = F.col(id_col)
    found, nulls = docs.agg(F.percentile_approx(ids, [i / n for i in range(1, n)], max(10_000, 10 * n)),
                            F.count_if(ids.isNull())).first()
    found = found or []
    large = {}
    if nulls or len(set(found)) < len(found):
        room = -(-total // n)
        held = docs.groupBy(ids.alias("id")).agg(F.sum(F.octet_length(F.col(text))).alias("b")).filter(F.col("b") > room)
        large = {r["id"]: -(-r["b"] // room) for r in held.collect()}                    # at most n rows
    bounds = sorted({float(b) for b in [*found, *(i for i in large if i is not None)]})
    value, slot = f"{name}_value", f"{name}_slot"
    if bounds:
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=value, outputCol=slot)
        slots = cut.transform(docs.withColumn(value, F.coalesce(ids.cast("double"), F.lit(0.0)))).drop(value)
    else:
        slots = docs.withColumn(slot, F.lit(0.0))
    slots = slots.withColumn(slot, F.when(ids.isNull(), F.lit(len(bounds) + 1)).otherwise(F.col(slot)).cast("long"))
    if not large:
        return slots.withColumnRenamed(slot, name)
    # One large id a slot: ids beyond 2^53 may share one, the largest is dealt then.
    at = {float(b): i + 1 for i, b in enumerate(bounds)}
    table = {len(bounds) + 1 if i is None else at[float(i)]: (i, parts)
             for i, parts in sorted(large.items(), key=lambda x: x[1])}
    low, parts = f"{name}_low", f"{name}_parts"
    shape = f"{slot} long, {low} {docs.schema[id_col].dataType.simpleString()}, {parts} long"
    dealt = slots.join(F.broadcast(docs.sparkSession.createDataFrame([(k, *v) for k, v in table.items()], shape)), slot, "left")
    share = F.floor((F.xxhash64(F.col(text)).cast("double") / 2.0 ** 64 + 0.5) * F.col(parts))
    within = F.when(F.col(parts).isNull() | (ids < F.col(low)), F.lit(0)).when(
        ids > F.col(low), F.lit(_WITHIN - 1)).otherwise(F.least(share, F.col(parts) - 1) + 1)
    return dealt.withColumn(name, F.col(slot) * _WITHIN + within).select(*docs.columns, name)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte plane by byte plane, without the planes that are all zero."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    planes = max(1, -(-int(gaps[1:].max()).bit_length() // 8)) if len(gaps) > 1 else 1
    low = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + gaps[:1].tobytes() + np.ascontiguousarray(low.T).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes, first = packed[0], np.frombuffer(packed, np.uint64, 1, 1)
    low = np.frombuffer(packed, np.uint8, offset=9).reshape(planes, -1)
    gaps = np.zeros((low.shape[1] + 1, 8), np.uint8)
    gaps[1:, :planes] = low.T
    gaps = gaps.view(np.uint64).ravel()
    gaps[0] = first[0]
    return np.cumsum(gaps)
