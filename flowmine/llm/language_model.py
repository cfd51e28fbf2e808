"""Language-model scores: the summed probability of all segmentations of a text.

The public vocabulary's unigram scores weigh every segmentation of a word; the
forward recursion in log space over the word's piece lattice gives its marginal
probability. A word that the training documents hold has one more way: the
whole word, with its relative frequency there. The two are mixed with the
Good-Turing estimate of unseen mass, u = words seen once / tokens:

    P(word) = (1 - u) * count / N + u * sum of its segmentations

and the end of a text, a token of its own, takes the vocabulary's end piece. A
text's probability is the product over its words and its end, which is the sum
over all paths of the text's lattice, since no piece crosses a blank.

Documents are dealt to chunks by a hash of id and text. A chunk counts its words and
sends each distinct one once, as a sorted packed 64-bit hash with its count in
training documents, to the hash's bucket; a bucket sums the counts of its
words over all chunks and answers every chunk in the chunk's own order. Words
with equal hashes count as equal. No vocabulary is gathered anywhere.

Edge cases: a null or blank text is its end alone. A null id counts as the
empty text for the training split. Without training tokens every word has its
segmentations only. Repeated rows are counted and scored as often as they
occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmine.llm.chunks import CHUNK_BYTES, pack_sorted, text_bytes, unpack_sorted
from flowmine.llm.common import stage
from flowmine.llm.pieces import MODEL, lattice, load_pieces, total_log_p
from flowmine.llm.trellis import LONGEST, Trellis

FOLDS, HELD_OUT = 7, 2
#: Text behind one bucket of words.
BUCKET_BYTES = 32 << 20
REPORT = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double")


class _Words:
    """Lower-cased words of one chunk: their hashes in order, and each row's words as places in that order."""

    def __init__(self, rows: pa.Table, buckets: int):
        numbers: dict[bytes, int] = {}
        parts = []
        for t in rows.column("text"):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.words = list(numbers)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        step = np.uint64(64 - (buckets.bit_length() - 1))
        edges = np.arange(1, buckets, dtype=np.uint64) << step if buckets > 1 else np.zeros(0, np.uint64)
        self.cuts = np.concatenate(([0], np.searchsorted(self.hashes, edges), [len(self.hashes)])).tolist()

    def counted(self, rows_in: np.ndarray) -> np.ndarray:
        """Occurrences of each word, in order of the hashes, in the rows marked."""
        used = self.at[np.repeat(rows_in, self.lengths)]
        return np.bincount(used, minlength=len(self.words))[self.order].astype(np.int64)


def _send(buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words = _Words(rows, buckets)
        counts = words.counted(~np.asarray(rows.column("held_out").to_pylist(), bool))
        used = [b for b in range(buckets) if words.cuts[b] < words.cuts[b + 1]]
        spans = [slice(words.cuts[b], words.cuts[b + 1]) for b in used]
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "packed": pa.array([pack_sorted(words.hashes[s]) for s in spans], pa.binary()),
            "counts": pa.array([_planes(counts[s]) for s in spans], pa.binary())})
    return run


def _planes(counts: np.ndarray) -> bytes:
    """Counts as byte planes without those that are all zero."""
    n = max(1, -(-int(counts.max()).bit_length() // 8)) if len(counts) else 1
    return np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplaned(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    low = np.frombuffer(packed, np.uint8).reshape(-1, n)
    out[:, :len(low)] = low.T
    return out.view(np.int64).ravel()


def _sum_up(key: tuple, rows: pa.Table) -> pa.Table:
    """Each chunk's words with their counts over all chunks; the first row also has the bucket's totals."""
    rows = rows.sort_by("chunk")
    hashes = [unpack_sorted(p.as_py()) for p in rows.column("packed")]
    counts = [_unplaned(c.as_py(), len(h)) for c, h in zip(rows.column("counts"), hashes)]
    words, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    answers = np.split(total[place], np.cumsum([len(h) for h in hashes])[:-1])
    n, first = rows.num_rows, [0] * (rows.num_rows - 1)
    return pa.table({
        "chunk": rows.column("chunk"), "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
        "counts": pa.array([_planes(a) for a in answers], pa.binary()),
        "tokens": pa.array([int(total.sum()), *first], pa.int64()),
        "kinds": pa.array([int((total > 0).sum()), *first], pa.int64()),
        "once": pa.array([int((total == 1).sum()), *first], pa.int64())})


def _score(buckets: int, shipped, n: int, ends: int, unseen: float):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = shipped.value
        words = _Words(rows, buckets)
        counts = np.zeros(len(words.words), np.int64)
        for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("counts")):
            lo, hi = words.cuts[b], words.cuts[b + 1]
            counts[words.order[lo:hi]] = _unplaned(packed.as_py(), hi - lo)
        units = [" " + w.decode("utf-8", "surrogatepass") for w in words.words]
        subword = Trellis(pieces).log_sums(units)
        for i in (i for i, u in enumerate(units) if len(u) > LONGEST):
            subword[i] = total_log_p(lattice(pieces, units[i]))

        def mixed(count, log_p):
            with np.errstate(divide="ignore"):
                seen = np.log((1.0 - unseen) * np.asarray(count, float) / max(n, 1))
            return np.logaddexp(seen, np.log(unseen) + log_p) / np.log(10)

        starts = np.concatenate(([0], np.cumsum(words.lengths)))
        some = words.lengths > 0

        def by_row(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(words.lengths))
            if some.any():
                out[some] = np.add.reduceat(values[words.at], starts[:-1][some])
            return out

        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"),
            "n_tokens": pa.array(words.lengths + 1),
            "n_known": pa.array(by_row((counts > 0).astype(float)).astype(np.int64) + (ends > 0)),
            "base_sum": pa.array(by_row(np.log10(counts + 1.0)) + np.log10(ends + 1.0)),
            "score": pa.array(by_row(mixed(counts, subword)) + float(mixed(ends, pieces.end_log_p)))})
    return run


def dealt(docs: DataFrame, id_col: str, text: str, folds: int, held_out: int, chunks: int) -> DataFrame:
    """(doc_id, text, held_out, chunk) of every row; a missing or repeated id does not gather texts in one chunk."""
    name, body = F.col(id_col).cast("long"), F.col(text).cast("string")
    return docs.select(
        name.alias("doc_id"), body.alias("text"),
        (F.pmod(F.crc32(F.coalesce(name.cast("string"), F.lit(""))), F.lit(folds)) == held_out).alias("held_out"),
        F.pmod(F.xxhash64(name, body), F.lit(chunks)).cast("long").alias("chunk"))


def score_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL,
                 folds: int = FOLDS, held_out: int = HELD_OUT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows whose crc32 of the id leaves another
    remainder than ``held_out`` modulo ``folds``. ``base_score`` is the add-one
    word unigram, ``score`` the log10 probability of the text under the model.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text)
    chunks, buckets = max(1, -(-total // chunk_bytes)), 1
    while buckets * BUCKET_BYTES < total:
        buckets *= 2
    rows = dealt(docs, id_col, text, folds, held_out, chunks)
    sent = rows.groupBy("chunk").applyInArrow(_send(buckets), "bucket int, chunk long, packed binary, counts binary")
    answers = stage(sent.groupBy("bucket").applyInArrow(
        _sum_up, "chunk long, bucket int, counts binary, tokens long, kinds long, once long"))
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "once")]).first()
    ends = rows.filter("not held_out").count()
    n, kinds, once = sums[0] + ends, sums[1] + (ends > 0), sums[2] + (ends == 1)
    unseen = min(max(once / n, 1.0 / (n + 1)), 1.0) if n else 1.0
    shipped = spark.sparkContext.broadcast(load_pieces(model))           # bounded: one vocabulary
    scored = rows.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(
        _score(buckets, shipped, n, ends, unseen), REPORT)
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         base.alias("base_score"), "score")
