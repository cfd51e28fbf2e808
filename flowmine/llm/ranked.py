"""Ranked lexical search: range-maximum sparse tables, best-first document intervals.

Two passes over the documents answer a block of queries. The first counts the
documents, their terms and the documents that hold each query term. In the
second a task gathers documents into segments of bounded size and orders each
segment so that documents with the same commonest query term, then of like
length, are neighbours. Each query term has a posting list over those places with
the impact (its whole contribution to a score) of every posting, and a sparse
table for the place of the greatest impact in any range of the list.

A query starts with one interval, the segment. An interval's bound is the sum
over the query's terms of the greatest impact in it, a range-maximum answer each;
no document in it scores more. The intervals with the largest bounds are split
first, each at the document with its greatest single impact: that document is
scored in full and both sides get bounds of their own. Intervals whose bound is
under the k-th best score so far are dropped. A segment gives at most k
documents for each query, and the k best of those are the answer.

Scores are 64-bit integers as in ``impacts``; equal scores go by ascending id,
rows without an id last.

Edge cases: a null or empty text, or one without terms, is no document; a query
without terms has no answer. Rows that repeat an id are documents of their own,
as are queries that repeat an id. Very long texts are one document like any other.
Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmine.llm.common import stage

TOP = 10
#: Postings of query terms and documents that a segment gathers.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1_500_000, 60_000
#: UTF-8 bytes of the queries that are answered together; more make more rounds over the documents.
QUERY_BYTES = 8 << 20
#: Intervals split at a time, at least.
SPLIT = 32
_FOUND = "query long, doc_id long, score long"

#: Other characters of ASCII than letters and digits separate terms; capitals are lowered.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """Contribution of a term that occurs ``tf`` times in a document of ``n`` terms; integers, rounded down."""
    top = int(n.max(initial=0)) * 90 * docs
    share = n.astype(np.int64) * (90 * docs) // max(tokens, 1) if top < 1 << 63 else np.array(
        [90 * int(x) * docs // tokens for x in n.tolist()], np.int64)
    tf = tf.astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + share)))


class SparseTable:
    """Places of the greatest values of ranges of one list, or of several in a row; ties go to the first."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.levels = values, [np.arange(len(values), dtype=np.int32)]
        size = 1
        while 2 * size <= longest:
            last = self.levels[-1]
            left, right = last[:-size], last[size:]
            self.levels.append(np.where(values[right] > values[left], right, left))
            size *= 2

    def places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For ranges [low, high), none empty."""
        level = np.frexp(high - low)[1] - 1                  # floor of the logarithm
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            left, right = self.levels[k][low[at]], self.levels[k][high[at] - (1 << k)]
            out[at] = np.where(self.values[right] > self.values[left], right, left)
        return out


class Segment:
    """Posting lists of some documents, term after term, and their sparse table."""

    def __init__(self, ids: list, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weights: np.ndarray, docs: int, tokens: int):
        size = len(ids)
        # A document's commonest term, of the rarest among those, keeps like documents together.
        best = np.lexsort((-weights[term], -tf, doc))
        lead = np.full(size, -1, np.int64)
        heads = best[np.concatenate(([True], np.diff(doc[best]) != 0))] if len(best) else best
        lead[doc[heads]] = term[heads]
        order = np.lexsort((n, lead))
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        self.ids = [ids[i] for i in order.tolist()]
        rows = np.lexsort((place[doc], term))
        term, self.docs, n_of = term[rows], place[doc[rows]], n[doc[rows]]
        self.impact = impacts(weights[term], tf[rows], n_of, docs, tokens)
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.keys = term * size + self.docs                  # sorted: finds a document in a list
        self.size = size
        self.table = SparseTable(self.impact, int(np.diff(self.starts).max(initial=0)))

    def top(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents above zero, and any more that tie with the last."""
        terms = query[self.starts[query] < self.starts[query + 1]]
        if not len(terms):
            return []
        # Pairs of an interval and a term with postings in it, interval by interval.
        term, low, high = terms, self.starts[terms], self.starts[terms + 1]
        counts = np.array([len(terms)])
        best = self.table.places(low, high)
        bound = np.array([self.impact[best].sum()])
        scored = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = 1
        while True:
            alive = bound >= least
            if not alive.any():
                break
            keep = np.repeat(alive, counts)
            term, low, high, best = term[keep], low[keep], high[keep], best[keep]
            counts, bound = counts[alive], bound[alive]
            take = max(SPLIT, len(bound) // 2)               # the best first; of many, half at a time
            if len(bound) > take:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, take - 1)[:take]] = True
            else:
                chosen = np.ones(len(bound), bool)
            own = np.repeat(chosen, counts)
            t, lo, hi, at, c = term[own], low[own], high[own], best[own], counts[chosen]
            first = np.concatenate(([0], np.cumsum(c)[:-1]))
            # The document with the greatest impact of the interval: the first among ties.
            value = self.impact[at]
            peak = np.repeat(np.maximum.reduceat(value, first), c)
            split = np.repeat(np.minimum.reduceat(np.where(value == peak, self.docs[at], self.size), first), c)
            cut = np.searchsorted(self.keys, t * self.size + split)
            cut = np.minimum(np.maximum(cut, lo), hi)
            hit = (cut < hi) & (self.docs[np.minimum(cut, len(self.docs) - 1)] == split)
            points = np.add.reduceat(np.where(hit, self.impact[np.minimum(cut, len(self.docs) - 1)], 0), first)
            scored = np.append(scored[0], points), np.append(scored[1], split[first])
            if len(scored[0]) > k:
                least = max(1, int(np.partition(scored[0], -k)[-k]))
                good = scored[0] >= least
                scored = scored[0][good], scored[1][good]
            # Both sides: pairs that still have postings.
            nodes = np.repeat(np.arange(len(c)), c)
            left, right = lo < cut, cut + hit < hi
            node = np.concatenate([nodes[left] * 2, nodes[right] * 2 + 1])
            new = np.concatenate([t[left], t[right]]), np.concatenate([lo[left], (cut + hit)[right]]), \
                np.concatenate([cut[left], hi[right]])
            order = np.argsort(node, kind="stable")
            node, new = node[order], [x[order] for x in new]
            peaks = self.table.places(new[1], new[2]) if len(node) else np.zeros(0, np.int64)
            sizes = np.bincount(node, minlength=2 * len(c))
            sums = np.zeros(2 * len(c), np.int64)
            np.add.at(sums, node, self.impact[peaks])
            some = sizes > 0
            rest = ~own
            term, low, high = (np.concatenate([x[rest], y]) for x, y in zip((term, low, high), new))
            best = np.concatenate([best[rest], peaks])
            counts = np.concatenate([counts[~chosen], sizes[some]])
            bound = np.concatenate([bound[~chosen], sums[some]])
        return list(zip(scored[0].tolist(), scored[1].tolist()))


def _counted(batch: pa.RecordBatch, numbers: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, terms with repeats, distinct query terms, their occurrences) of the rows with a term."""
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        terms = terms_of(text.as_py())
        if terms:
            known = np.fromiter(map(numbers.get, terms, repeat(-1)), np.int64, len(terms))
            found, times = np.unique(known[known >= 0], return_counts=True)
            yield row, len(terms), found, times


def _statistics(numbers):
    """A task's documents, terms and documents by query term: (term, n); -1 counts documents, -2 terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(numbers.value), np.int64)
        docs = tokens = 0
        for batch in batches:
            for _, n, found, _ in _counted(batch, numbers.value):
                docs, tokens = docs + 1, tokens + n
                held[found] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([held[some], [docs, tokens]]))], ["term", "n"])
    return run


def _search(shipped, k: int, postings: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, queries, weights, docs, tokens = shipped.value
        ids, lengths, terms, times, size = [], [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            counts = np.array([len(t) for t in terms], np.int64)
            segment = Segment(ids, np.array(lengths, np.int64), np.repeat(np.arange(len(ids)), counts),
                              np.concatenate(terms), np.concatenate(times), weights, docs, tokens)
            rows = []
            for number, query in queries:
                found = [(-score, segment.ids[at] is None, segment.ids[at] or 0, segment.ids[at])
                         for score, at in segment.top(query, k)]
                rows += [(number, i, -score) for score, _, _, i in sorted(found, key=lambda x: x[:3])[:k]]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                                 ["query", "doc_id", "score"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for row, n, found, seen in _counted(batch, numbers):
                if not len(found):
                    continue
                ids.append(names[row])
                lengths.append(n)
                terms.append(found)
                times.append(seen)
                size += len(found)
                if size >= postings or len(ids) >= most_docs:
                    yield from close()
                    ids, lengths, terms, times, size = [], [], [], [], 0
        if ids:
            yield from close()
    return run


def _answered(docs: DataFrame, queries: list, k: int, postings: int, most_docs: int) -> DataFrame:
    """(query, doc_id, score) for one block of (number, text); at most k rows a query and segment."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    parsed = []
    for number, text in queries:
        own = sorted({numbers.setdefault(t, len(numbers)) for t in terms_of((text or "").encode("utf-8", "surrogatepass"))})
        if own:
            parsed.append((number, np.array(own, np.int64)))
    shared = spark.sparkContext.broadcast(numbers)                         # at most QUERY_BYTES of text
    told = docs.select("text").mapInArrow(_statistics(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in told.collect()}                   # as many as query terms
    n, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.array([counts.get(i, 0) for i in range(len(numbers))], float)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    shipped = spark.sparkContext.broadcast((numbers, parsed, weights, n, tokens))
    return docs.mapInArrow(_search(shipped, k, postings, most_docs), _FOUND)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = TOP, postings: int = SEGMENT_POSTINGS, most_docs: int = SEGMENT_DOCS,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each query.

    Queries are answered in blocks of about ``query_bytes`` of text, a pass over the
    documents each; what a block broadcasts and gathers is bounded by that.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = stage(asked.withColumn("query", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text")
        part = stage(_answered(rows, [tuple(r) for r in own.collect()], k, postings, most_docs))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
