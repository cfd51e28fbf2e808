"""Expressions over probability arrays and event arrays.

Probability arrays have one entry per class, so they are unrolled into scalar
expressions: these compile, while lambda expressions are interpreted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmine.functions.columns import plus

TINY = 1e-12


def entries(p: Column, n: int) -> list[Column]:
    return [F.get(p, F.lit(i)) for i in range(n)]


def array_sum(a: Column) -> Column:
    """Sum of an array whose length is not known when planning."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def argmax(p: Column) -> Column:
    """Zero-based position of the largest entry, the lowest on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def scaled(parts: Sequence[Column], least: float = 0.0) -> Column:
    """Parts over their sum; a row with no mass becomes uniform."""
    total = plus(parts)
    return F.array(*[F.when(total > least, x / total).otherwise(F.lit(1.0 / len(parts))) for x in parts])


def normalise(p: Column, n: int) -> Column:
    return scaled(entries(p, n))


def share_of_sum(p: Column) -> Column:
    """Entries over their sum, kept as one opaque step.

    Unrolled arrays are taken apart again by the optimizer where single entries
    are read; this form is computed once per row however often it is read.
    """
    return F.transform(p, lambda x: x / array_sum(p))


def align_classes(p: Column, seen: Sequence[int], n: int) -> Column:
    """Spread scores of the seen classes over all ``n``; others are zero."""
    where = {c: i for i, c in enumerate(seen)}
    return scaled([F.coalesce(F.get(p, F.lit(where[c])), F.lit(0.0)) if c in where else F.lit(0.0)
                   for c in range(n)])


def confidence(p: Column, n: int) -> Column:
    """One minus the entropy share: 1 for a one-hot row, 0 for a uniform one."""
    clipped = [F.greatest(F.least(x, F.lit(1.0)), F.lit(TINY)) for x in entries(p, n)]
    return F.lit(1.0) + plus([x * F.ln(x) for x in clipped]) / F.ln(F.lit(float(max(n, 2))))


def log_gaps(p: Column, n: int) -> list[Column]:
    """Log-probabilities less the largest of them."""
    logs = [F.ln(F.greatest(x, F.lit(TINY))) for x in entries(p, n)]
    top = F.greatest(*logs) if n > 1 else logs[0]
    return [v - top for v in logs]


def soften(p: Column, temperature: Column, n: int) -> Column:
    """Softmax of log-probabilities divided by a temperature."""
    e = [F.exp(v / temperature) for v in log_gaps(p, n)]
    total = plus(e)
    return F.array(*[v / total for v in e])


def contains_in_order(seq: Column, pattern: Column) -> Column:
    """Whether ``pattern`` occurs in ``seq`` in order, gaps allowed."""
    matched = F.aggregate(
        seq, F.lit(0),
        lambda i, e: F.when((i < F.size(pattern)) & (F.get(pattern, i) == e), i + 1).otherwise(i),
    )
    return matched == F.size(pattern)
