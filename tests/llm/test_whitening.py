import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from flowmine.llm import whitening as W
from flowmine.llm.bidiagonal import bidiagonalise, eigenvalues, right_singular
from flowmine.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, None if e is None else [None if x is None else float(x) for x in e], 0) for i, e in rows], SCHEMA)


def slow(rows, keep=16):
    """{length: (n, S, deviations by row, variances, vectors)} by plain integers and a full eigensolver."""
    out = {}
    for d in {len(e) for _, e in rows}:
        x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if len(e) == d]
        fit = sorted({tuple(v) for _, v in x})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        white = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
        values, vectors = np.linalg.eigh(white.T @ white / n)
        out[d] = n, sums, [(i, v, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x], values[::-1], vectors[:, ::-1]
    return out


def check(report, rows, keep=16, tight=1e-9):
    want = slow(rows)
    got = {}
    for r in report:
        got.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r)
    for d, (n, sums, told, values, vectors) in want.items():
        rank = min(keep, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
        for i, v, deviation in told:
            own = sorted(got[(i, n, deviation)], key=lambda r: r["component"])
            copies = sum(1 for j, u, _ in told if (j, u) == (i, v))
            assert [r["component"] for r in own] == sorted([*range(1, rank + 1)] * (len(own) // rank)) and len(own) >= rank * copies
        for r in report:
            if r["n"] == n and len(want) == 1:
                k = r["component"] - 1
                assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-8)
                v = next(u for j, u, _ in told if j == r["vec_id"])
                gap = min((abs(values[k] - x) for j, x in enumerate(values) if j != k), default=1.0)
                if gap > 1e-4 * values[0]:
                    plain = np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ vectors[:, k] / math.sqrt(values[k])
                    assert abs(abs(plain) - abs(r["whitened"])) < tight * (1 + abs(plain)) / (gap / values[0])
    assert all(r["identity_error"] <= 1e-7 for r in report) and len({r["identity_error"] for r in report}) <= 1
    return got


def test_equals_a_full_eigensolver(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(24, 24)) * np.linspace(2, 0.05, 24)
    rows = [(k, (rng.normal(size=24) @ mix).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(40)]                     # copies count once in the fit
    report = W.whitening_report(frame(spark, rows)).withColumnRenamed("id", "vec_id").collect()
    assert len(report) == 340 * 16
    check(report, rows)
    again = W.whitening_report(frame(spark, rows).repartition(7), max_shipped=0).withColumnRenamed("id", "vec_id").collect()
    first = {(r["vec_id"], r["component"]): r["whitened"] for r in report}
    assert len(again) == len(report)
    assert all(r["whitened"] == pytest.approx(first[(r["vec_id"], r["component"])], abs=1e-9) for r in again)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    good = [(6, [0.5, 0.25]), (6, [0.5, 0.25]), (None, [1.5, -2.0]), (7, [0.0, 0.0]), (8, [-0.01, 3.0])]
    other = [(9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 4.0]), (11, [5.0])]
    df = frame(spark, bad + good + other)
    report = W.whitening_report(df).collect()
    by = {}
    for r in report:
        by.setdefault(r["id"], []).append(r["component"])
    assert sorted(by[6]) == [1, 1, 2, 2] and by[9] == by[10] == [1] and 11 not in by and len(by[None]) == 2
    assert set(by) == {6, None, 7, 8, 9, 10}
    assert sorted(r["whitened"] for r in report if r["id"] in (9, 10)) == pytest.approx([-1, 1])
    assert W.whitening_report(frame(spark, [])).count() == W.whitening_report(frame(spark, bad)).count() == 0
    assert W.whitening_report(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    large = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0]), (4, [1e9, 0.0])]
    report = W.whitening_report(frame(spark, large)).collect()
    assert len(report) >= 4 and {r["deviation"] for r in report if r["id"] == 1} == {None}
    clash = frame(spark, good).withColumnRenamed("label", "x").selectExpr("*", "1 as id", "2 as component", "3 as n")
    assert W.whitening_report(clash).count() == 10


def test_exact_deviations(spark):
    rows = [(k, [float(k) * 1e6, -float(k), 0.015625 * k]) for k in range(1, 60)]
    report = W.whitening_report(frame(spark, rows)).collect()
    want = {i: dev for i, _, dev in slow(rows)[3][2]}
    assert {r["id"]: r["deviation"] for r in report} == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_singular_values_and_vectors():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    cases = [rng.normal(size=(200, 40)), q, rng.normal(size=(90, 5)) @ rng.normal(size=(5, 40)), rng.normal(size=(3, 40)),
             rng.normal(size=(200, 40)) * 10.0 ** (-np.arange(40) / 4), np.diag(np.r_[np.ones(9), np.zeros(31)]),
             np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)]
    for gap in (0, 1e-13, 1e-9, 1e-6, 1e-4):
        s = np.r_[3 + np.arange(8) * gap, 2 + np.arange(8) * gap, rng.random(24)]
        cases.append(np.linalg.qr(rng.normal(size=(120, 40)))[0] @ np.diag(s) @ q)
    for m in cases:
        squares, vectors, total = right_singular(m, 16)
        want = np.linalg.svd(m, compute_uv=False)[:16] ** 2
        k = len(squares)
        assert squares == pytest.approx(want[:k], rel=1e-12) and (want[k:] < 1e-25 * want[0]).all()
        assert total == pytest.approx((m ** 2).sum(), rel=1e-12)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-8
        assert np.abs(m.T @ (m @ vectors) - vectors * squares).max() < 1e-12 * want[0] * 40
    a, b, v = bidiagonalise(cases[0])
    full = np.diag(a) + np.diag(b, 1)
    assert np.allclose(v @ full.T @ full @ v.T, cases[0].T @ cases[0])
    assert len(eigenvalues(np.zeros(0), np.zeros(0))) == 0 and right_singular(np.zeros((4, 3)), 2)[0].size == 0


def test_graded_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(12), 10.0 ** -(np.arange(11) + 0.5)
    got = eigenvalues(a * a, b * b)                                 # their product is the squared determinant
    assert math.prod(got) == pytest.approx(math.prod(float(Fraction(x) ** 2) for x in a), rel=1e-11)


def test_query_equals_a_full_eigensolver(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    report = QUERIES["op13_whitening"](spark, sf).collect()
    assert len(report) == 16 * len(rows)
    check(report, rows)
