import numpy as np
import pytest
from pyspark.sql import types as T

from flowmine.llm import vectors as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def slow(rows, threshold=0.95):
    ok = [k for k, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in ok}
    near = {k: {j for j in ok if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= threshold} for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((i, len(near.get(k, ())), c, i is not None and i == c))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 0) for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in V.near_duplicate_vectors(df, **options).collect()), key=str)


def clustered(rng, n, d, groups):
    rows = [(k, rng.normal(size=d).astype(np.float32).tolist()) for k in range(n)]
    for g in range(groups):
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(2, 25))):
            rows.append((len(rows), (centre + rng.normal(size=d) * 0.15).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[-1][1]) for k in range(9)]
    return rows


def test_many_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    for d in (8, 64):
        rows = clustered(rng, 400, d, 8)
        want = slow(rows)
        assert run(spark, rows, cell_rows=40, block=20) == want
        assert run(spark, rows) == want                                        # one cell


def test_default_margin_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = clustered(rng, 400, 64, 8)
    assert run(spark, rows, cell_rows=40) == slow(rows)
    for span in (4, 6):                                                       # few of 64 dimensions
        basis = np.linalg.qr(rng.normal(size=(64, span)))[0]
        rows = [(k, (basis @ rng.normal(size=span)).astype(np.float32).tolist()) for k in range(1200)]
        want = slow(rows)
        assert run(spark, rows, cell_rows=40, block=50) == want
        assert run(spark, rows, cell_rows=40) == want
        assert run(spark, rows) == want


def test_margin_is_never_less(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0, 0.0])], spill=0.5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (8, [2.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.1]),
            (11, [-1.0, 0.0]), (None, [0.0, -1.0])]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:3]) == slow(rows[:3])
