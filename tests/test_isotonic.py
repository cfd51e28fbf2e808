"""Rising fits: slices give the same as one pass, and both the max-min formula."""

import numpy as np
import pytest

from flowmine.operators import isotonic


def max_min(pos, n):
    """Value at i: largest over starts up to i of the smallest mean over ends from i."""
    p, w = np.r_[0, np.cumsum(pos)], np.r_[0, np.cumsum(n)]
    k = len(pos)
    return [max(min((p[b + 1] - p[a]) / (w[b + 1] - w[a]) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


def table(spark, groups, seed=3):
    g = np.random.default_rng(seed)
    rows = []
    for c, size in enumerate(groups):
        for x in np.sort(g.random(size)):
            n = int(g.integers(1, 6))
            pos = int(g.binomial(n, x * x if c % 2 else 0.4))
            rows.append((c, float(x), pos, n - pos))
    return rows, spark.createDataFrame(rows, "cls int, score double, pos long, neg long")


def told(df):
    return sorted((r["cls"], r["low"], r["high"], r["pos"], r["n"]) for r in df.collect())


def test_pooling_is_the_max_min_formula():
    g = np.random.default_rng(1)
    for _ in range(60):
        n = g.integers(1, 4, g.integers(1, 25)).tolist()
        pos = [int(g.integers(0, x + 1)) for x in n]
        fit = [p / m for a, b, p, m in isotonic.pool_adjacent(pos, n) for _ in range(a, b + 1)]
        assert fit == pytest.approx(max_min(pos, n), abs=1e-12)
    assert isotonic.pool_adjacent([], []) == []
    # Equal rates are one block.
    assert isotonic.pool_adjacent([1, 2, 1], [3, 6, 2]) == [(0, 1, 3, 9), (2, 2, 1, 2)]


def test_slices_of_a_hot_class_merge_to_one_fit(spark, monkeypatch):
    rows, counts = table(spark, [9000, 40, 1, 3000])
    whole = told(isotonic.rising_blocks(counts, ["cls"]))
    widths = []
    monkeypatch.setattr(isotonic, "FAN_IN", 3)

    def stage(df):
        from flowmine.session import cut_lineage
        out = cut_lineage(df)
        widths.append(out.select("cls", "part").distinct().filter("cls = 0").count())
        return out

    assert told(isotonic.rising_blocks(counts, ["cls"], rows=300, stage=stage)) == whole
    # Slices of bounded size, merged level by level.
    assert widths[0] > 12 and widths[-1] == 1 and all(b <= a / 3 + 1 for a, b in zip(widths, widths[1:])) and len(widths) >= 4
    for c in range(4):
        mine = [r for r in whole if r[0] == c]
        one = [r for r in rows if r[0] == c]
        assert sum(r[4] for r in mine) == sum(r[2] + r[3] for r in one)
        assert all(a[2] < b[1] and a[3] / a[4] < b[3] / b[4] for a, b in zip(mine, mine[1:]))
    small = [r for r in rows if r[0] == 1]
    fit = max_min([r[2] for r in small], [r[2] + r[3] for r in small])
    for r, v in zip(small, fit):
        assert [b[3] / b[4] for b in whole if b[0] == 1 and b[1] <= r[1] <= b[2]] == pytest.approx([v])


def test_unusual_scores(spark):
    schema = "cls int, score double, pos long, neg long"
    assert isotonic.rising_blocks(spark.createDataFrame([], schema), ["cls"]).count() == 0
    odd = spark.createDataFrame([(0, None, 1, 1), (0, float("nan"), 1, 1), (0, 0.5, 0, 0), (0, 0.7, 2, 1)], schema)
    assert told(isotonic.rising_blocks(odd, ["cls"])) == [(0, 0.7, 0.7, 2, 3)]
    # Everything alike in two groups far over the slice bound of one row.
    flat = spark.createDataFrame([(c, i / 100, 1, 1) for c in (0, 1) for i in range(60)], schema)
    assert told(isotonic.rising_blocks(flat, ["cls"], rows=5)) == [(c, 0.0, 0.59, 60, 120) for c in (0, 1)]
