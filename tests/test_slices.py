"""Slices by row count: bounded wherever a hot group's rows lie, and the same results as plain windows."""

import math

import pytest
from pyspark.sql import functions as F

from flowmine.operators import graph, windows
from flowmine.operators.sessions import sessionize
from flowmine.operators.slices import sliced, splitters_before
from flowmine.settings import SessionSettings


def busy(spark, n=30_000):
    """Nine tenths of all rows in one key and one second, many with the same time."""
    i = F.col("id")
    hot = i % 10 != 0
    return spark.range(n).select(
        i.alias("row_id"), F.when(hot, "hot").otherwise(F.concat(F.lit("k"), (i % 70).cast("string"))).alias("key"),
        F.timestamp_micros(F.when(hot, F.floor(F.pmod(F.xxhash64(i), F.lit(1_000_000)) / 3000) * 3000)
                           .otherwise(i * 7_000_000)).alias("ts"), (i % 5).cast("double").alias("x"))


def test_no_slice_of_a_hot_key_is_over_its_bound(spark):
    d = busy(spark).withColumn("us", F.unix_micros("ts"))
    for rows in (1000, 4000):
        out, block = sliced(d, ["key"], ["us", "row_id"], rows)
        sizes = {(r["key"], r[block]): r["n"] for r in out.groupBy("key", block).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert max(sizes.values()) <= 2 * rows and sum(sizes.values()) == 30_000
        hot = [b for k, b in sizes if k == "hot"]
        assert len(hot) >= 27_000 // rows // 2 and {b for k, b in sizes if k != "hot"} == {0}
        bounds = out.groupBy(block).agg(F.min(F.struct("us", "row_id")).alias("a"), F.max(F.struct("us", "row_id")).alias("b")) \
            .join(out.filter("key = 'hot'").select(block).distinct(), block, "left_semi")
        got = sorted((r[block], tuple(r["a"]), tuple(r["b"])) for r in out.filter("key = 'hot'").groupBy(block).agg(
            F.min(F.struct("us", "row_id")).alias("a"), F.max(F.struct("us", "row_id")).alias("b")).collect())
        assert bounds.count() == len(got) and all(x[2] < y[1] for x, y in zip(got, got[1:]))
    same, block = sliced(d, ["key"], ["us", "row_id"])
    assert block is None and same is d


def test_binary_search(spark):
    for splits in ([], [5], [1, 3, 3, 9], list(range(0, 100, 7))):
        d = spark.range(-2, 103).select("id", F.array(*[F.lit(s) for s in splits]).cast("array<bigint>").alias("s"))
        got = {r["id"]: r["n"] for r in d.select("id", splitters_before(F.col("s"), F.col("id")).alias("n")).collect()}
        assert got == {i: sum(s <= i for s in splits) for i in got}
    assert spark.range(1).select(splitters_before(F.lit(None).cast("array<bigint>"), F.col("id"))).first()[0] == 0


def test_operators_give_the_same_with_and_without_slices(spark):
    d = busy(spark, 6000)

    def told(df):
        return sorted(map(str, df.collect()))

    for settings in (dict(timeout_s=0.001, max_flows=7), dict(timeout_s=60, max_flows=7, cap_mode="singleton"), dict(timeout_s=0.004, max_flows=0)):
        plain = sessionize(d, "key", "ts", ["row_id"], SessionSettings(**settings))
        cut = sessionize(d, "key", "ts", ["row_id"], SessionSettings(slice_rows=500, **settings))
        assert told(plain.select("row_id", "session_id")) == told(cut.select("row_id", "session_id"))
    for n in (300, math.inf):
        rows = 10 ** 9 if n is math.inf else n
        w = told(windows.session_windows(d, "key", "ts", ["row_id"], ["x"], 5, slice_rows=rows).select("row_id", "window"))
        p = told(windows.previous_state(d, "key", "ts", ["row_id"], F.col("x"), slice_rows=rows).select("row_id", "prev_state"))
        named = d.withColumn("s", F.concat("key", F.lit("#"), F.floor(F.col("row_id") / 20).cast("string")))
        e = told(graph.session_edges(named, "s", "ts", "key", 4, 1.0, slice_rows=rows if rows > 300 else 50))
        if rows == 300:
            first = w, p, e
    assert first == (w, p, e) and len(e) > 500


def test_neighbours_cross_the_borders_of_slices(spark):
    from flowmine.operators.blocks import add_neighbours

    d = spark.range(400).select("id", F.lit("g").alias("g"), F.floor(F.col("id") / 7).alias("x"))
    d = d.withColumn("b", F.floor(F.col("id") / 60) * 10 + F.when(F.col("id") % 60 == 0, 0).otherwise(1))    # slices of one row too
    plain = add_neighbours(d, ["g"], ["x", "id"], None, F.col("id"), 3)
    cut = add_neighbours(d, ["g"], ["x", "id"], "b", F.col("id"), 3)
    want = {i: ([j for j in range(i - 3, i) if j >= 0], [j for j in range(i + 1, i + 4) if j < 400]) for i in range(400)}
    for df in (plain, cut):
        assert {r["id"]: (r["before"], r["after"]) for r in df.collect()} == want


def test_information_is_the_same_when_values_are_sliced(spark):
    from flowmine.operators.rankers import mutual_information

    i = F.col("id")
    d = spark.range(2000).select(i.alias("r"), F.when(i % 20 == 0, 1).when(i == 7, 2).otherwise(0).alias("y"),
                                 (F.pmod(F.xxhash64(i), F.lit(997)) / 997.0 + F.when(i % 20 == 0, 0.3).otherwise(0.0)).alias("a"),
                                 F.when(i % 3 == 0, 0.25).otherwise(0.5).cast("double").alias("b"))
    plain = {r["feature"]: r["score"] for r in mutual_information(d, ["a", "b"], "y", "r").collect()}
    cut = {r["feature"]: r["score"] for r in mutual_information(d, ["a", "b"], "y", "r", slice_rows=150).collect()}
    assert plain == pytest.approx(cut, abs=1e-12) and plain["a"] > 0


def test_nearest_rows_of_one_dense_cell_in_small_tiles(spark):
    import numpy as np

    from flowmine.operators import neighbors

    rng = np.random.default_rng(3)
    far = rng.normal(size=(240, 3)) * 50
    dense = rng.normal(size=(100, 3)) * 0.01 + 500
    same = np.repeat([[9.0, 9.0, 9.0]], 60, axis=0)
    x = np.concatenate([far, dense, same])
    d = spark.createDataFrame([(f"{i:04d}", r.tolist(), i % 3) for i, r in enumerate(x)], "id string, x array<double>, y int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    want = {f"{i:04d}": [(pytest.approx(dist[i, j]), f"{j:04d}") for j in np.argsort(dist[i], kind="stable")[:4]] for i in range(len(x))}
    for rows in (15, 10_000):
        got = {r["id"]: [(n["dist"], n["other"]) for n in r["neighbours"]]
               for r in neighbors.nearest(d, 4, "id", "x", "y", block_rows=rows).collect()}
        assert got == want
    got = {r["id"]: [n["other"] for n in r["neighbours"]]
           for r in neighbors.nearest(d, 2, "id", "x", "y", within="y", block_rows=20).collect()}
    for i in range(len(x)):
        own = [j for j in np.argsort(dist[i], kind="stable") if j % 3 == i % 3][:2]
        assert got[f"{i:04d}"] == [f"{j:04d}" for j in own]


def test_rows_of_one_vector_ask_once(spark, monkeypatch):
    from flowmine.operators import neighbors

    staged = []

    def told(df):
        staged.append(df.count())
        return cut_lineage(df)
    cut_lineage = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", told)
    d = spark.range(600).select(F.format_string("%04d", "id").alias("id"), (F.col("id") % 3).cast("int").alias("y"), F.array(
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0), (F.col("id") % 200 / 150).cast("int").cast("double")).alias("x"))
    got = {r["id"]: [n["other"] for n in r["neighbours"]] for r in neighbors.nearest(d, 2, "id", "x", "y", block_rows=10).collect()}
    for part in ([i for i in range(600) if i % 200 < 150], [i for i in range(600) if i % 200 >= 150]):
        for i in part:
            assert got[f"{i:04d}"] == [f"{j:04d}" for j in part if j != i][:2]
    assert max(staged) == 600


def test_information_works_on_counted_values(spark, monkeypatch):
    from flowmine.operators import rankers

    staged = []

    def told(df):
        staged.append(df.count())
        return cut_lineage(df)
    cut_lineage = rankers.cut_lineage
    monkeypatch.setattr(rankers, "cut_lineage", told)
    d = spark.range(3000).select(F.col("id").alias("r"), F.floor(F.col("id") / 300).alias("y"), F.floor(F.col("id") / 3).alias("a"))
    # Three rows a value, the next value of the class one away: ten classes are told apart wholly.
    assert rankers.mutual_information(d, ["a"], "y", "r").first()["score"] == pytest.approx(2.3041, abs=1e-3)
    assert max(staged) <= 3000


def test_rank_correlation_by_counted_values(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from flowmine.operators import redundancy

    monkeypatch.setattr(redundancy, "RANK_ROWS", 40)
    g = np.random.default_rng(5)
    p = pd.DataFrame({"a": np.round(g.random(300), 1), "b": g.random(300), "c": 2.0})
    p["d"] = p["b"] * 3 - p["a"]
    m = redundancy.rank_correlation(spark.createDataFrame(p), list("abcd"), slice_rows=50)
    want = np.nan_to_num(p.rank().corr().to_numpy())
    np.fill_diagonal(want, 1.0)
    assert np.allclose(m, want, atol=1e-12)
    with pytest.raises(ValueError):
        redundancy.rank_correlation(spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double"), ["a", "b"])
