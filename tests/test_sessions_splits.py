from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowmine.operators import guards, sampling, splits
from flowmine.operators.sessions import communication_key, sessionize
from flowmine.settings import SessionSettings, SplitSettings


def flows(spark, data):
    return spark.createDataFrame(data, "row_id int, key string, t string, label string").withColumn(
        "ts", F.col("t").cast("timestamp"))


def test_key_is_symmetric(spark):
    d = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 40000, 80, 6), ("10.0.0.2", "10.0.0.1", 80, 40000, 6)],
                              "a string, b string, p int, q int, proto int")
    for mode in ("five_tuple", "service_port", "host_pair"):
        k = d.select(communication_key(mode, *[F.col(c) for c in ("a", "b", "p", "q", "proto")]).alias("k"))
        assert k.distinct().count() == 1


def test_bad_ports_and_absent_columns(spark):
    d = spark.createDataFrame([("a", "b", "x", "80")], "a string, b string, p string, q string")
    k = d.select(communication_key("service_port", F.col("a"), F.col("b"), F.col("p"), F.col("q")).alias("k"),
                 communication_key("service_port", F.col("a"), F.col("b")).alias("n")).first()
    assert k["k"] == "a|b|-1|0" and k["n"] == "a|b|0|0"


def test_idle_timeout(spark):
    d = flows(spark, [(1, "k", "2020-01-01 09:00:00", "x"), (2, "k", "2020-01-01 09:00:30", "x"),
                      (3, "k", "2020-01-01 10:00:00", "x")])
    s = sessionize(d, "key", "ts", ["row_id"], SessionSettings(timeout_s=60, max_flows=0))
    assert [r[1] for r in rows(s.select("row_id", "session_id"), "row_id")] == ["k#1", "k#1", "k#2"]


def reference_sessions(times, timeout, cap, mode):
    out, n, pos, last = [], 0, 0, None
    for t in times:
        if last is None or t - last > timeout:
            n, pos = n + 1, 0
        else:
            pos += 1
            if (mode == "block" and pos % cap == 0) or (mode == "singleton" and pos >= cap):
                n += 1
        out.append(n)
        last = t
    return out


@pytest.mark.parametrize("mode", ["block", "singleton"])
@pytest.mark.parametrize("slice_rows", [2, 7, 100000])
def test_cap_matches_a_plain_loop_for_any_slice(spark, mode, slice_rows):
    times = [0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 24, 25, 26, 27, 50, 51, 90, 91, 92]
    d = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "row_id int, key string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    s = sessionize(d, "key", "ts", ["row_id"], SessionSettings(timeout_s=5, max_flows=3, cap_mode=mode, slice_rows=slice_rows))
    got = [int(r[1].split("#")[1]) for r in rows(s.select("row_id", "session_id"), "row_id")]
    assert got == reference_sessions(times, 5, 3, mode)


def split_input(spark, n=120):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 3).cast("string")).alias("session_id"),
        F.when(F.floor(F.col("id") / 3) % 4 == 0, "B").otherwise("A").alias("label"))


ARGS = dict(session="session_id", ts="ts", label="label", row_id="row_id", classes=["A", "B"])


@pytest.mark.parametrize("strategy", ["time_blocked", "stratified_session", "stratified_flow"])
def test_partitions_cover_all_rows_and_pass_guards(spark, strategy):
    d = split_input(spark)
    s = splits.make_split(d, strategy, **ARGS)
    assert s.count() == 120 and s.select("row_id").distinct().count() == 120
    assert {r[0] for r in s.select("split").distinct().collect()} >= {"train", "val", "test"}
    guards.enforce(guards.split_guards(s, "row_id", "session_id", "ts", strategy))


def test_tiny_class_is_cut_by_rows(spark):
    d = split_input(spark).withColumn("label", F.when(F.col("row_id") >= 100, "B").otherwise("A"))
    s = splits.time_blocked_split(d.withColumn("session_id", F.when(F.col("label") == "B", "one").otherwise(F.col("session_id"))),
                                  settings=SplitSettings(gap_frac=0.0), **ARGS)
    b = s.filter("label = 'B'")
    assert {r[0] for r in b.select("split").distinct().collect()} == {"train", "val", "test"}
    assert b.filter("not exempt").count() == 0
    guards.enforce(guards.split_guards(s, "row_id", "session_id", "ts"))


def test_family_is_absent_from_train(spark):
    s = splits.make_split(split_input(spark), "leave_family_out", held_out="B", **ARGS)
    assert s.filter("label = 'B' and split <> 'test'").count() == 0
    with pytest.raises(ValueError):
        splits.make_split(split_input(spark).filter("label = 'A'"), "leave_family_out", held_out="B", **ARGS)


def test_split_does_not_depend_on_partitions(spark):
    d = split_input(spark)
    one = rows(splits.make_split(d.coalesce(1), "stratified_session", **ARGS).select("row_id", "split"), "row_id")
    many = rows(splits.make_split(d.repartition(7), "stratified_session", **ARGS).select("row_id", "split"), "row_id")
    assert one == many


def bad(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_guards_fire(spark):
    d = bad(spark, [(1, "train"), (1, "test")], "row_id int, split string")
    assert guards.disjoint(d, "row_id").first()["n"] == 1
    d = bad(spark, [("s1", "train", False), ("s1", "val", False), ("s2", "train", True), ("s2", "test", True)],
            "session_id string, split string, exempt boolean")
    assert rows(guards.sessions_whole(d, "session_id")) == [("sessions_whole", 1, "s1")]
    d = bad(spark, [("2020-01-02", "train", "A"), ("2020-01-01", "test", "A")], "t string, split string, assign_group string")
    assert guards.time_ordered(d.withColumn("ts", F.col("t").cast("timestamp")), "ts").count() == 1
    d = bad(spark, [(1, [0.5, 0.4]), (2, [1.1, -0.1]), (3, [0.5, 0.5])], "row_id int, p array<double>")
    assert guards.probabilities_valid(d, "p", "row_id").first()["n"] == 2
    assert guards.weights_sum_to_one(d, "p", "row_id").first()["n"] == 2
    with pytest.raises(guards.LeakageError):
        guards.enforce(guards.probabilities_valid(d, "p", "row_id"))
    with pytest.raises(guards.LeakageError):
        guards.same_features(["a", "b"], ["b", "a"])
    two, three = spark.range(2), spark.range(3)
    assert guards.not_resampled(two, three).count() == 1 and guards.not_resampled(two, two).count() == 0


def test_stratified_sample_keeps_rare_classes(spark):
    d = spark.range(5053).select("id", F.when(F.col("id") < 5000, 0).when(F.col("id") < 5050, 1).otherwise(2).alias("y"))
    s = sampling.stratified_sample(d, "y", 500, 42, ["id"], 3)
    counts = dict(rows(s.groupBy("y").count()))
    assert counts[2] == 3 and set(counts) == {0, 1, 2} and sum(counts.values()) <= 500
    assert sampling.sample_rows(d, 100, 1, "id").count() == 100
    assert sampling.sample_rows(d, 10**6, 1, "id").count() == 5053
    assert replace(SplitSettings(), seed=1).seed == 1
