import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowmine.operators import clean, fitted
from flowmine.operators.quantiles import exact_quantiles
from flowmine.plans.run import prepare
from flowmine.settings import Settings
from flowmine.sources import files

HEAD = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Fwd Len, Fwd Len,Flow Bytes/s, Label"


def write_files(folder):
    os.makedirs(folder / "sub", exist_ok=True)

    def line(i, ts, label, rate="1.5"):
        return f"F{i},10.0.0.{i % 3},{40000 + i},10.0.0.9,80,6,{ts},{i},{i * 2},{i * 2},{rate},{label}"
    mon = [line(i, f"03/07/2017 09:00:{i:02d}", "BENIGN") for i in range(10)]
    mon.insert(4, HEAD)
    fri = [line(i, f"07/07/2017 03:00:{i:02d}", "Web Attack \x96 XSS" if i % 2 else "DDoS", "Infinity" if i == 3 else "2") for i in range(10)]
    (folder / "sub" / "Friday-Afternoon.csv").write_bytes(("\n".join([HEAD, *fri]) + "\n").encode("latin-1"))
    (folder / "Monday-WorkingHours.csv").write_bytes(("\n".join([HEAD, *mon, mon[0]]) + "\n").encode("latin-1"))


def test_discovery_order_and_missing(spark, tmp_path):
    write_files(tmp_path)
    names = [os.path.basename(p) for p in files.discover_files(spark, str(tmp_path))]
    assert names == ["Monday-WorkingHours.csv", "Friday-Afternoon.csv"]
    with pytest.raises(FileNotFoundError):
        files.discover_files(spark, str(tmp_path), "*.none")


def test_header_names():
    assert files.header_names([" A  b", "x", "x", "A b"]) == ["A b", "x", "x.1", None]


def test_read_and_prepare(spark, tmp_path):
    write_files(tmp_path)
    raw = files.read_csv_folder(spark, str(tmp_path))
    assert raw.count() == 22 and "Fwd Len.1" in raw.columns
    assert raw.filter("source_file like 'Friday%'").agg(F.max("row_in_source")).first()[0] == 9
    df, features, _ = prepare(spark, str(tmp_path), Settings(expect_min_rows=5))
    # One stray header is dropped, one copied row is folded.
    assert df.count() == 20
    assert dict(rows(df.groupBy("label_group").count())) == {"Benign": 10, "DDoS": 5, "Web Attack": 5}
    assert df.filter("source_file like 'Friday%'").select(F.min(F.hour("ts"))).first()[0] == 15
    assert df.filter("`Flow Bytes/s` is null").count() == 1
    assert "Flow Duration" in features and "Destination Port" not in features and "Flow ID" not in features
    with pytest.raises(ValueError):
        prepare(spark, str(tmp_path), Settings(expect_min_rows=1000))


def test_no_row_is_lost_without_clock_or_with_am_pm(spark, tmp_path):
    def lines(stamp):
        return [f"F{i},10.0.0.1,{40000 + i},10.0.0.9,80,6,{stamp(i)},{i},{i * 2},{i * 3},1.5,BENIGN" for i in range(5)]
    bare = HEAD.replace(" Timestamp,", "")
    (tmp_path / "a").mkdir()
    (tmp_path / "Monday-WorkingHours.csv").write_text("\n".join([HEAD, *lines(lambda i: f"03/07/2017 10:00:{i:02d}")]))
    (tmp_path / "a" / "Monday-WorkingHours.csv").write_text(
        "\n".join([HEAD, *lines(lambda i: f"03/07/2017 09:00:{i:02d} {'PM' if i % 2 else 'AM'}" if i else "soon")]))
    (tmp_path / "Tuesday-Afternoon.csv").write_text(
        "\n".join([bare, *[x.replace(",#,", ",") for x in lines(lambda i: "#")]]))
    df, _, _ = prepare(spark, str(tmp_path), Settings(expect_min_rows=5))
    got = df.select("source_path", "row_in_source", F.date_format("ts", "MM-dd HH:mm:ss").alias("t"), "session_id").collect()
    assert len(got) == 15 and all(r["session_id"] for r in got)
    times = {(r["source_path"].split(tmp_path.name)[1], r["row_in_source"]): r["t"] for r in got}
    assert times[("/a/Monday-WorkingHours.csv", 1)] == "07-03 21:00:01" and times[("/a/Monday-WorkingHours.csv", 2)] == "07-03 09:00:02"
    assert times[("/a/Monday-WorkingHours.csv", 0)] is None
    assert times[("/Tuesday-Afternoon.csv", 4)] == "07-04 21:00:04"


def test_rows_without_time_or_label_stay(spark):
    from flowmine.operators.sessions import sessionize
    from flowmine.operators.splits import stratified_flow_split, stratified_session_split
    from flowmine.settings import SessionSettings
    rows_in = [(i, "k" if i < 40 else None, i * 100 if i % 4 else None, "a" if i % 3 else None) for i in range(60)]
    d = spark.createDataFrame(rows_in, "id int, key string, s long, label string").withColumn("ts", F.timestamp_seconds("s"))
    out = sessionize(d, "key", "ts", ["id"], SessionSettings(timeout_s=150.0, max_flows=0)).collect()
    assert len(out) == 60 and all(r["session_id"] for r in out)
    last = [r["session_id"] for r in out if r["key"] == "k" and r["s"] is None]
    assert set(last) == {max((r["session_id"] for r in out if r["key"] == "k" and r["s"]), key=lambda x: int(x.split("#")[1]))}
    split = stratified_flow_split(d, "id", "label")
    assert split.count() == 60 and split.filter("label is null").select("split").distinct().count() > 1
    by_session = d.withColumn("session", F.floor(F.col("id") / 3).cast("string"))
    assert stratified_session_split(by_session.withColumn("label", F.when(F.col("id") > 30, F.col("label"))),
                                    "session", "ts", "label", ["a"]).count() == 60


def test_labels(spark):
    d = spark.createDataFrame([("BENIGN",), ("DDoS",), (None,), ("   ",), ("Label",), ("PortScan",)], "Label string")
    assert clean.group_labels(d, "Label").count() == 3
    with pytest.raises(ValueError):
        clean.group_labels(d, "Label", drop_unlabelled=False)
    with pytest.raises(ValueError, match="Martian"):
        clean.group_labels(spark.createDataFrame([("Martian Attack",)], "Label string"), "Label")


def test_unseen_category_and_constant(spark):
    train = spark.createDataFrame([(6, 1.0, 5.0), (6, None, 5.0), (17, 3.0, 5.0)], "Protocol int, a double, b double")
    p = fitted.Preprocessor(["a", "b"], ["Protocol"]).fit(train)
    out = p.transform(spark.createDataFrame([(99, 9.0, 7.0)], "Protocol int, a double, b double"))
    assert out.columns == ["a", "b", "Protocol=6", "Protocol=17"] and tuple(out.first()) == (1.0, 0.0, 0.0, 0.0)
    assert p.medians_["a"] == 2.0
    with pytest.raises(RuntimeError):
        fitted.Preprocessor(["a"]).transform(train)


def test_quantiles_by_brackets_equal_builtin(spark):
    d = spark.range(20000).select((F.pmod(F.xxhash64("id"), F.lit(9973)) / 7.0).alias("a"),
                                  F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("b"))
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    want = exact_quantiles(d, ["a", "b"], probs)
    got = exact_quantiles(d, ["a", "b"], probs, small_rows=10, bracket_rows=50)
    for c in ("a", "b"):
        assert got[c] == pytest.approx(want[c])


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan"), [1.0]), (2, 2.0, [2.0])], "i int, x double, a array<double>")
    files.write_report(d, str(tmp_path / "r"))
    assert rows(spark.read.json(str(tmp_path / "r")).select("i", "x"), "i") == [(1, None), (2, 2.0)]
    files.write_table(d, str(tmp_path / "t"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2
    calls = []

    def build():
        calls.append(1)
        return d
    key = files.signature(mode="x")
    for _ in range(2):
        assert files.parquet_stage(spark, str(tmp_path), "stage", key, build, {"n": 2}).count() == 2
    assert len(calls) == 1
    assert files.stage_meta(spark, str(tmp_path), "stage", key) == {"n": 2}
    # A writer that fails leaves no stage; nor does one that comes second change it.
    with pytest.raises(ZeroDivisionError):
        files.parquet_stage(spark, str(tmp_path), "other", key, lambda: d, lambda: {"n": 1 // 0})
    assert files.parquet_stage(spark, str(tmp_path), "other", key, lambda: d.limit(1), {}).count() == 1

    def late():
        files.parquet_stage(spark, str(tmp_path), "raced", key, lambda: d.limit(1), {})
        return d
    assert files.parquet_stage(spark, str(tmp_path), "raced", key, late, {}).count() == 1
    many = spark.range(500).select((F.lit(500) - F.col("id")).alias("row_no"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_table(many.repartition(7), str(tmp_path / "o"), ["row_no"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(p for p in os.listdir(tmp_path / "o") if p.startswith("part-"))
    text = [x for p in parts for x in (tmp_path / "o" / p).read_text().split("\n")[1:] if x]
    assert [int(x) for x in text] == list(range(1, 501)) and len(parts) > 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_without_a_shuffle(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, n in (("a.csv", 3000), ("x/a.csv", 1700), ("b.csv", 1)):
        (tmp_path / name).write_text("\n".join(["k,v" if name != "b.csv" else "v,k", *[f"{i},{'z' * (i % 40)}" for i in range(n)]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")     # many blocks a file, and files that share a task
    try:
        staged = []

        def stage(df):
            from flowmine.session import cut_lineage
            staged.append(plan_of(df))
            return cut_lineage(df)
        raw = files.read_csv_folder(spark, str(tmp_path), stage=stage)
        assert len(staged) == 1 and "Exchange" not in staged[0]
        text = plan_of(raw)
        assert "BroadcastExchange" in text and "hashpartitioning" not in text and "SortMergeJoin" not in text
        got = raw.select(F.element_at(F.split("source_path", str(tmp_path)), -1).alias("f"), "row_in_source", "k", "v").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4701
    assert all(int(r["k"] if r["f"] != "/b.csv" else r["v"]) == r["row_in_source"] for r in got)


def test_branches_share_one_prepared_table(spark, tmp_path, monkeypatch):
    from flowmine.plans import run
    source, base = tmp_path / "in", tmp_path / "stages"
    source.mkdir()
    write_files(source)
    reads = []
    plain = files.read_csv_folder
    monkeypatch.setattr(files, "read_csv_folder", lambda *a, **k: reads.append(1) or plain(*a, **k))
    one = Settings(expect_min_rows=5)
    branches = [one, one.with_(imbalance=dict(mode="smote_enn")), one.with_(split=dict(strategy="stratified_flow"), seed=7)]
    tables = [prepare(spark, str(source), s, base=str(base)) for s in branches]
    assert len(reads) == 1 and len({tuple(t[1]) for t in tables}) == 1
    bare, features, _ = prepare(spark, str(source), one)
    assert features == tables[2][1] and rows(bare.select("row_id", "session_id"), "row_id") == \
        rows(tables[2][0].select("row_id", "session_id"), "row_id")
    told = run.prepared_reports(spark, str(source), one, str(base))
    assert told["labels"].first().asDict() == {"n_rows": 22, "unlabelled": 1, "unmapped": 0}
    assert sum(r["records"] for r in told["classes"].collect()) == 21
    cleaning = told["cleaning"].first()
    assert (cleaning["rows_in"], cleaning["rows_out"], cleaning["duplicates"], cleaning["inf_cells"]) == (21, 20, 1, 1)
    assert told["repair"].filter("column = 'Flow Bytes/s' AND numeric").count() == 2
    # What cleaning reads changes the key: settings of sessions, and the files.
    assert len(reads) == 2
    prepare(spark, str(source), one.with_(session=dict(timeout_s=1.0)), base=str(base))
    assert len(reads) == 3
    with open(source / "Monday-WorkingHours.csv", "a") as f:
        f.write("F99,10.0.0.1,40099,10.0.0.9,80,6,03/07/2017 09:30:00,1,2,2,1.5,BENIGN\n")
    assert prepare(spark, str(source), one, base=str(base))[0].count() == 21 and len(reads) == 4


def test_target_port_is_a_feature_on_request(spark, tmp_path):
    write_files(tmp_path)
    _, features, _ = prepare(spark, str(tmp_path), Settings(expect_min_rows=5, use_dst_port=True))
    assert "Destination Port" in features


def test_global_order_over_slices(spark):
    d = spark.range(4000).select(
        F.when(F.col("id") % 13 > 0, F.timestamp_seconds(F.floor(F.col("id") / 700))).alias("ts"),
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("source"), (F.col("id") * 7919 % 4001).alias("row"))
    want = {tuple(r): i + 1 for i, r in enumerate(d.orderBy(*clean.order_key("ts", "source", "row")).collect())}
    for size in (100, 10 ** 6):
        got = clean.number_in_order(d, "ts", "source", "row", rows=size).collect()
        assert {tuple(r)[:3]: r["row_no"] for r in got} == want
    assert clean.number_in_order(d.limit(0), "ts", "source", "row").count() == 0


def test_wide_categories(spark):
    n = 100_000
    d = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"), (F.col("id") % 2).cast("double").alias("a"))
    p = fitted.Preprocessor(["a"], ["c"]).fit(d)
    assert p.output_columns == ["a"] and p.vector_columns == ["c=*"] and p.positions_["c"][1] == n
    probe = spark.createDataFrame([("c0", 1.0), ("c99999", 0.0), ("none", 0.0), (None, 1.0)], "c string, a double")
    out = {r["c"]: r["c=*"] for r in p.transform(probe, ["c"]).collect()}
    assert all(v.size == n for v in out.values())
    assert out["c0"].indices.tolist() == [0] and out["c99999"].indices.tolist() == [n - 1] and out["c0"].values.tolist() == [1.0]
    assert out["none"].indices.tolist() == out[None].indices.tolist() == []
    seen = p.transform(d).select(F.get(F.unwrap_udt(F.col("`c=*`"))["indices"], F.lit(0)).alias("i")).agg(
        F.count_distinct("i"), F.max("i")).first()
    assert tuple(seen) == (n, n - 1)
    at_limit = fitted.Preprocessor([], ["c"], wide=3).fit(spark.createDataFrame([("b",), ("a",), ("c",)], "c string"))
    assert at_limit.output_columns == ["c=a", "c=b", "c=c"] and at_limit.vector_columns == []


def test_many_ranges_of_a_global_order_put_no_splitters_on_rows(spark, monkeypatch):
    monkeypatch.setattr(clean, "MAX_RANGES", 7)
    d = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.timestamp_seconds(F.col("id") % 40)).alias("ts"),
                                F.concat(F.lit("f"), F.col("id") % 3).alias("source"), F.col("id").alias("row"))
    out = clean.number_in_order(d, "ts", "source", "row", rows=2)
    assert "splits" not in out._jdf.queryExecution().toString()
    got = [r["row"] for r in out.orderBy("row_no").collect()]
    assert got == sorted(range(500), key=lambda i: (i % 9 == 0, i % 40 if i % 9 else 0, i % 3, i))


def test_quantiles_of_few_values_are_counted(spark, monkeypatch):
    d = spark.range(5000).select((F.col("id") % 50 / 4.0).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("b"))
    probs = [0.0, 0.1, 0.505, 0.99, 1.0]
    want = exact_quantiles(d, ["a", "b"], probs)

    def refuse(*_):
        raise AssertionError("brackets are not needed")
    monkeypatch.setattr(F, "percentile_approx", refuse)
    got = exact_quantiles(d, ["a", "b"], probs, small_rows=10, bracket_rows=4500)
    assert all(got[c] == pytest.approx(want[c]) for c in ("a", "b"))
    with pytest.raises(AssertionError):
        exact_quantiles(d, ["a", "b"], probs, small_rows=10, bracket_rows=100)


def test_copies_keep_the_sign_of_their_zero(spark):
    d = spark.createDataFrame([(1, -0.0, "b"), (1, -0.0, "a"), (2, 0.0, "a"), (3, None, "a"), (4, -0.0, "b"), (4, 0.0, "a")],
                              "k int, v double, source string")
    out = clean.drop_copies(d, ["k", "v"], ["source"]).withColumn("v", F.col("v").cast("string"))
    assert rows(out, "k") == [(1, "-0.0", "a"), (2, "0.0", "a"), (3, None, "a"), (4, "0.0", "a")]
    floats = clean.drop_copies(d.withColumn("v", F.col("v").cast("float")), ["k", "v"], ["source"])
    assert floats.schema["v"].dataType.simpleString() == "float"
    assert rows(floats.select("k", F.col("v").cast("string")), "k")[0] == (1, "-0.0")
