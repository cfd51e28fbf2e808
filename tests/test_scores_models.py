import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowmine.functions.arrays import align_classes, confidence
from flowmine.operators import fusion, imbalance, metrics, models, neighbors, rankers, redundancy, selection
from flowmine.settings import ImbalanceSettings, ModelSettings


def test_confidence_and_alignment(spark):
    d = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [0.2, 0.2]), ([0.25] * 4, [0.0, 0.0])], "p array<double>, q array<double>")
    got = d.select(F.round(confidence(F.col("p"), 4), 6), align_classes(F.col("q"), [1, 3], 4)).collect()
    assert tuple(got[0]) == (1.0, [0.0, 0.5, 0.0, 0.5]) and tuple(got[1]) == (0.0, [0.25] * 4)


def test_macro_scores_use_labels_in_truth_or_prediction(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 3)], "y int, pred int")
    r = metrics.summary_scores(metrics.confusion(d, "y", "pred")).first()
    assert r["accuracy"] == 0.5 and r["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0.0) / 3)


def test_mcnemar():
    assert metrics.mcnemar(0, 0) == (0.0, 1.0)
    assert metrics.mcnemar(1, 9)[1] == pytest.approx(2 * (1 + 10) / 1024)
    stat, p = metrics.mcnemar(40, 20)
    assert stat == pytest.approx(19 ** 2 / 60) and p == pytest.approx(math.erfc(math.sqrt(stat / 2)))


def test_bootstrap(spark):
    d = spark.range(300).select((F.col("id") % 2).cast("int").alias("y"),
                                F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id") % 2).cast("int").alias("a"),
                                F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2).cast("int").alias("b"))
    r = metrics.bootstrap_difference(d, "y", "a", "b", 200)
    assert r["ci_low"] <= r["observed_diff"] <= r["ci_high"] and 0 <= r["p_value"] <= 1
    assert r == metrics.bootstrap_difference(d, "y", "a", "b", 200)


def three(spark):
    g = np.random.default_rng(0)
    y = g.integers(0, 3, 200)
    out = []
    for i in range(200):
        ps = []
        for m in range(2):
            v = g.random(3) + (np.arange(3) == y[i]) * (1.5 - m)
            ps.append([float(x) for x in v / v.sum()])
        out.append((i, int(y[i]), *ps, float(g.random()), float(g.random()), float(i % 4 > 0)))
    return spark.createDataFrame(out, "row_id int, y int, p_a array<double>, p_b array<double>, sp double, tc double, availability double")


def test_fusion_weights(spark):
    d = fusion.add_context(three(spark), None, ["x", "y", "z"])
    f = fusion.Fusion(["a", "b"], ["x", "y", "z"], 0).fit(d, "y")
    out = f.fuse(d).collect()
    for r in out:
        assert sum(r["w"]) == pytest.approx(1.0) and sum(r["fused"]) == pytest.approx(1.0)
        if not r["availability"]:
            assert r["w"][2] == r["w"][3] == 0.0
    assert len(f.lambda_grid(0.1)) == 66 and sum(f.lambdas) == pytest.approx(1.0)
    assert f.ablations(d, "y").count() == 7


def test_label_context_follows_each_model(spark):
    from flowmine.operators import temporal
    seqs = spark.createDataFrame([(["x", "x", "y"],), (["x", "y", "z"],)], "events array<string>")
    g = temporal.fit_transitions(seqs, ["x", "y", "z"], alpha=0.5)
    d = three(spark).withColumn("s", F.col("row_id") % 7).withColumn("ts", F.timestamp_seconds(F.floor(F.col("row_id") / 9)))
    d = d.withColumn("p_a", F.when(F.col("row_id") != 100, F.col("p_a")))
    out = fusion.add_label_context(d, g, ["x", "y", "z"], ["a", "b"], "s", "ts", ["row_id"])
    counts = {(0, 0): 1, (0, 1): 2, (1, 2): 1}
    last, k = {}, {}
    got = sorted(out.collect(), key=lambda r: (r["ts"], r["row_id"]))
    for r in got:
        for m in "ab":
            now = None if r["p_" + m] is None else int(np.argmax(r["p_" + m]))
            before = last.get((m, r["s"]))
            total = {0: 3, 1: 1, 2: 0}
            want = 1 / 3 if now is None or before is None else (counts.get((before, now), 0) + 0.5) / (total[before] + 1.5)
            assert r["k_" + m] == pytest.approx(want)
            last[m, r["s"]], k[m, r["row_id"]] = now, want
    assert any(r["k_a"] != r["k_b"] for r in got)
    clean = out.filter("row_id != 100").withColumn("context", F.array(*[F.lit(1 / 3)] * 3))
    f = fusion.Fusion(["a", "b"], ["x", "y", "z"], 0, by_model=True, lambdas=(0.0, 0.0, 1.0), quality={"sp": 0.0, "tc": 0.0})
    for r in f.fuse(clean).collect():
        assert r["q"][:2] == pytest.approx([r["k_a"], r["k_b"]])
    assert f.lambda_scores(clean, "y", 0.5).count() == 6


def test_metric_tables_read_the_rows_twice(spark):
    d = three(spark).withColumn("y", F.when(F.col("row_id") % 19 > 0, F.col("y")))
    plans = []

    def stage(df):
        from flowmine.session import cut_lineage
        plans.append(df)
        return cut_lineage(df)
    t = metrics.evaluate(d, ["a", "b"], "y", ["x", "y", "z"], ["z"], stage=stage)
    assert len(plans) == 2
    for table in t.values():
        assert "sp#" not in table._jdf.queryExecution().toString()       # no column of the rows
    flat = {r["model"]: r for r in t["metrics"].collect()}
    for m in "ab":
        long = d.select("y", F.col(f"p_{m}").alias("p"))
        ece = metrics.calibration_error(metrics.confidence_bins(long, "p", "y")).first()[0]
        assert flat[m]["ece"] == pytest.approx(ece) and flat[m]["brier"] == pytest.approx(metrics.brier(long, "p", "y").first()[0])
        assert flat[m]["n_samples"] >= 189


def pool_adjacent(x, y):
    order = np.argsort(x)
    blocks = []
    for v in y[order]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b = blocks.pop()
            a = blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    flat = np.concatenate([[v] * n for v, n in blocks])
    out = np.empty(len(x))
    out[order] = flat
    return out


@pytest.mark.parametrize("how", ["isotonic", "platt", "temperature"])
def test_calibration(spark, how):
    d = three(spark)
    out = fusion.fit_calibrator(d, "p_b", "y", 3, how).apply(d, "p_b", "c").orderBy("row_id").collect()
    c = np.array([r["c"] for r in out])
    assert np.allclose(c.sum(1), 1.0) and (c >= 0).all()
    if how == "isotonic":
        p, y = np.array([r["p_b"] for r in out]), np.array([r["y"] for r in out])
        raw = np.stack([pool_adjacent(p[:, k], (y == k).astype(float)) for k in range(3)], 1)
        assert np.allclose(c, raw / raw.sum(1, keepdims=True), atol=1e-9)


def test_class_weights(spark):
    d = spark.createDataFrame([(0,), (1,), (1,), (2,)], "y int")
    assert rows(imbalance.class_weights(d, "y", [0, 1, 2, 3]).select("y", "weight"), "y") == [(0, 1.0), (1, 0.5), (2, 1.0), (3, 0.0)]


def cloud(spark, counts, seed=1):
    g = np.random.default_rng(seed)
    data = []
    for c, n in enumerate(counts):
        for _ in range(n):
            data.append((str(len(data)), c, [float(v) for v in g.normal(c * 0.8, 1.0, 3)]))
    return data, spark.createDataFrame(data, "row_id string, y int, x array<double>")


def test_nearest_and_cleaning_match_brute_force(spark):
    data, d = cloud(spark, [60, 40, 8])
    x, y = np.array([r[2] for r in data]), np.array([r[1] for r in data])
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, 1)[:, :3]
    got = {r["id"]: [int(n["other"]) for n in r["neighbours"]]
           for r in neighbors.nearest(d, 3, "row_id", "x", "y", block_rows=20).collect()}
    assert all(got[str(i)] == list(near[i]) for i in range(len(x)))
    kept = {r["row_id"] for r in imbalance.edited_neighbours(d, "y", "row_id", "x", 3).collect()}
    assert kept == {str(i) for i in range(len(x)) if y[i] == 2 or (y[near[i]] == y[i]).all()}


def test_smote_enn_loses_no_class_and_stays_on_segments(spark):
    data, d = cloud(spark, [120, 30, 20, 4, 2])
    plan = imbalance.oversampling_plan(d.groupBy("y").count().withColumnRenamed("count", "n"), "y", ImbalanceSettings(max_oversample_ratio=3))
    assert {r["y"]: r["method"] for r in plan.collect()} == {0: "none", 1: "smote", 2: "smote", 3: "random_oversample", 4: "random_oversample"}
    new = imbalance.smote(d, "y", "row_id", "x", plan, 5).collect()
    by = {c: np.array([r[2] for r in data if r[1] == c]) for c in range(5)}
    assert len(new) == 60 + 40
    for r in new[:30]:
        pts, v, seed = by[r["y"]], np.array(r["x"]), np.array(data[int(r["row_id"].split("~")[0])][2])
        gaps = [np.linalg.norm(v - seed) + np.linalg.norm(q - v) - np.linalg.norm(q - seed) for q in pts if (q != seed).any()]
        assert min(gaps) < 1e-9
    res = imbalance.handle_imbalance(d, "y", "row_id", "x", ImbalanceSettings(max_oversample_ratio=3))
    after = {r["y"]: r["after"] for r in res.report.collect()}
    assert set(after) == set(range(5)) and all(v > 0 for v in after.values())
    assert res.weights.count() == 5


def test_smote_enn_takes_every_row_of_a_large_class(spark):
    y = F.when(F.col("id") < 150_050, 0).otherwise(1)
    d = spark.range(150_200).select(F.col("id").cast("string").alias("row_id"), y.alias("y"), F.array(
        (F.col("id") % 7).cast("double"), y * 50.0).alias("x"))
    # The classes lie apart, so cleaning removes nothing.
    report = imbalance.smote_enn(d, "y", "row_id", "x", ImbalanceSettings(max_oversample_ratio=3)).report
    assert rows(report.select("y", "before", "after", "target"), "y") == [(0, 150_050, 150_050, 150_050), (1, 150, 450, 450)]
    few = imbalance.smote_enn(d, "y", "row_id", "x", ImbalanceSettings(max_oversample_ratio=3, majority_cap=1_000)).report
    assert rows(few.select("y", "before", "after", "target"), "y") == [(0, 150_050, 1_000, 1_000), (1, 150, 450, 450)]


def test_lambda_grid_is_scored_without_a_row_a_triple(spark):
    g = np.random.default_rng(5)
    data = []
    for i in range(120):
        a, b = g.dirichlet(np.ones(3)).tolist(), g.dirichlet(np.ones(3)).tolist()
        data.append((None if i % 29 == 0 else int(g.integers(3)), None if i % 17 == 0 else a, b, float(g.random()), g.dirichlet(np.ones(3)).tolist()))
    d = spark.createDataFrame(data, "y int, p_a array<double>, p_b array<double>, availability double, context array<double>")
    d = d.withColumns({"sp": F.lit(0.2), "tc": F.lit(0.4), "row_id": F.monotonically_increasing_id()})
    f = fusion.Fusion(["a", "b"], ["x", "y", "z"], 0, quality={"a": 0.7, "b": 0.4, "sp": 0.6, "tc": 0.5})
    table = f.lambda_scores(d, "y", 0.25)
    got = {(r["l1"], r["l2"], r["l3"]): r["macro_f1"] for r in table.collect()}
    assert list(got) and set(got) == set(f.lambda_grid(0.25))
    for triple in list(got)[::4]:
        f.lambdas = triple
        want = metrics.summary_scores(metrics.confusion(f.fuse(d), "y", "pred")).first()["macro_f1"]
        assert got[triple] == pytest.approx(want, abs=1e-12)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("MapInPandas")[1]


def test_forests_read_their_rows_from_a_stage(spark):
    _, d = cloud(spark, [50, 30, 20])
    d = d.select("row_id", "y", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate("abc")])
    kept = rankers.fitting_rows(d, ["a", "b"], "y", "row_id", 40, 1)
    files = kept.inputFiles()
    assert 0 < kept.count() <= 40 and files and all("/cut-" in f for f in files)
    assert sorted(kept.columns) == ["a", "b", "row_id", "weight", "y"]


def brute_information(x, y, k):
    def psi(n):
        return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))
    total = []
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))
        kk = min(k, (y == y[i]).sum() - 1)
        r = same[kk]
        m = (np.abs(x - x[i]) < r).sum() if r > 0 else (x == x[i]).sum()
        total.append(psi(kk) - psi((y == y[i]).sum()) - psi(m))
    return max(0.0, psi(len(x)) + np.mean(total))


def test_neighbour_information_matches_brute_force(spark):
    g = np.random.default_rng(3)
    y = g.integers(0, 3, 150)
    a, b = (y * 0.25 + g.random(150) * 0.3), np.round(g.random(150), 1)
    d = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(150)], "row_id int, y int, a double, b double")
    got = {r["feature"]: r["score"] for r in rankers.mutual_information(d, ["a", "b"], "y", "row_id").collect()}
    assert got["a"] == pytest.approx(brute_information(a, y, 3), abs=1e-6)
    assert got["b"] == pytest.approx(brute_information(b, y, 3), abs=1e-6)


def test_shapley_adds_up(spark):
    from pyspark.ml.classification import GBTClassifier
    g = np.random.default_rng(0)
    x = g.random((200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.8).astype(float)
    d = rankers.with_vector(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double"), ["a", "b", "c"])
    m = GBTClassifier(labelCol="y", maxIter=3, maxDepth=3).fit(d)
    nodes = rankers.tree_nodes(m, spark).toPandas()
    nodes["value"] *= nodes["tree"].map(lambda t: m.treeWeights[int(t)])
    paths = rankers.leaf_paths(nodes)
    phi = rankers.shapley_values(paths, x, 3)
    raw = np.array([r[0][1] for r in m.transform(d).select("rawPrediction").collect()])
    assert np.allclose(raw - phi.sum(1), (raw - phi.sum(1))[0])
    assert np.abs(phi[:, 2]).mean() < np.abs(phi[:, 0]).mean()


def test_network_gradient(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    g = np.random.default_rng(1)
    x = g.random((60, 2))
    d = rankers.with_vector(spark.createDataFrame([(*map(float, r), float(r[0] > 0.5)) for r in x], "a double, b double, y double"), ["a", "b"])
    m = MultilayerPerceptronClassifier(labelCol="y", layers=[2, 4, 2], maxIter=20, seed=1).fit(d)
    parts = rankers.mlp_parts([2, 4, 2], np.array(m.weights))
    p = np.array([list(r[0]) for r in m.transform(d).select("probability").collect()])

    def forward(v):
        h = 1 / (1 + np.exp(-(v @ parts[0][0].T + parts[0][1])))
        e = np.exp(h @ parts[1][0].T + parts[1][1])
        return e / e.sum(1, keepdims=True)
    assert np.allclose(forward(x), p)
    step = 1e-6 * np.array([[1.0, 0.0]])
    assert np.allclose((forward(x + step) - forward(x - step)) / 2e-6, rankers.mlp_input_gradients(parts, x)[:, :, 0], atol=1e-6)


def scores_of(spark, data):
    return spark.createDataFrame([(r, f, i, float(v)) for r, vs in data.items() for i, (f, v) in enumerate(vs.items())],
                                 "ranker string, feature string, pos int, score double")


def test_votes(spark):
    s = scores_of(spark, {"m": dict(a=.5, b=0, c=-.2, d=.9, e=.1)})
    assert [r["feature"] for r in selection.top_k(s, 3).orderBy("rank").collect()] == ["d", "a", "e"]
    s = scores_of(spark, {"r1": dict(f1=9, f2=5, f3=3, f4=0), "r2": dict(f1=9, f2=5, f3=0, f4=0), "r3": dict(f1=9, f2=0, f3=0, f4=0)})
    t = {r["feature"]: r for r in selection.fuse_rankings(s, ["r1", "r2", "r3"], 3, 2).collect()}
    assert [t[f]["votes"] for f in ("f1", "f2", "f3")] == [3, 2, 1]
    assert t["f1"]["score"] == 1.0 and t["f3"]["in_pool"] == 0 and t["f1"]["place"] == 1


def test_redundancy(spark):
    g = np.random.default_rng(5)
    a, e = g.random(400), g.random(400)
    d = spark.createDataFrame([(i, float(a[i]), 1.0, float(a[i]), float(2 * a[i] + 1), float(e[i])) for i in range(400)],
                              "row_id int, a double, const double, dup double, lin double, e double")
    f = redundancy.RedundancyFilter().fit(d, ["a", "const", "dup", "lin", "e"], "row_id")
    assert f.kept == ["a", "e"] and {k: v[0] for k, v in f.dropped.items()} == {"const": "low_variance", "dup": "duplicate", "lin": "spearman"}


@pytest.mark.parametrize("kind", ["rf", "boost", "neural", "sequence", "graph"])
def test_models_align_save_and_load(spark, tmp_path, kind):
    g = np.random.default_rng(2)
    data = [(i, int(c), f"s{i // 5}", f"h{i % 3}", i, float(g.normal(c, .5)), float(g.normal(-c, .5)), 1.0)
            for i, c in enumerate(g.choice([0, 1, 3], 150))]
    d = spark.createDataFrame(data, "row_id int, y int, session_id string, src_ip string, t long, a double, b double, w double").withColumn(
        "ts", F.timestamp_seconds("t")).cache()
    td = models.TrainingData(d, d, ["a", "b"], 5, weight="w")
    m = models.MODELS[kind](td, ModelSettings(rf_trees=5, rf_depth=4, boost_rounds=3, boost_depth=2, window=3, hidden=(4,), epochs=20))
    p = m.predict(d, "p").orderBy("row_id").select("p").collect()
    v = np.array([r["p"] for r in p])
    assert v.shape == (150, 5) and np.allclose(v.sum(1), 1) and m.parameters() > 0
    if kind in ("rf", "boost"):
        assert (v[:, [2, 4]] == 0).all()
    m.save(spark, str(tmp_path / "m"))
    again = models.Fitted.load(spark, str(tmp_path / "m")).predict(d, "p").orderBy("row_id").select("p").collect()
    assert np.allclose(v, np.array([r["p"] for r in again]))


def test_permutations_are_scored_without_lifted_vectors(spark, monkeypatch):
    """Held-out variants get the library's predictions, but the 100 cosines of a row stay in its batch."""
    from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
    d = spark.range(400).select("id", (F.col("id") % 3).alias("y"), ((F.col("id") * 7) % 11 / 11.0 + F.col("id") % 3).alias("a"),
                                ((F.col("id") * 5) % 13 / 13.0).alias("b"))
    lift = rankers.cosine_map(2, 100, 0.5, 1)
    x = rankers.fourier_features(lift)(d.withColumn("x", F.array("a", "b")))
    model = OneVsRest(classifier=LinearSVC(maxIter=5, regParam=0.001), labelCol="y").fit(x.select("features", F.col("y").cast("double").alias("y")))
    want = rows(model.transform(x).select("id", "prediction"), "id")
    got = rows(d.select("id", rankers.lifted_prediction(model, lift)([F.col("a"), F.col("b")])), "id")
    assert got == want and len({p for _, p in got}) == 3
    monkeypatch.setattr(OneVsRestModel, "_transform", lambda *_: pytest.fail("rows are lifted to vectors"))
    score = {r["feature"]: r["score"] for r in rankers.rank_permutation(d, ["a", "b"], "y", "id").collect()}
    assert score["a"] > 0.3 > abs(score["b"])


def test_calibration_of_counted_rows(spark):
    """Equal rows count as often as they occur, in the report and on the temperature grid."""
    from flowmine.operators import reports
    d = spark.createDataFrame([([0.7, 0.2, 0.1], 0, 40), ([0.7, 0.2, 0.1], 1, 9), ([0.1, 0.3, 0.6], 2, 3), ([0.3, 0.4, 0.3], None, 2)],
                              "p array<double>, y int, times int")
    long = d.select("p", "y", F.explode(F.sequence(F.lit(1), "times")).alias("id"))
    counted = metrics.counted_rows(long, "p", "y")
    assert sorted(r["n"] for r in counted.collect()) == [2, 3, 9, 40]
    cal = fusion.fit_calibrator(long, "p", "y", 3, "temperature")
    assert cal.temperature == pytest.approx(fusion.fit_calibrator(d.select("p", "y", F.explode(F.array_repeat(F.lit(1), F.col("times")))), "p", "y", 3, "temperature").temperature)
    want = reports.calibration_change(cal.apply(long, "p", "q"), "p", "q", "y").first()
    got = reports.calibration_change(cal.apply(counted, "p", "q"), "p", "q", "y", weight="n").first()
    assert tuple(got) == pytest.approx(tuple(want), abs=2e-6)
    nll = [(-math.log(v[t] ** (1 / cal.temperature) / sum(x ** (1 / cal.temperature) for x in v)), n)
           for v, t, n in (([0.7, 0.2, 0.1], 0, 40), ([0.7, 0.2, 0.1], 1, 9), ([0.1, 0.3, 0.6], 2, 3))]
    for other in (cal.temperature * 1.05, cal.temperature / 1.05):
        worse = [(-math.log(v[t] ** (1 / other) / sum(x ** (1 / other) for x in v)), n)
                 for v, t, n in (([0.7, 0.2, 0.1], 0, 40), ([0.7, 0.2, 0.1], 1, 9), ([0.1, 0.3, 0.6], 2, 3))]
        assert sum(a * n for a, n in nll) <= sum(a * n for a, n in worse)
