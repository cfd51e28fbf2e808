"""The whole analysis on a cleaned, sessionized table, and its variants."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.functions.columns import quote
from flowmine.operators import (
    clean, fusion, guards, imbalance, metrics, models, reports, selection, splits, temporal, windows)
from flowmine.operators.fitted import FlowStates, Preprocessor
from flowmine.operators.sessions import communication_key, sessionize
from flowmine.session import cut_lineage
from flowmine.settings import LABEL_GROUPS, SENTINEL_COLUMNS, SURROGATE_START, Settings
from flowmine.sources import files


@dataclass(frozen=True)
class Roles:
    """Names of the columns that are not features."""

    row_id: str = "row_id"
    ts: str = "ts"
    session: str = "session_id"
    label: str = "label_group"
    y: str = "y"
    host: str = "src_ip"


@dataclass
class Result:
    split: DataFrame
    selection: selection.FeatureSelection
    temporal: temporal.TemporalModel
    fitted: dict[str, models.Fitted]
    fusion: fusion.Fusion
    scored: DataFrame
    tables: dict[str, DataFrame]
    summary: dict
    timings: dict[str, float] = field(default_factory=dict)


@dataclass
class Prepared:
    """Cleaned rows with sessions, their feature columns and what the cleaning did."""

    rows: DataFrame
    features: list[str]
    reports: dict[str, DataFrame]


#: Tables that ``prepare`` writes beside the rows.
REPORTS = ("repair", "labels", "classes", "cleaning")


def prepare(spark: SparkSession, folder: str, settings: Settings = Settings(), columns: dict[str, str] | None = None,
            base: str | None = None) -> tuple[DataFrame, list[str], Roles]:
    """Rows, features and roles of ``clean_folder``.

    With ``base`` the rows and reports are staged there under a key of the files
    and of the settings that cleaning reads, so runs that differ in split, balance
    or models share them; ``prepared_reports`` reads the reports back.
    """
    if base is None:
        made = clean_folder(spark, folder, settings, columns)
        return made.rows, made.features, Roles()
    key = prepared_key(spark, folder, settings, columns)
    build = functools.cache(lambda: clean_folder(spark, folder, settings, columns))
    rows = files.parquet_stage(spark, base, "rows", key, lambda: build().rows, lambda: {"features": build().features})
    for name in REPORTS:
        files.parquet_stage(spark, base, name, key, lambda name=name: build().reports[name])
    return rows, files.stage_meta(spark, base, "rows", key)["features"], Roles()


def prepared_key(spark: SparkSession, folder: str, settings: Settings, columns: dict[str, str] | None = None) -> str:
    return files.signature(files=files.folder_state(spark, folder), least=settings.expect_min_rows, port=settings.use_dst_port,
                           classes=settings.classes, session=asdict(settings.session),
                           length=settings.temporal.max_sequence_length, columns=columns)


def prepared_reports(spark: SparkSession, folder: str, settings: Settings, base: str,
                     columns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Reports staged by ``prepare``: numeric repair, label counts, classes, cleaning."""
    key = prepared_key(spark, folder, settings, columns)
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}-{key}/data") for n in REPORTS}


def clean_folder(spark: SparkSession, folder: str, settings: Settings = Settings(),
                 columns: dict[str, str] | None = None) -> Prepared:
    """Read a folder of flow CSVs: types, clocks, labels, sessions, cleaning.

    ``columns`` names src, dst, src_port, dst_port, protocol, ts and label
    columns; without addresses, runs of equal port and protocol stand in.
    """
    from flowmine.functions.columns import first_present
    raw = files.read_csv_folder(spark, folder)
    files.require_rows(raw, settings.expect_min_rows)
    have = raw.columns
    pick = lambda *names: first_present(have, names)
    c = {"src": pick("Source IP", "Src IP"), "dst": pick("Destination IP", "Dst IP"),
         "src_port": pick("Source Port", "Src Port"), "dst_port": pick("Destination Port", "Dst Port"),
         "protocol": pick("Protocol"), "ts": pick("Timestamp"), "label": pick("Label"), **(columns or {})}
    named = {v for v in c.values() if v} - {c["dst_port"], c["protocol"]}
    text = {*named, "Flow ID", "source_file", "source_path", "row_in_source"}
    numeric = [x for x in have if x not in text]
    # Unlabelled rows go first: they are mostly stray header lines.
    rows = clean.group_labels(raw, c["label"], classes=settings.classes)
    rows, repair = clean.repair_numeric(rows, numeric, "source_path")
    if c["ts"]:
        rows = clean.fix_timestamps(rows, c["ts"], "source_path", file_name="source_file")
    else:
        rows = rows.withColumn("ts", F.lit(None).cast("timestamp"))
    rows = clean.fill_clocks(rows, "source_path", "row_in_source", SURROGATE_START, file_name="source_file")
    rows = rows.withColumn("row_id", F.concat_ws(":", "source_path", F.col("row_in_source").cast("string")))
    opt = lambda k: quote(c[k]) if c[k] else None
    s = settings.session
    if c["src"] and c["dst"]:
        rows = rows.withColumn("__key", communication_key(
            s.key_mode, opt("src"), opt("dst"), opt("src_port"), opt("dst_port"), opt("protocol")))
        rows = sessionize(rows, "__key", "ts", ["source_path", "row_in_source"], s).drop("__key")
        rows = rows.withColumn("src_ip", quote(c["src"]))
    else:
        from flowmine.operators.sessions import run_length_sessions
        keys = [quote(c[k]) for k in ("dst_port", "protocol") if c[k]]
        rows = run_length_sessions(rows, "source_path", "row_in_source", keys, settings.temporal.max_sequence_length)
        rows = rows.withColumn("src_ip", F.col("source_path"))
    # Copies are judged with the session in place, as their times and text are.
    order = ["ts", "source_path", "row_in_source", "source_file", "row_id"]
    content = [x for x in rows.columns if x not in order]
    features = clean.feature_columns(have, [*named, "source_file", "source_path", "row_in_source"], settings.use_dst_port)
    types = dict(rows.dtypes)
    features = [f for f in features if types[f] == "double"]
    told = {"repair": repair, "labels": clean.unlabelled_counts(raw, c["label"], LABEL_GROUPS),
            "classes": reports.class_distribution(rows, "label_raw", "label_group"),
            "cleaning": reports.cleaning_report(rows, features, SENTINEL_COLUMNS, "session_id", "ts", "label_group", content)}
    rows = clean.drop_copies(rows, content, order)
    rows = clean.blank_negative(clean.blank_infinite(rows, features), features, SENTINEL_COLUMNS)
    return Prepared(clean.to_float(rows, [f for f in features if f != c["protocol"]]), features, told)


def run(df: DataFrame, features: Sequence[str], roles: Roles = Roles(), settings: Settings = Settings(),
        categorical: Sequence[str] = (), states: dict[str, str | None] | None = None, strategy: str | None = None,
        held_out: str | None = None, stage: Callable[[DataFrame], DataFrame] = cut_lineage) -> Result:
    """Split, guard, fit on train, select, balance, mine, model, calibrate, fuse, score.

    ``stage`` writes the results that fan out (split, scaled rows, predictions).
    """
    r, s, t = roles, settings, {}
    clock = [time.perf_counter()]

    def lap(name: str) -> None:
        now = time.perf_counter()
        t[name], clock[0] = now - clock[0], now

    strategy = strategy or s.split.strategy
    classes = list(s.classes)
    benign = classes.index(s.benign) if s.benign in classes else 0
    split = stage(splits.make_split(df, strategy, session=r.session, ts=r.ts, label=r.label, row_id=r.row_id,
                                    classes=classes, settings=s.split, held_out=held_out))
    train_raw = split.filter("split = 'train'")
    guards.enforce(guards.split_guards(split, r.row_id, r.session, r.ts, strategy, fitted=train_raw))
    lap("split")

    numeric = [f for f in features if f not in categorical]
    prep = Preprocessor(numeric, list(categorical)).fit(train_raw)
    bins = FlowStates(states or dict(zip("DBP", [*numeric, None, None, None][:3])), s.temporal.bins).fit(train_raw)
    keep = [r.row_id, r.ts, r.session, r.label, r.y, r.host, "split"]
    if s.temporal.event_definition not in ("flow_state", "true_label"):
        raise ValueError(f"events are flow_state or true_label when fitted, not {s.temporal.event_definition!r}")
    if s.fusion.context not in ("states", "label_graph"):
        raise ValueError(f"context comes from states or label_graph, not {s.fusion.context!r}")
    by_label = s.temporal.event_definition == "true_label"
    event = split.withColumn("__event", F.col(r.label)) if by_label else bins.transform(split, "__event")
    scaled_rows = stage(prep.transform(event, [*dict.fromkeys(keep), "__event"]))
    train, val, test = [scaled_rows.filter(F.col("split") == p) for p in ("train", "val", "test")]
    lap("fit transformers")

    chosen = selection.select_features(train, val, prep.output_columns, r.y, r.row_id, s.selection, s.seed)
    f_star = chosen.chosen
    lap("select features")

    vec = F.array(*[quote(c).cast("double") for c in f_star])
    balanced = imbalance.handle_imbalance(train.select(r.row_id, r.y, vec.alias("x")), r.y, r.row_id, "x",
                                          s.imbalance, None, s.seed)
    flow_rows = balanced.rows.select(r.row_id, r.y, *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(f_star)])
    weight = None
    if balanced.weights is not None:
        flow_rows, weight = imbalance.row_weights(flow_rows, r.y, balanced.weights), "weight"
    flow_rows = stage(flow_rows)
    lap("balance")

    mined = temporal.mine_temporal(train, r.session, r.ts, [r.row_id], "__event", s.temporal, classes, stage)
    lap("mine patterns")

    ordered = train
    if weight:
        ordered = imbalance.row_weights(train, r.y, imbalance.class_weights(train, r.y))
    base = dict(features=f_star, n_classes=len(classes), row_id=r.row_id, y=r.y, weight=weight, session=r.session,
                ts=r.ts, host=r.host, seed=s.seed)
    fitted, failed = models.train_all(models.TrainingData(flow_rows, val, **base),
                                      models.TrainingData(ordered, val, **base), s.models)
    for name, m in fitted.items():
        guards.same_features(f_star, m.features, name)
    lap("train models")

    def scored_part(part: DataFrame) -> DataFrame:
        d = models.predict_all(fitted, part)
        if by_label and fitted:                 # labels are known in training only; later the first model names the event
            named = F.array(*[F.lit(c) for c in classes])
            d = d.withColumn("__event", F.get(named, metrics.argmax(F.col(f"p_{next(iter(fitted))}"))))
        d = windows.previous_state(d, r.session, r.ts, [r.row_id], F.col("__event"))
        d = mined.evidence(d, r.session, r.ts, [r.row_id], "__event")
        return stage(fusion.add_context(d, mined.graph, classes))

    pv, pt = scored_part(val), scored_part(test)
    guards.enforce(guards.combine([guards.not_resampled(val, pv), guards.not_resampled(test, pt)]))
    for name in fitted:
        guards.enforce(guards.probabilities_valid(pt, f"p_{name}", r.row_id))
    lap("predict")

    cal = fusion.fit_calibrators(pv, list(fitted), r.y, len(classes), s.fusion)
    own_paths = s.fusion.context == "label_graph"
    if own_paths:
        labels = temporal.fit_transitions(windows.event_sequences(
            train, r.session, r.ts, [r.row_id], F.col(r.label), s.temporal.max_sequence_length), classes)

    def calibrated(part: DataFrame) -> DataFrame:
        d = fusion.apply_calibrators(part, cal)
        return stage(fusion.add_label_context(d, labels, classes, list(fitted), r.session, r.ts, [r.row_id]) if own_paths else d)

    cv, ct = calibrated(pv), calibrated(pt)
    fuse = fusion.Fusion(list(fitted), classes, benign, s.fusion.temporal, by_model=own_paths).fit(cv, r.y, s.fusion)
    out = stage(fuse.fuse(ct))     # the guard and every table read it
    guards.enforce(guards.weights_sum_to_one(out, "w", r.row_id))
    lap("fuse")

    shown = out.withColumn("p_fusion", F.col("fused"))
    tables = metrics.evaluate(shown, [*fitted, "fusion"], r.y, classes, s.evaluation.rare_classes, s.evaluation.ece_bins, stage)
    tables["metrics"] = stage(tables["metrics"])    # one row a model, read here and by the caller
    preds = shown.select(r.y, *[metrics.argmax(F.col(f"p_{m}")).alias(m) for m in (*fitted, "fusion")])
    tables |= {
        "split": reports.split_distribution(split, r.label, classes),
        "comparison": metrics.compare_models(preds, r.y, [*fitted, "fusion"], alpha=s.evaluation.alpha),
        "weights": fuse.weight_summary(out), "votes": chosen.votes, "patterns": mined.pattern_table,
        "transitions": files.observed_edges(mined.graph.observed())}
    if held_out:
        tables["zero_day"] = metrics.zero_day(out, r.y, "pred", classes.index(held_out), benign, held_out)
    flat = tables["metrics"].filter("model = 'fusion'").first()
    lap("evaluate")
    summary = {"strategy": strategy, "imbalance": s.imbalance.mode, "n_features": len(f_star),
               "accuracy": flat["accuracy"], "macro_f1": flat["macro_f1"], "weighted_f1": flat["weighted_f1"],
               "ece": flat["ece"], "threshold": fuse.threshold, "lambdas": str(fuse.lambdas), "failed": ",".join(failed)}
    return Result(split, chosen, mined, fitted, fuse, out, tables, summary, t)


SUMMARY = ("name string, strategy string, imbalance string, n_features int, accuracy double, macro_f1 double, "
           "weighted_f1 double, ece double, threshold double, lambdas string, failed string")


def summary_table(spark: SparkSession, summaries: dict[str, dict]) -> DataFrame:
    """One row per run."""
    names = [x.split()[0] for x in SUMMARY.split(", ")][1:]
    return spark.createDataFrame([(n, *[v[k] for k in names]) for n, v in summaries.items()], SUMMARY)


def imbalance_branches(df, features, roles=Roles(), settings: Settings = Settings(),
                       modes: Sequence[str] = ("class_weight", "smote_enn", "both"), **kw) -> dict[str, Result]:
    """The same run under several ways of handling rare classes."""
    return {m: run(df, features, roles, settings.with_(imbalance={"mode": m}), **kw) for m in modes}


def protocol_branches(df, features, roles=Roles(), settings: Settings = Settings(),
                      strategies: Sequence[str] = ("time_blocked", "stratified_session", "stratified_flow"),
                      **kw) -> dict[str, Result]:
    """The same run under several split protocols."""
    return {p: run(df, features, roles, settings, strategy=p, **kw) for p in strategies}


def leakage_gap(scores: DataFrame, key: str, metric_cols: Sequence[str], reference: str = "time_blocked") -> DataFrame:
    """Each protocol's scores less those of the reference protocol."""
    ref = scores.filter(F.col(key) == reference).select(*[F.col(m).alias(f"__{m}") for m in metric_cols])
    return scores.join(F.broadcast(ref)).select(
        key, *metric_cols, *[(F.col(m) - F.col(f"__{m}")).alias(f"{m}_gap") for m in metric_cols])


def zero_day_branches(df, features, roles=Roles(), settings: Settings = Settings(), families: Sequence[str] = (),
                      min_flows: int = 5, **kw) -> DataFrame:
    """Hold out one family at a time, refit everything, report recall and false alarms.

    Families with too few rows are kept in the table with a note.
    """
    spark = df.sparkSession
    sizes = {x[0]: x[1] for x in df.groupBy(roles.label).agg(F.count(F.lit(1))).collect()}
    rows = []
    for fam in families or [c for c in settings.classes if c != settings.benign]:
        n = sizes.get(fam, 0)
        if n < min_flows:
            rows.append((fam, n, None, None, f"fewer than {min_flows} rows"))
            continue
        z = run(df, features, roles, settings, strategy="leave_family_out", held_out=fam, **kw).tables["zero_day"].first()
        rows.append((fam, n, z["unseen_detection_recall"], z["false_alarm_rate"], ""))
    return spark.createDataFrame(
        rows, "held_out_family string, n_flows long, unseen_detection_recall double, false_alarm_rate double, note string")


def comparison(tables: dict[str, DataFrame]) -> DataFrame:
    """Branch summaries side by side; columns a branch lacks are NULL."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                            [t.withColumn("branch", F.lit(n)) for n, t in tables.items()])


