import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmine.llm import licenses, mixing, quality
from flowmine.llm.queries import LICENSE_SQL, MIXING_SQL, QUALITY_SQL

LONG = " ".join(f"word{i}" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak tree nearby."
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \t\r\n\x0b\x0c ", None), (4, PROSE, "b"), (5, PROSE, "b"), (6, LONG, "c"),
    (7, "one two three four five six seven eight nine\n" * 9, "c"), (8, (PROSE + "\n") * 2, "a"),
    (9, "### %%% $$$ a b c d e f g h i j k l m n o p q r s t u v", "é"), (10, "x x x x x " * 10, "Z"),
    (11, PROSE + "\nReleased under the MIT License.", None),
    (12, PROSE + " (Licensed under the Apache\nLicense; version 2.0!)", "b"),
    (13, "This work is licensed under the GNU Lesser General Public License, version 3. " + PROSE, "b"),
    (14, "12 34 56 78 90 " * 8, "a"), (15, "\U0001f600 ñandú " + PROSE, "￿"), (16, "a b " + PROSE, "\U0001f600"),
]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def expected(sql, rows):
    con = duckdb.connect()
    frame = pd.DataFrame([(r[0], r[1], r[2]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "int64"})
    con.register("frame", frame)
    con.execute("CREATE TABLE documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM frame")
    return con.execute(sql)


def same(df, sql, rows):
    rel = expected(sql, rows)
    names = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
    return want


def test_quality_report_equals_sql_and_order_does_not_matter(spark, docs):
    df = docs(ROWS).withColumnRenamed("lang", "rejected_by_").withColumnRenamed("n_chars", "w_")
    report = same(quality.quality_report(df), QUALITY_SQL, ROWS)
    kept = {r[0] for r in report if r[-1]}
    assert {4, 5, 6} <= kept and not kept & {1, 2, 3, 9, 10}
    names = [r.name for r in quality.RULES]
    for order in (names, names[::-1]):
        out = quality.cascade(df, order=order, verdict="v")
        assert {r["doc_id"] for r in out.filter("v is null").collect()} == kept
    good = quality.keep_good(df)
    assert good.columns == df.columns and {r["doc_id"] for r in good.collect()} == kept
    costs = quality.rule_costs(df)
    assert {c[0] for c in costs} == set(names) and all(s > 0 and 0 <= r <= 1 for _, s, r in costs)
    assert quality.rule_order([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.0)]) == ["b", "a", "c"]
    assert quality.quality_report(docs([])).count() == 0 and quality.keep_good(docs([])).count() == 0


def test_mix_equals_sql_and_rows_follow_the_report(spark, docs):
    rows = ROWS + [(100 + i, PROSE[: 7 * i % 90], "abZ"[i % 3]) for i in range(90)]
    df = docs(rows).withColumnRenamed("lang", "s").withColumnRenamed("n_chars", "cut__s")
    same(mixing.mix_report(df), MIXING_SQL, rows)
    report = {r["doc_id"]: r for r in mixing.mix_report(df).collect()}
    by_source = {}
    for i, _, s in rows:
        got = by_source.setdefault(s, [0, report[i]["target"], report[i]["source_size"]])
        got[0] += report[i]["taken"]
    assert all(abs(taken - target) <= 0.5 and target <= 2 * size for taken, target, size in by_source.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words.setdefault(r["doc_id"], []).append(r["text"])
    assert {i: sum(len(split(t)) for t in ts) for i, ts in words.items()} == {
        i: r["taken"] for i, r in report.items() if r["taken"]}
    texts = dict((i, t) for i, t, _ in rows)
    assert all(t == texts[i] or " ".join(split(texts[i])).startswith(t) for i, ts in words.items() for t in ts)


def test_mix_edges(spark, docs):
    same_id = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (None, "f g h i", "y"), (2, None, "z")]
    report = mixing.mix_report(docs(same_id)).collect()
    assert len(report) == 5 and all(0 <= r["taken"] <= 2 * r["size"] for r in report)
    assert mixing.mix(docs(same_id)).filter(F.col("source") == "z").count() == 0
    assert mixing.mix_report(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    again = mixing.mix_report(docs(same_id).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, report))


def test_license_scan_equals_containment_of_all_shingles(spark, docs):
    rows = ROWS + [(300 + i, f"{PROSE} {t} {PROSE}", "a") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(400 + i, " ".join(t.split()[:-2]) + " other words", "a") for i, t in enumerate(licenses.TEMPLATES.values())]
    found = same(licenses.scan(docs(rows)), LICENSE_SQL, rows)
    assert {r[0] for r in found} >= {11, 12, *range(300, 300 + len(licenses.TEMPLATES))}
    assert licenses.scan(docs([])).count() == 0
    with pytest.raises(ValueError, match="under 5 words"):
        licenses.scan(docs(ROWS), templates={"short": "MIT License"})
