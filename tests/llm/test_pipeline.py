import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from flowmine.llm.common import stage
from flowmine.llm.queries import MIXING_SQL, QUALITY_SQL

from .test_quality_mixing_licenses import split
from .test_simhash import slow_components, slow_print
from .test_substrings import slow


def test_each_stage_against_a_plain_version(spark, sf):
    docs = stage(spark.read.parquet(f"{sf}/documents.parquet"))
    names, columns = [n for n, _ in P.STAGES], docs.columns
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mix", "sentencepiece"]
    con = duckdb.connect()

    def table(df):
        con.register("frame", df.toPandas())
        con.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM frame")

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    table(docs)
    good = stage(P.quality_rules(spark, docs, sf))
    ids = {r[0] for r in con.execute(f"SELECT doc_id FROM ({QUALITY_SQL}) WHERE kept").fetchall()}
    assert rows(good) == [r for r in rows(docs) if r[0] in ids] and 0 < len(ids) < docs.count()

    single = stage(P.simhash_near_dedup(spark, good, sf))
    roots = slow_components({r["doc_id"]: slow_print(r["text"]) for r in sorted(good.collect())})
    assert rows(single) == [r for r in rows(good) if roots[r[0]] == r[0]] and single.count() < good.count()

    cut = stage(P.substring_dedup(spark, single, sf))
    want = {r[0]: r for r in slow([(r["doc_id"], r["text"]) for r in single.collect()], 20)}
    before = {r["doc_id"]: r for r in single.collect()}
    assert cut.columns == columns and cut.count() == single.count()
    for r in cut.collect():
        i, n, gone, digest = want[r["doc_id"]]
        assert len(split(r["text"])) == n - gone and r["n_chars"] == len(r["text"])
        assert slow([(i, r["text"])], 10 ** 9)[0][3] == digest
        assert gone or r["text"] == before[i]["text"]

    table(cut)
    mixed = stage(P.source_mix(spark, cut, sf))
    assert mixed.columns == columns
    taken = dict(con.execute(f"SELECT doc_id, taken FROM ({MIXING_SQL}) WHERE taken > 0").fetchall())
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(split(r["text"]))
    assert words == taken

    last = P.sentencepiece(spark, mixed, sf).collect()
    assert len(last) == mixed.count() and all(r["round_trip"] for r in last)
    whole = P.run(spark, sf)
    assert sorted((r["doc_id"], r["n_pieces"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_pieces"]) for r in last)


PROSE = ("Seven wise owls watched from a tall old oak tree while the quick brown fox jumped over some lazy dogs near "
         "the river, and {} more people came along the road to look at them before it was dark that evening.")


def edge_rows():
    """Good documents with null and repeated ids, repeated rows, a null and a very long text."""
    good = [PROSE.format(w) for w in ("twelve", "nine hundred strangely dressed", "no")]
    varied = " ".join(f"x{a}y{b} word{a * 7 + b} and" for a in range(120) for b in range(90))
    return [(1, good[0], "a"), (1, good[0], "a"), (1, "Quite another text: " + good[1], "b"), (None, good[2], None),
            (None, good[2], None), (None, None, "a"), (2, None, "a"), (3, "", "b"), (4, varied, "c"), (4, varied, "c"), (5, good[0], "b")]


def test_edges_of_every_stage(spark, docs):
    df = docs(edge_rows())
    clash = df.selectExpr("*", "1 as w", "2 as id", "3 as fp", "4 as chunk_", "5 as cut_", "6 as rejected_by_", "7 as head_id",
                          "8 as source_size", "9 as n_pieces", "10 as part")
    empty = docs([])
    for name, step in P.STAGES:
        out = step(spark, stage(clash), "")
        n = out.count()
        assert step(spark, empty, "").count() == 0, name
        if name != "sentencepiece":
            assert out.columns == clash.columns, name
            seen = {tuple(r) for r in clash.drop("text", "n_chars").collect()}
            assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= seen, name
        if name == "quality_rules":
            assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 1, 1, 4, 4, 5, None, None], key=str)
        if name == "simhash_near_dedup":
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len(kept) == len(set(kept)) and (4, edge_rows()[8][1]) in kept and sum(i == 1 for i, _ in kept) == 2
        if name == "substring_dedup":
            assert n == len(edge_rows()) and out.filter("text is null").count() == 2
            assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
        if name == "sentencepiece":
            assert n == len(edge_rows()) and all(r["round_trip"] for r in out.collect())
    for rows in (edge_rows(), [(1, None, None)], []):
        now = docs(rows)
        for _, step in P.STAGES:
            now = stage(step(spark, now, ""))
        assert now.count() > 3 if len(rows) > 1 else now.count() == 0
    slim = df.drop("n_chars", "lang")
    for name, step in P.STAGES[:-1]:
        assert step(spark, slim, "").columns == slim.columns, name
