import math
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowmine.llm import ranked
from flowmine.llm.queries import QUERIES, RANKED_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def slow(rows, items, k=10):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, tokens, df = len(docs), sum(len(w) for _, w in docs), {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in docs:
            m = 10 + (90 * len(w) * n) // tokens
            score = 0
            for t in set(terms(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(spark, docs, rows, items, **options):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(docs(rows), asked, **options).collect()), key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "x1"]
    share = 1.0 / np.arange(1, len(words) + 1)
    draw = lambda size: " ".join(rng.choice(words, size=size, p=share / share.sum()))      # noqa: E731
    rows = [(int(i), draw(int(rng.integers(1, 40)))) for i in rng.permutation(n)]
    rows += [(n + i, rows[3][1]) for i in range(15)]                                      # copies tie
    return rows, [(j, draw(int(rng.integers(1, 25)))) for j in range(12)]


def test_equals_scores_of_all_documents(spark, docs):
    rows, items = corpus(3, 300)
    want = slow(rows, items)
    assert run(spark, docs, rows, items) == want
    assert run(spark, docs, rows, items, postings=60, most_docs=9) == want        # many segments
    assert run(spark, docs, rows, items, query_bytes=200) == want                # many blocks of queries
    assert run(spark, docs, rows, items, k=3) == slow(rows, items, 3)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, " .,;\x00 "), (4, "Été été ÉTÉ"), (5, "a-b_c a"), (5, "a-b_c a"), (None, "a b"), (None, "a"),
            (6, "word " * 60_000 + "rare"), (7, "ALL CAPS Été"), (8, "x y z")]
    items = [(1, "a"), (1, "b a a"), (2, None), (3, ""), (4, "absent"), (5, "été Été"), (6, "RARE word"), (7, "x"), (8, "x y"),
             (None, "caps")]
    assert run(spark, docs, rows, items) == slow(rows, items)
    assert run(spark, docs, [], items) == run(spark, docs, rows, []) == run(spark, docs, rows[:3], items) == []
    clash = docs(rows).withColumnRenamed("lang", "query").withColumnRenamed("source", "rank").withColumn("item_id", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("score", F.lit(1))
    assert sorted((tuple(r) for r in ranked.search(clash, asked).collect()), key=str) == slow(rows, items)


def test_equals_sql(spark, docs):
    rows, items = corpus(8, 200)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({RANKED_SQL})").fetchall(), key=str)
    assert run(spark, docs, rows, items) == want == slow(rows, items)


def test_range_maxima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 20, size=300)
    table = ranked.SparseTable(values, 300)
    low = rng.integers(0, 300, size=500)
    high = low + 1 + (rng.random(500) * (300 - low)).astype(int)
    high = np.minimum(high, 300)
    assert table.places(low, high).tolist() == [a + int(values[a:b].argmax()) for a, b in zip(low.tolist(), high.tolist())]


def test_bounds_drop_most_of_a_segment(spark, docs):
    """One document holds the query; few others are scored in full."""
    rng = np.random.default_rng(5)
    n, kinds = 4000, 50
    doc = np.repeat(np.arange(n), 8)
    term = np.concatenate([rng.choice(kinds, 8, replace=False) for _ in range(n)])
    tf = np.ones(len(doc), np.int64)
    query = np.arange(12)
    keep = doc != 77
    doc = np.concatenate([doc[keep], np.repeat(77, 12)])
    term, tf = np.concatenate([term[keep], query]), np.concatenate([tf[keep], np.full(12, 5)])
    df = np.bincount(term, minlength=kinds)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    order = np.lexsort((term, doc))
    segment = ranked.Segment(list(range(n)), np.full(n, 8), doc[order], term[order], tf[order], weights, n, 8 * n)
    sums = np.zeros(n, np.int64)
    inside = np.isin(term, query)
    np.add.at(sums, doc[inside], ranked.impacts(weights[term[inside]], tf[inside], np.full(inside.sum(), 8), n, 8 * n))
    got = sorted(((s, segment.ids[p]) for s, p in segment.top(query, 1)), reverse=True)
    assert got[0] == (sums.max(), 77) and int(sums.argmax()) == 77


def test_query_covers_every_item(spark, sf):
    out = QUERIES["op12_ranked_search"](spark, sf).collect()
    items = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r["item_id"] for r in out} == items and max(r["rank"] for r in out) == 10
