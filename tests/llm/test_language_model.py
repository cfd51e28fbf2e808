import math
import re
import zlib
from collections import Counter

import pytest

from flowmine.llm import language_model as L
from flowmine.llm import pieces as P
from flowmine.llm.queries import QUERIES

VOCAB = P.load_pieces()


def slow(rows):
    """Report of (id, text) rows by plain loops."""
    toks = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        toks.append((i, held, re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]))
    count = Counter(w for _, held, ws in toks if not held for w in ws)
    n, kinds, once = sum(count.values()), len(count), sum(c == 1 for c in count.values())
    u = min(max(once / n, 1 / (n + 1)), 1) if n else 1.0
    out = []
    for i, held, ws in toks:
        base = sum(math.log10((count[w] + 1) / (n + kinds + 1)) for w in ws)
        score = 0.0
        for w in ws:
            sub = VOCAB.end_log_p if w == "\n" else P.total_log_p(P.lattice(VOCAB, " " + w))
            score += math.log10((1 - u) * count[w] / max(n, 1) + u * math.exp(sub)) if sub > -700 else \
                math.log10(u) + sub / math.log(10) if not count[w] else math.log10((1 - u) * count[w] / n)
        out.append((i, held, len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    return out


def assert_equal(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(slow(rows), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query_equals_plain_loops(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert_equal(QUERIES["op7_lm_score"](spark, sf), rows)


def test_missing_and_repeated_ids_do_not_fill_one_chunk(spark, docs):
    rows = [(None, f"text number {k} " * 5) for k in range(200)] + [(4, f"other {k} " * 8) for k in range(200)]
    dealt = L.dealt(docs(rows), "doc_id", "text", L.FOLDS, L.HELD_OUT, 16)
    assert dealt.groupBy("chunk").count().agg({"count": "max"}).first()[0] < 60
    assert_equal(L.score_report(docs(rows), chunk_bytes=1500), rows)


def test_small_chunks_and_edges(spark, docs):
    rows = [(1, "The THE the"), (2, None), (3, " \t"), (4, "ñandú the ▁x " + "a" * 60), (5, "the end"), (5, "the end"),
            (None, "the lone"), (30, "z" * 5000)]
    df = docs(rows).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "held_out")
    for size in (1 << 20, 20):
        assert_equal(L.score_report(df, chunk_bytes=size), rows)
    assert L.score_report(docs([])).count() == 0
    held_only = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert_equal(L.score_report(docs(held_only)), held_only)
