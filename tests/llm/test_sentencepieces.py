import math
import random

import pytest

from flowmine.llm import pieces as P
from flowmine.llm import sentencepieces as S
from flowmine.llm.queries import QUERIES
from flowmine.llm.trellis import Trellis

VOCAB = P.load_pieces()


def all_paths(text):
    """(score, ids) of every segmentation of a short text, by plain recursion."""
    shown = " " + text
    edges = P.lattice(VOCAB, shown)

    def walk(i):
        if i == len(shown):
            return [(0.0, ())]
        return [(s + rest, ids + more) for j, s, ids in edges[i] for rest, more in walk(j)]
    return sorted(walk(0), key=lambda x: -x[0])


def applied(row):
    """Score and ids of each path of an encoded row, best first."""
    out = [(row["score"], list(row["ids"]))]
    for alt in row["alternatives"]:
        ids = list(row["ids"])
        for e in sorted(alt["edits"], key=lambda e: -e["at"]):
            ids[e["at"]:e["at"] + e["n"]] = e["ids"]
        out.append((alt["score"], ids))
    return out


def test_nbest_equals_all_paths(spark, docs):
    texts = ["a", "to be", "the ne\nxt", "  two", "ñé▁x", "日 a", "aaa aaa", "\n\n", "x\t y"]
    rows = S.encode(docs(list(enumerate(texts))), n=6).collect()
    for r in rows:
        want = all_paths(texts[r["doc_id"]])
        got = applied(r)
        scores = {ids: s for s, ids in want}
        assert len(got) == min(6, len(want)) and r["n_pieces"] == len(r["ids"])
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:len(got)]])
        assert all(scores[tuple(ids)] == pytest.approx(s) for s, ids in got)
        assert len({tuple(ids) for _, ids in got}) == len(got) and r["round_trip"]


def test_scores_equal_the_library(tmp_path):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(P.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.piece in VOCAB.log_p:
            p.score = VOCAB.log_p[p.piece]
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rnd = random.Random(5)
    text = [" ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(1, 9))) for _ in range(6)) for _ in range(40)]
    trellis = Trellis(VOCAB)
    for t in text:
        ours = sum(S._best(trellis, S.units_of(t))[2])
        best = lib.encode(t, out_type=str)
        assert sum(VOCAB.log_p[p] for p in best) == pytest.approx(ours, abs=1e-3)
        scores = [sum(VOCAB.log_p[p] for p in way) for way in lib.nbest_encode_as_pieces(t, 4)]
        _, _, _, alts = S._encode_all([t], trellis, 4)
        assert [a["score"] for a in alts.to_pylist()[0]] == pytest.approx(scores[1:], abs=1e-3)


def test_path_sums():
    units = [" to", " the", "\n", " ñx", " abab", " 日本", "   z", "▁"]
    for unit, got in zip(units, Trellis(VOCAB).log_sums(units)):
        edges = P.lattice(VOCAB, unit)

        def walk(i):
            return 1.0 if i == len(unit) else sum(math.exp(s) * walk(j) for j, s, _ in edges[i])
        assert got == pytest.approx(math.log(walk(0))) == pytest.approx(P.total_log_p(edges))


def test_edges(spark, docs):
    long = "wörd" * 30_000 + " tail " + "▁\t\x00😀" * 5
    texts = [None, "", " ", "\n", "word", "word", long, "a\r\nb  c "]
    out = {r["doc_id"]: r for r in S.encode(docs(list(enumerate(texts)))).collect()}
    assert out[0]["n_pieces"] == out[1]["n_pieces"] == 0 and out[0]["score"] == 0 and out[0]["alternatives"] == []
    assert all(r["round_trip"] for r in out.values()) and out[4]["ids"] == out[5]["ids"]
    assert S.encode(docs([])).count() == 0
    encoded = S.encode(docs(list(enumerate(texts)))).select("doc_id", "ids")
    back = {r["doc_id"]: r["text"] for r in S.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert S.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["text"] is None


def test_query_keeps_every_document_and_round_trips(spark, sf):
    out = QUERIES["op1_sentencepiece"](spark, sf).collect()
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    raw = VOCAB.bytes_of()
    assert len(out) == len(want) and all(r["round_trip"] for r in out)
    for r in out[:40]:
        for score, ids in applied(r):
            assert b"".join(raw[i] for i in ids)[1:].decode() == want[r["doc_id"]]
        scores = [s for s, _ in applied(r)]
        assert scores == sorted(scores, reverse=True)
