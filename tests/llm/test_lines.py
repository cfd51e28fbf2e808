import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmine.llm.cuckoo import CuckooFilter
from flowmine.llm.lines import LineIndex, dedup_report

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    return out if len(out) >= 10 else None


def slow(rows):
    """(id, lines, dropped, digest) of rows (id, text), by plain rules."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if (k := key(line)) is not None:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(key(line), set())
            first = min((x for x in ids if x is not None), default=None)
            if len(ids) < 2 or i == first:
                kept.append(line)
        digest = hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SHARED = "this line stands in many documents"
ROWS = [
    (1, f"a\n{SHARED}\nshort\nown line of document one"), (2, f"  {SHARED.upper()}\t\r\nshort\nown line of document two"),
    (3, None), (4, ""), (5, "\n\n"), (6, f"{SHARED}\n{SHARED}\ntwice here, twice here\ntwice here, twice here"),
    (7, "Éléphant blanc\nÉLÉPHANT BLANC\nÉLéphant blanc"), (8, "Éléphant blanc"), (9, "ñandúñandú"), (10, "ñandúñandú\nñandúñand"),
    (11, "ñandúñand"), (12, "word " * 50_000 + "\n" + "\n".join(f"line number {i} of a long text" for i in range(3000))),
    (13, "line number 7 of a long text\nline number 2999 of a long text"), (6, f"another row of six\n{SHARED}"),
    (None, f"{SHARED}\nonly without id, first"), (None, "only without id, first\nline number 8 of a long text"),
    (1, f"a\n{SHARED}\nshort\nown line of document one"), (20, "nul\x00 inside a line\r\nnul\x00 inside a line"),
    (19, "nul\x00 inside a line"), (21, f"\x0b{SHARED}\x0c"), (0, " not a blank of the six \nnot a blank of the six")]


def test_report_equals_plain_rules(spark, docs):
    for batches, keys in ((1, 500_000), (3, 40)):
        assert told(dedup_report(docs(ROWS), batches=batches, shard_keys=keys)) == slow(ROWS)
    assert told(dedup_report(docs([]))) == []
    assert told(dedup_report(docs(ROWS[2:5]))) == slow(ROWS[2:5])


def test_clashing_columns_and_cut(spark, docs):
    df = docs(ROWS).withColumnRenamed("lang", "at").withColumnRenamed("source", "h").withColumnRenamed("n_chars", "line_places")
    index = LineIndex(spark)
    index.insert(df)
    assert told(index.report(df)) == slow(ROWS)
    cut = index.cut(df)
    assert cut.columns == df.columns and cut.count() == len(ROWS)
    want = {(i, d) for i, _, _, d in slow(ROWS)}
    got = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in cut.collect()}
    assert got == want and cut.filter("text is null").count() == 1


def live_keys(index):
    return index.counts().filter("refs > 0").count(), sum(r["size"] for r in index.filters().collect())


def test_insertions_and_deletions_are_reversible(spark, docs):
    few = [(i, "\n".join(f"sentence number {j} of the book" for j in range(i % 7, i % 7 + 30))) for i in range(40)]
    more = [(100 + i, "\n".join(f"sentence number {j} of the book" for j in range(i, i + 45))) for i in range(30)]
    early = [(-1, "sentence number 9 of the book\nsentence number 70 of the book")]
    index = LineIndex(spark, shard_keys=30)
    index.insert(docs(few))
    before, sizes = told(index.report(docs(few))), live_keys(index)
    assert before == slow(few) and sizes[0] == sizes[1]
    index.insert(docs(more))
    index.insert(docs(early))
    everything = few + more + early
    assert told(index.report(docs(everything))) == slow(everything)
    keys = live_keys(index)
    assert keys[0] == keys[1] > sizes[0] and index.state["bits"] > 0
    index = LineIndex.open(spark, index.path, shard_keys=30)
    index.delete(docs(early + [(555, "")]))
    assert told(index.report(docs(few + more))) == slow(few + more)
    index.delete(docs(more))
    assert told(index.report(docs(few))) == before and live_keys(index) == sizes
    index.insert(docs(more), batches=2)                             # they come back
    index.compact()
    assert told(index.report(docs(few + more))) == slow(few + more)
    assert len(set(live_keys(index))) == 1
    index.delete(docs(few + more))
    assert live_keys(index) == (0, 0)
    refs = index.counts().agg(F.sum("refs")).first()[0]
    assert not refs


def test_cuckoo_filter_never_loses_a_key():
    rng = np.random.default_rng(1)
    for expected in (3, 400, 20_000):
        held, live = CuckooFilter(expected), np.zeros(0, np.uint64)
        for step in range(8):
            new = rng.integers(0, 1 << 64, size=int(rng.integers(0, max(2, expected // 6))), dtype=np.uint64)
            held.add(np.concatenate([new, new[:3]]))
            live = np.concatenate([live, new, new[:3]])
            assert held.contains(live).all() and held.size == len(live)
            order = rng.permutation(len(live))
            held = CuckooFilter.from_bytes(held.to_bytes())
            held.remove(live[order[:len(live) // 3]])
            live = live[order[len(live) // 3:]]
            assert held.contains(live).all() and held.size == len(live)
        others = rng.integers(0, 1 << 64, size=50_000, dtype=np.uint64)
        assert held.contains(others).mean() < 0.01
    with pytest.raises(KeyError):
        CuckooFilter(10).remove(np.array([5], np.uint64))
    full = CuckooFilter(4)
    keys = rng.integers(0, 1 << 64, size=3 * full.table.size, dtype=np.uint64)
    full.add(keys)
    assert full.contains(keys).all() and full.room < 0
    full.remove(keys)
    assert full.size == 0
