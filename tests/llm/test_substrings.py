import hashlib
import re

import numpy as np

from flowmine.llm import substrings as S
from flowmine.llm.chunks import pack_sorted, range_chunks, text_bytes, unpack_sorted


def slow(rows, window):
    """(n_words, n_removed, digest) of (id, text) rows, from a plain set of windows seen."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r)[:4] for r in df.collect()], key=str)


def test_against_plain_windows_in_small_chunks(spark, docs):
    rng = np.random.default_rng(1)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(list("abcdefgh"), 15)) for _ in range(4)]
        parts.insert(2, passages[i % 5])
        rows.append((int(rng.integers(-50, 50)) * 10 ** 12 + i, "\n".join(parts)))
    rows += [(7, "x y " * 40), (None, rows[0][1]), (None, None), (8, None), (9, " \t"), (10, "z" * 100_000 + " q " * 3000),
             (11, rows[3][1]), (11, rows[3][1])]
    for window, size in ((20, 1 << 20), (20, 900), (5, 2000)):
        got = S.removal_report(docs(rows), window=window, chunk_bytes=size)
        assert rows_of(got) == slow([(r[0], r[1]) for r in rows], window)
    for r in S.removal_report(docs(rows), chunk_bytes=900).collect():
        assert sum(e["stop"] - e["start"] for e in r["intervals"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["intervals"], r["intervals"][1:]))


def test_missing_and_repeated_ids_are_dealt_further(spark, docs):
    rng = np.random.default_rng(3)
    passages = [" ".join(f"p{k}w{i}" for i in range(24)) for k in range(4)]
    texts = [" ".join(rng.choice(list("abcdefgh"), 15)) + f" {passages[k % 4]} n{k}" for k in range(240)]
    ids = [None] * 80 + [7] * 80 + list(range(-30, 50))
    rows = [(i, t) for i, t in zip(ids, texts)] + [(7, None), (None, None), (None, ""), (7, texts[100])]
    df = docs(rows)
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    assert all(S.text_hash(r["text"]) == r["h"] for r in hashed)
    total, size = text_bytes(df), 2000
    chunks = range_chunks(df, "doc_id", "c", total, size).selectExpr("doc_id", "c", "xxhash64(text) AS h", "text").collect()
    held = {}
    for r in chunks:
        held[r["c"]] = held.get(r["c"], 0) + len(r["text"] or "")
    assert len(chunks) == len(rows) and max(held.values()) < 3 * size
    order = sorted(chunks, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    assert [r["c"] for r in order] == sorted(r["c"] for r in chunks)
    # The plain version walks ids by rank; ranks follow (id, hash of the text).
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, S.text_hash(r[1]), r[1] or ""))
    want = sorted((w[1:] for w in slow([(k, t) for k, (_, t) in enumerate(ranked)], 20)), key=str)
    got = sorted((r[1:] for r in rows_of(S.removal_report(df, chunk_bytes=size))), key=str)
    assert got == want


def test_cut_keeps_other_columns_and_separators(spark, docs):
    passage = " ".join(f"w{i}" for i in range(25))
    df = docs([(1, f"Start,\n{passage}\nend."), (2, f"Other \t{passage}\nend  here"), (3, None)])
    df = df.withColumnRenamed("lang", "chunk_")
    out = S.cut_repeats(df)
    assert out.columns == [*df.columns, "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["chunk_"]) for r in out.collect()}
    assert got == {1: (f"Start,\n{passage}\nend.", 0, "en"), 2: ("Other \tend  here", 25, "en"), 3: (None, 0, "en")}


def test_empty_and_packing(spark, docs):
    assert S.removal_report(docs([])).count() == 0 and S.cut_repeats(docs([])).count() == 0
    for values in ([5], [0, 2 ** 64 - 1], [1, 2, 3, 2 ** 63], sorted(np.random.default_rng(0).integers(0, 2 ** 63, 999))):
        a = np.array(values, np.uint64)
        assert (unpack_sorted(pack_sorted(a)) == a).all()
    w = np.random.default_rng(2).integers(0, 2 ** 63, 50).astype(np.uint64)
    w[30:42] = w[5:17]
    h = S.window_hashes(w, 12)
    assert h[30] == h[5] and len(set(h.tolist())) == len(h) - 1
