import random

import numpy as np
import xxhash

from flowmine.llm import simhash
from flowmine.llm.components import connected_components
from flowmine.llm.queries import QUERIES


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash_near_dedup"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in sorted(docs)}
    want = slow_components(prints)
    assert len(got) == len(docs)
    assert all(int(got[i]["fingerprint"], 16) == p and got[i]["component_id"] == want[i] for i, p in prints.items())


def test_links_of_dense_and_far_fingerprints_in_runs_and_blocks(spark):
    rnd = random.Random(3)
    prints = {0}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in set(rnd.choices(range(64), k=rnd.randint(0, 5)))))
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = slow_components({p: p & (2 ** 64 - 1) for p in signed})
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(p)
    for run in (20_000, 6):
        found = connected_components(simhash.fingerprint_links(df, run)).collect()
        comps = {}
        for node, root in found:
            comps.setdefault(root, set()).add(node)
        assert sorted(map(sorted, comps.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_edges(spark, docs):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(5, None), (3, " \t\n"), (7, "one two"), (8, "ONE\x0btwo"), (9, long), (9, long), (None, long), (None, "lone")]
    out = simhash.near_duplicates(docs(rows)).collect()
    assert len(out) == len(rows)
    by = {(r["id"], r["fp"]): r["component_id"] for r in out}
    assert by[(5, 0)] == 3 and by[(3, 0)] == 3
    assert by[(8, simhash.fingerprint("one two"))] == 7
    assert by[(None, simhash.fingerprint(long))] == 9 and by[(None, simhash.fingerprint("lone"))] is None
    assert simhash.near_duplicates(docs([])).count() == 0
    extra = docs(rows).withColumn("fp", F_lit()).withColumn("component_id", F_lit()).withColumn("id", F_lit())
    kept = simhash.keep_representatives(extra)
    assert kept.columns == extra.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 7, 9]


def test_one_representative_with_missing_and_repeated_ids(spark, docs):
    a, b, c = "one two three four five", "six seven eight nine ten", "red green blue black white"
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b.upper()), (4, c), (1, c), (5, "alone here"), (5, a)]
    kept = simhash.keep_representatives(docs(rows)).collect()
    got = sorted((r["doc_id"] or 0, simhash.fingerprint(r["text"])) for r in kept)
    assert got == sorted([(1, simhash.fingerprint(a)), (0, simhash.fingerprint(b)), (1, simhash.fingerprint(c)),
                          (5, simhash.fingerprint("alone here"))])
    assert simhash.keep_representatives(docs([])).count() == 0


def F_lit():
    from pyspark.sql import functions as F
    return F.lit("x")


def test_components_of_paths_and_loops(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = dict(connected_components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
