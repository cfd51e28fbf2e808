import re

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", n) for n in q)


def test_entry(spark):
    out = entry.entry(spark).collect()
    assert len(out) == 5 and sum(r["total"] for r in out) == 1000
