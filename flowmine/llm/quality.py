"""Quality rules as a short-circuit cascade.

Each rule rejects a document. On a sample of rows the cost of every rule is
timed and its rejection rate is counted; the rules are then tried in order of
rejections per second, and the first rule that rejects ends the work on that
document. The order changes the time only: a document is kept if no rule
rejects it, whatever the order.

Edge cases: a null or blank text has no words, so all counts are zero and the
rule ``few_words`` rejects it. Repeated rows are judged alike, an empty table
gives an empty result, and columns of the input are never renamed (the added
ones take a name the input does not have).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.llm.common import let, stage, unused, words

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"

Measure = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets ``m(name)``, the column of a measure, and says which documents go."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def _word_chars(text: Column, w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def _n_symbols(text: Column, w: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _n_lines(text: Column, w: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _n_dup_lines(text: Column, w: Column) -> Column:
    return let(_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _n_letter_words(text: Column, w: Column) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long")


def _n_run_words(text: Column, w: Column) -> Column:
    return F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).cast("long")


def _n_repeat_words(text: Column, w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text. Only texts in which
    some hash repeats pay for the sort that finds the positions.
    """
    hashes = F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            at = F.transform(s, lambda e, k: F.when(
                (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"]))
            return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(
                F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ordered, repeated), length)

    return let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)).cast("long"))


MEASURES: dict[str, Measure] = {
    "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols, "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines, "n_letter_words": _n_letter_words, "n_run_words": _n_run_words,
    "n_repeat_words": _n_repeat_words,
}

BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_passages", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15)),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 3),
    Rule("few_letters", lambda m: m("n_letter_words") * 10 < m("n_words") * 7),
    Rule("word_runs", lambda m: m("n_run_words") * 10 > m("n_words") * 3),
)


def rule_costs(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 1000,
               seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejection rate) of each rule on about ``sample_rows`` rows.

    The sample is bounded by ``sample_rows`` and staged once; each rule then runs
    alone over it, and its cost is its time beyond that of splitting the words.
    """
    total = df.count()
    part = df.select(F.col(text).alias("text"))
    if total > sample_rows:
        part = part.sample(fraction=min(1.0, sample_rows / total), seed=seed)
    part = stage(part).withColumn("w", words(F.col("text")))

    def lookup(name: str) -> Column:
        return MEASURES[name](F.col("text"), F.col("w"))

    def timed(*cols: Column) -> tuple[float, list]:
        began = time.perf_counter()
        row = part.agg(*cols).first()
        return time.perf_counter() - began, list(row)

    plain = F.sum(F.size("w"))
    timed(plain)
    floor, _ = timed(plain)
    out = []
    for rule in rules:
        probe = [F.count_if(rule.rejects(lookup)), F.count(F.lit(1))]
        timed(*probe)                                    # the first run compiles
        seconds, (hits, n) = timed(*probe)
        out.append((rule.name, max(seconds - floor, 1e-3), hits / max(n, 1)))
    return out


def rule_order(costs: list[tuple[str, float, float]]) -> list[str]:
    """Rule names, most rejections per second first; ties by name."""
    return [name for name, seconds, rate in sorted(costs, key=lambda c: (-c[2] / c[1], c[0]))]


def cascade(df: DataFrame, rules=RULES, text: str = "text", measured: Mapping[str, str] | None = None,
            order: list[str] | None = None, verdict: str = "rejected_by", sample_rows: int = 1000) -> DataFrame:
    """``df`` with the rule that rejected each row, null for kept ones.

    ``measured`` names columns of ``df`` that already hold a measure; every other
    measure is computed inside the branch of its rule, so a document that an
    earlier rule rejects never pays for it.
    """
    order = order or rule_order(rule_costs(df, rules, text, sample_rows))
    by_name = {r.name: r for r in rules}
    measured = measured or {}

    def chain(w: Column) -> Column:
        def lookup(name: str) -> Column:
            return F.col(measured[name]) if name in measured else MEASURES[name](F.col(text), w)

        out = F.lit(None).cast("string")
        for name in reversed(order):
            out = F.when(by_name[name].rejects(lookup), F.lit(name)).otherwise(out)
        return out

    # The words are bound inside the expression: a filter on the verdict that Spark
    # moves below this projection then still splits each text once.
    return df.withColumn(verdict, let(words(F.col(text)), chain))


def keep_good(df: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with their columns unchanged."""
    verdict = unused(df, "rejected_by_")
    return cascade(df, text=text, verdict=verdict, sample_rows=sample_rows) \
        .filter(F.col(verdict).isNull()).drop(verdict)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   sample_rows: int = 1000) -> DataFrame:
    """Counts, base verdict and verdict of every document, one row each."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    order = rule_order(rule_costs(rows, sample_rows=sample_rows))
    split = rows.withColumn("w", words(F.col("text")))
    full = split.select("doc_id", "text", *[MEASURES[n](F.col("text"), F.col("w")).alias(n) for n in names])
    judged = cascade(full, measured={n: n for n in names}, order=order)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(F.col)
    return judged.select("doc_id", *names, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))
