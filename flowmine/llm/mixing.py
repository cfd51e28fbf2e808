"""Mixing sources to target weights.

Every document gets a random key, the MD5 digest of a seed and its id. Within a
source the documents are range-sorted by key: the source is dealt into slices
by the leading digits, slice totals give each slice its offset, and a window in
the slice gives every key the words before it. The key at which a source's
budget is used up is its cut; a document's share then depends on its own row
and its source's cut alone, so texts are never shuffled. A budget above the
source's size takes whole epochs first and cuts the last one.

Targets: sources in code-point order, null last, take the weights in turn; they
share ``share`` times all words; no target exceeds ``max_epochs`` times its
source, and what a capped source leaves is shared again by weight.

Edge cases: a text without words (or null) has size 0 and takes nothing. Rows
that share an id (or all without one) share a key; at the cut they take parts
in proportion to their sizes, rounded down. An empty table gives an empty
result. Clashing column names of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmine.llm.common import stage, unused, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SLICE_DIGITS = 3
#: The table of sources is broadcast up to this many rows and joined beyond it.
BROADCAST_SOURCES = 100_000


def random_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _source_key(source: Column) -> Column:
    """A key without nulls: absent and empty sources differ."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(s, source_size, target) from one row (s, source, source_size) per source."""
    every = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    rows = (sources.withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * max_epochs)
            .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))))
    tightest = Window.partitionBy().orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    onward = tightest.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                           / F.sum("weight").over(onward))
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.max(free).over(every))
    return rows.select("s", "source_size", F.coalesce(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")),
        F.col("cap").cast("double")).alias("target"))


def _sized(docs: DataFrame, id_col: str, source: str, size: Column, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size"),
                       random_key(F.col(id_col), seed).alias("key"), _source_key(F.col(source)).alias("s"))


def source_cuts(sized: DataFrame, **options) -> DataFrame:
    """One row per source: s, source_size, target, epochs, cut_key, cut_take and cut_size."""
    keys = (sized.groupBy("s", "key").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
            .withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    totals = keys.groupBy("s", "slice").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    totals = stage(totals)
    past = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s", "slice", F.coalesce(F.sum("size").over(past), F.lit(0)).alias("offset"))
    sources = totals.groupBy("s").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    goal = targets(sources, **options)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.withColumn("epochs", F.floor(budget / size).cast("long"))
    goal = goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy("s", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    prefix = (keys.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, ["s", "slice"])
              .select("s", "key", "size", (F.col("offset") + F.col("inside")).alias("before")))
    crossing = (prefix.join(goal.select("s", "rest"), "s")
                .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
                .select("s", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_take"),
                        F.col("size").alias("cut_size")))
    return stage(goal.drop("rest").join(crossing, "s", "left"))


def _taken(size: Column, key: Column, cut: dict[str, str]) -> Column:
    """Words that a row of ``size`` words takes, from its source's columns ``cut``."""
    last = (F.when(key < F.col(cut["cut_key"]), size)
            .when(key == F.col(cut["cut_key"]), F.floor(F.col(cut["cut_take"]) * size / F.col(cut["cut_size"])))
            .otherwise(F.lit(0)))
    return (F.col(cut["epochs"]) * size + last).cast("long")


def _bounded(cuts: DataFrame) -> DataFrame:
    """Broadcast behind a check of its size; a larger table is joined by shuffle, with the same result."""
    return F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts


def mix_report(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
               seed: int = 17, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sized = stage(_sized(docs, id_col, source, F.size(words(F.col(text))), seed))
    cuts = source_cuts(sized, **options)
    taken = _taken(F.col("size"), F.col("key"), {c: c for c in cuts.columns})
    return sized.join(_bounded(cuts), "s").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: a row per whole take of a document, and one with its first words for a part.

    A part is its document's first words joined by one space (one key per source is cut).
    """
    sized = stage(_sized(docs, id_col, source, F.size(words(F.col(text))), seed))
    cuts = source_cuts(sized, **options)
    s, take, size, w = (unused(docs, n) for n in ("s", "take_", "size_", "words_"))
    names = docs.columns
    split = docs.withColumn(w, words(F.col(text))).withColumn(size, F.size(w)) \
        .withColumn(s, _source_key(F.col(source)))
    renamed = cuts.select(*[F.col(c).alias(unused(docs, f"cut__{c}")) for c in cuts.columns])
    cols = dict(zip(cuts.columns, renamed.columns))
    joined = split.join(_bounded(renamed), F.col(s) == F.col(cols["s"]))
    taken = _taken(F.col(size), random_key(F.col(id_col), seed), cols)
    whole = F.floor(taken / F.greatest(F.col(size), F.lit(1))).cast("int")
    part = (taken - whole * F.col(size)).cast("int")
    takes = F.concat(F.array_repeat(F.col(size), whole), F.when(part > 0, F.array(part)).otherwise(
        F.array().cast("array<int>")))
    out = joined.withColumn(take, F.explode(takes))
    cut_text = F.when(F.col(take) == F.col(size), F.col(text)).otherwise(
        F.array_join(F.slice(F.col(w), F.lit(1), F.col(take)), " "))
    return out.withColumn(text, cut_text).select(*names)
