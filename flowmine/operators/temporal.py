"""Event patterns and transition graphs, and the evidence they give per row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmine.functions.arrays import contains_in_order
from flowmine.operators.windows import event_sequences
from flowmine.session import cut_lineage
from flowmine.settings import TemporalSettings


def frequent_itemsets(sequences: DataFrame, min_support: float = 0.02, max_len: int = 4) -> DataFrame:
    """Sets of up to ``max_len`` events found together in at least a share of the sequences.

    Level by level: two frequent sets that differ in their last event only make a
    candidate, a basket that holds the first of them goes on with the candidates'
    last events that it holds too, and equal baskets count as one with a weight.
    Nothing longer than ``max_len`` is ever counted.
    """
    baskets = sequences.select(F.array_sort(F.array_distinct(F.array_compact("events"))).alias("items"))
    n = baskets.count()
    least = math.ceil(min_support * n)
    baskets = cut_lineage(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("w")))

    def counted(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("items").agg(F.sum("w").alias("cnt")).filter(F.col("cnt") >= max(least, 1))
        return cut_lineage(found)

    # A row is a set within a basket and the basket's events behind it.
    rows = baskets.select("w", F.explode("items").alias("e"), F.col("items").alias("all")).select(
        "w", F.array("e").alias("items"), F.filter("all", lambda x: x > F.col("e")).alias("rest"))
    level = counted(rows)
    out = level
    for _ in range(max_len - 1):
        ends = level.select(F.slice("items", 1, F.size("items") - 1).alias("head"), "items",
                            F.element_at("items", -1).alias("last"))
        more = ends.select("head", F.col("items").alias("_items"), F.col("last").alias("_last"))
        allowed = (ends.join(more, "head").filter(F.col("last") < F.col("_last"))
                   .groupBy("items").agg(F.collect_set("_last").alias("next")))
        rows = (rows.join(allowed, "items")
                .select("w", "items", "rest", F.explode(F.array_intersect("rest", "next")).alias("e"))
                .select("w", F.concat("items", F.array("e")).alias("items"),
                        F.filter("rest", lambda x: x > F.col("e")).alias("rest")))
        level = counted(rows)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("items", "cnt", (F.col("cnt") / F.lit(n)).alias("support"))


def frequent_patterns(sequences: DataFrame, min_support: float = 0.02, max_len: int = 5,
                      top_k: int = 200) -> DataFrame:
    """Ordered patterns (gaps allowed); the ``top_k`` most frequent, short ones first."""
    n = sequences.count()
    steps = sequences.select(F.transform("events", lambda e: F.array(e)).alias("sequence"))
    found = PrefixSpan(minSupport=min_support, maxPatternLength=max_len).findFrequentSequentialPatterns(steps)
    out = found.select(F.flatten("sequence").alias("items"), F.col("freq").alias("cnt"))
    out = out.select("items", F.array_join("items", " -> ").alias("pattern"),
                     F.size("items").alias("length"), "cnt", (F.col("cnt") / F.lit(n)).alias("support"))
    return out.orderBy(F.col("cnt").desc(), "length", "pattern").limit(top_k)


def pattern_support(events: Column, patterns: Sequence[tuple[Sequence[str], float]],
                    scale_by_max: bool = True) -> Column:
    """Largest support among the patterns a sequence contains, over the largest of all.

    ``patterns`` is the fitted top-k list, so the expression is bounded by k.
    """
    if not patterns:
        return F.lit(0.0)
    top = max(s for _, s in patterns) if scale_by_max else 1.0
    table = F.array(*[F.struct(F.array(*[F.lit(e) for e in items]).alias("items"),
                               F.lit(float(s)).alias("support"))
                      for items, s in sorted(patterns, key=lambda p: -p[1])])
    best = F.aggregate(table, F.lit(0.0), lambda acc, p: F.when(
        (p["support"] > acc) & contains_in_order(events, p["items"]), p["support"]).otherwise(acc))
    return F.least(F.lit(1.0), best / F.lit(top if top > 0 else 1.0))


@dataclass
class TransitionGraph:
    """Counts of consecutive events; probabilities follow from them.

    ``edges`` (src, dst, cnt) holds observed pairs only and ``states`` all
    states, so a lookup never needs the full square table.
    """

    states: DataFrame
    edges: DataFrame
    n_states: int
    alpha: float

    # Up to this many states the lookup tables are known to be small.
    BROADCAST_STATES = 1000

    def _side(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.n_states <= self.BROADCAST_STATES else table

    def totals(self) -> DataFrame:
        sums = self.edges.groupBy("src").agg(F.sum("cnt").alias("total"))
        return (self.states.select(F.col("state").alias("src")).join(sums, "src", "left")
                .select("src", F.coalesce("total", F.lit(0)).alias("total")))

    def observed(self) -> DataFrame:
        """Observed pairs with count and smoothed probability, without the square of all states."""
        return self.edges.join(self._side(self.totals()), "src").select(
            "src", "dst", "cnt", ((F.col("cnt") + self.alpha) / (F.col("total") + self.alpha * self.n_states)).alias("prob"))

    def grid(self) -> DataFrame:
        """All pairs of states with count and smoothed probability; meant for few states."""
        names = self.states.agg(F.collect_list("state").alias("all"))
        pairs = self.totals().join(F.broadcast(names)).select("src", "total", F.explode("all").alias("dst"))
        return pairs.join(self.edges, ["src", "dst"], "left").select(
            "src", "dst", F.coalesce("cnt", F.lit(0)).alias("cnt"),
            ((F.coalesce("cnt", F.lit(0)) + self.alpha)
             / (F.col("total") + self.alpha * self.n_states)).alias("prob"))

    def look_up(self, df: DataFrame, prev: str, nxt: str, name: str = "prob") -> DataFrame:
        """P(next | previous); 1/|S| if either is not a known state."""
        known = self.states.select(F.col("state").alias(nxt), F.lit(True).alias("__known"))
        t = self.totals().withColumnRenamed("src", prev)
        e = self.edges.select(F.col("src").alias(prev), F.col("dst").alias(nxt), F.col("cnt").alias("__c"))
        out = (df.join(self._side(t), prev, "left").join(self._side(known), nxt, "left")
               .join(self._side(e), [prev, nxt], "left"))
        p = (F.coalesce("__c", F.lit(0)) + self.alpha) / (F.col("total") + self.alpha * self.n_states)
        return (out.withColumn(name, F.when(F.col("total").isNotNull() & F.col("__known"), p)
                               .otherwise(F.lit(1.0 / max(self.n_states, 1))))
                .drop("total", "__known", "__c"))

    def outgoing(self, classes: Sequence[str]) -> DataFrame:
        """Per state an array of P(class | state), for context lookups."""
        wanted = [str(c) for c in classes]
        in_graph = {r["state"] for r in self.states.filter(F.col("state").isin(wanted)).collect()}
        counts = self.edges.filter(F.col("dst").isin(wanted)).groupBy("src").agg(
            *[F.sum(F.when(F.col("dst") == c, F.col("cnt")).otherwise(0)).alias(f"c{i}")
              for i, c in enumerate(wanted)])
        flat = F.lit(1.0 / max(self.n_states, 1))
        probs = [((F.coalesce(f"c{i}", F.lit(0)) + self.alpha)
                  / (F.col("total") + self.alpha * self.n_states)) if c in in_graph else flat
                 for i, c in enumerate(wanted)]
        table = self.totals().join(counts, "src", "left").select(
            F.col("src").alias("prev_state"), F.array(*probs).alias("context"))
        return self._side(table)


def fit_transitions(sequences: DataFrame, states: Sequence[str] = (), alpha: float = 0.1,
                    self_loops: bool = True) -> TransitionGraph:
    """Count consecutive events; configured states come first, then observed ones."""
    pairs = sequences.select(F.explode(F.arrays_zip(
        F.slice("events", 1, F.size("events") - 1).alias("src"),
        F.slice("events", 2, F.size("events")).alias("dst"))).alias("p")).select("p.src", "p.dst")
    pairs = pairs.filter(F.col("dst").isNotNull())
    if not self_loops:
        pairs = pairs.filter(F.col("src") != F.col("dst"))
    edges = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))
    known = sequences.select(F.explode(F.array_distinct("events")).alias("state")).distinct()
    if states:
        fixed = sequences.sparkSession.createDataFrame([(s,) for s in states], "state string")
        known = known.union(fixed).distinct()
    # Both are small beside the sequences, and every lookup reads them several times.
    known, edges = cut_lineage(known), cut_lineage(edges)
    return TransitionGraph(known, edges, known.count(), float(alpha))


def path_consistency(sequences: DataFrame, unit: str, graph: TransitionGraph, min_events: int = 2,
                     scale: str = "states") -> DataFrame:
    """Mean transition probability along each path, and whether it has a path.

    ``scale="states"`` multiplies by the number of states and clips at 1;
    ``"none"`` leaves the mean as it is.
    """
    pairs = sequences.filter(F.size("events") >= 2).select(unit, F.explode(F.arrays_zip(
        F.slice("events", 1, F.size("events") - 1).alias("a"),
        F.slice("events", 2, F.size("events")).alias("b"))).alias("p")).select(unit, "p.a", "p.b")
    # Fold equal steps of a unit first: fewer rows to look up.
    steps = pairs.groupBy(unit, "a", "b").agg(F.count(F.lit(1)).alias("times"))
    means = graph.look_up(steps, "a", "b").groupBy(unit).agg(
        (F.sum(F.col("prob") * F.col("times")) / F.sum("times")).alias("mean"))
    factor = float(graph.n_states) if scale == "states" else 1.0
    return (sequences.join(means, unit, "left").select(
        unit, F.when(F.col("mean").isNull(), 0.0).otherwise(
            F.greatest(F.least(F.col("mean") * factor, F.lit(1.0)), F.lit(0.0))).alias("tc"),
        F.when(F.size("events") >= min_events, 1.0).otherwise(0.0).alias("availability")))


@dataclass
class TemporalModel:
    """Patterns and transitions mined from train sequences."""

    patterns: list[tuple[list[str], float]]
    pattern_table: DataFrame
    itemsets: DataFrame
    graph: TransitionGraph
    settings: TemporalSettings

    def evidence(self, df: DataFrame, unit: str, ts: str, tie: Sequence[str], event: str) -> DataFrame:
        """Add ``sp``, ``tc`` and ``availability`` of the row's unit; 0 where unknown."""
        # Support, consistency and availability each read the sequences.
        seqs = cut_lineage(event_sequences(df, unit, ts, tie, F.col(event), self.settings.max_sequence_length))
        return attach_evidence(df, unit, seqs, self.patterns, self.graph, self.settings.min_events)


def attach_evidence(df: DataFrame, unit: str, sequences: DataFrame, patterns, graph: TransitionGraph,
                    min_events: int = 2) -> DataFrame:
    sp = sequences.select(unit, "events", pattern_support(F.col("events"), patterns).alias("sp"))
    tc = path_consistency(sequences, unit, graph, min_events)
    scores = sp.drop("events").join(tc, unit)
    out = df.join(scores, unit, "left")
    for c in ("sp", "tc", "availability"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out


def mine_temporal(train: DataFrame, unit: str, ts: str, tie: Sequence[str], event: str,
                  settings: TemporalSettings = TemporalSettings(), states: Sequence[str] = (),
                  stage=lambda d: d) -> TemporalModel:
    """Mine itemsets, ordered patterns and transitions from train rows."""
    seqs = stage(event_sequences(train, unit, ts, tie, F.col(event), settings.max_sequence_length))
    items = frequent_itemsets(seqs, settings.itemset_min_support, settings.itemset_max_len)
    pats = frequent_patterns(seqs, settings.pattern_min_support, settings.pattern_max_len,
                             settings.top_k_patterns)
    # At most top_k_patterns rows.
    table = [(list(r["items"]), float(r["support"])) for r in pats.collect()]
    graph = fit_transitions(seqs, states, settings.laplace_alpha, settings.self_loops)
    return TemporalModel(table, pats, items, graph, settings)
