"""Feature redundancy, ranking and votes over ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmine.operators import rankers, redundancy, selection
from flowmine.operators.fitted import Preprocessor
from flowmine.queries.common import query
from flowmine.session import cut_lineage
from flowmine.settings import Recipe, SelectionSettings
from flowmine.sources.views import (EVENT_CLASSES, EVENT_FLOWS_SQL, LINE_CLASSES, LINE_FLOWS_SQL, event_flows,
                                    line_flows)

FEATURES = ["quantity", "price", "discount", "tax"]
WIDE = ["quantity", "price", "discount", "tax", "quantity_copy", "constant", "price_like"]
SMALL = SelectionSettings(rfi_trees=20, boost_rounds=5, boost_depth=3, shap_trees=5, probe_trees=20, top_k=3,
                          vote_threshold=2, n_grid=(1, 2, 3))


def scaled(spark, sf):
    """Line rows scaled to [0, 1] with an integer class ``y``."""
    d = line_flows(spark, sf)
    y = (F.array_position(F.array(*[F.lit(c) for c in LINE_CLASSES]), F.col("label")) - 1).cast("int")
    p = Preprocessor(FEATURES).fit(d)
    return p.transform(d.withColumn("y", y), ["row_id", "label", "y"])


_SCALED = LINE_FLOWS_SQL + """,
m AS (SELECT min(quantity) a1, max(quantity) b1, min(price) a2, max(price) b2, min(discount) a3, max(discount) b3,
  min(tax) a4, max(tax) b4 FROM lines),
sc AS (SELECT row_id, label, (quantity - a1) / (b1 - a1) AS quantity, (price - a2) / (b2 - a2) AS price,
  (discount - a3) / (b3 - a3) AS discount, (tax - a4) / (b4 - a4) AS tax FROM lines, m),
lg AS (UNPIVOT sc ON quantity, price, discount, tax INTO NAME feature VALUE x)
"""


@query("feature_variance", f"""
WITH {LINE_FLOWS_SQL}, lg AS (UNPIVOT (SELECT quantity, price, discount, tax, quantity_copy, constant FROM lines)
  ON quantity, price, discount, tax, quantity_copy, constant INTO NAME feature VALUE x)
SELECT feature, round(var_pop(x), 3) AS variance, var_pop(x) <= 1e-5 AS dropped FROM lg GROUP BY feature""")
def _variance(spark, sf):
    v = redundancy.variances(line_flows(spark, sf), WIDE[:-1])
    return spark.createDataFrame([(c, x) for c, x in v.items()], "feature string, v double").select(
        "feature", F.round("v", 3).alias("variance"), (F.col("v") <= 1e-5).alias("dropped"))


@query("duplicate_columns", f"""
WITH {LINE_FLOWS_SQL}
SELECT 'quantity_copy' AS feature, 'quantity' AS partner FROM lines
HAVING count(*) FILTER (quantity IS DISTINCT FROM quantity_copy) = 0""")
def _dups(spark, sf):
    d = line_flows(spark, sf)
    f = redundancy.RedundancyFilter(SelectionSettings(spearman_threshold=1.0)).fit(d, WIDE, "row_id")
    return f.report(d).filter("reason = 'duplicate'").select("feature", "partner")


@query("rank_correlation", f"""
WITH {LINE_FLOWS_SQL},
r AS (SELECT {', '.join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in (*FEATURES, 'price_like'))} FROM lines)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for i, a in enumerate((*FEATURES, 'price_like')) for b in (*FEATURES, 'price_like')[i + 1:])}""")
def _spearman(spark, sf):
    cols = [*FEATURES, "price_like"]
    m = redundancy.rank_correlation(line_flows(spark, sf), cols)
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(cols)
                                  for j, b in enumerate(cols) if j > i], "a string, b string, rho double")


@query("redundancy_report", f"""
WITH {LINE_FLOWS_SQL},
v AS (SELECT var_pop(constant) AS c, count(*) FILTER (quantity <> quantity_copy) AS d FROM lines),
r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY price_like) + (count(*) OVER (PARTITION BY price_like) - 1) / 2.0 AS b FROM lines)
SELECT 'constant' AS feature, 'low_variance' AS reason, CAST(NULL AS VARCHAR) AS partner FROM v WHERE c <= 1e-5
UNION ALL SELECT 'quantity_copy', 'duplicate', 'quantity' FROM v WHERE d = 0
UNION ALL SELECT 'price_like', 'spearman', 'price' FROM r HAVING abs(corr(a, b)) > 0.95""")
def _redundancy(spark, sf):
    d = line_flows(spark, sf)
    return redundancy.RedundancyFilter().fit(d, WIDE, "row_id").report(d).select("feature", "reason", "partner")


@query("rank_mean_median", f"WITH {_SCALED} SELECT feature, round(abs(avg(x) - median(x)), 6) AS score FROM lg GROUP BY feature")
def _dmm(spark, sf):
    return rankers.rank_mean_median(scaled(spark, sf), FEATURES, "y", "row_id").select(
        "feature", F.round("score", 6).alias("score"))


@query("rank_deviation", f"WITH {_SCALED} SELECT feature, round(stddev_pop(x), 6) AS score FROM lg GROUP BY feature")
def _sd(spark, sf):
    return rankers.rank_deviation(scaled(spark, sf), FEATURES, "y", "row_id").select(
        "feature", F.round("score", 6).alias("score"))


@query("rank_pearson", f"""
WITH {_SCALED}, c AS (SELECT feature, k, abs(corr(x, CASE WHEN label = k THEN 1 ELSE 0 END)) AS r
  FROM lg, (SELECT unnest(['N','R','A']) AS k) GROUP BY feature, k)
SELECT feature, round(max(r), 6) AS score FROM c GROUP BY feature""")
def _pcc(spark, sf):
    return rankers.rank_pearson(scaled(spark, sf), FEATURES, "y").select("feature", F.round("score", 6).alias("score"))


@query("rank_information_binned", f"""
WITH {_SCALED},
q AS (SELECT feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lg GROUP BY feature),
b AS (SELECT feature, label, len([v FOR v IN e IF v < x]) AS bin FROM lg JOIN q USING (feature)),
j AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY feature, bin, label),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb,
  sum(n) OVER (PARTITION BY feature, label) AS ny FROM j)
SELECT feature, round(sum(n / t * ln((n / nb) * (t / ny))), 6) AS score FROM t GROUP BY feature""")
def _mib(spark, sf):
    return rankers.binned_information(scaled(spark, sf), FEATURES, "label").select(
        "feature", F.round("score", 6).alias("score"))


def _event_scaled(spark, sf):
    e = event_flows(spark, sf)
    y = (F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("label")) - 1).cast("int")
    d = e.withColumn("y", y).withColumn("shift", F.col("y") * 40 + F.col("k"))
    p = Preprocessor(["value", "k", "hour", "shift"]).fit(d)
    return p.transform(d, ["row_id", "y", "ts", "user_id"])


EVENT_FEATURES = ["value", "k", "hour", "shift"]


def _digamma_sql(n: str) -> str:
    x, e = f"(CAST({n} AS DOUBLE) + 6.0::DOUBLE)", "::DOUBLE"
    y = f"(1.0{e} / ({x} * {x}))"
    inner = f"{1 / 12.0!r}{e} - {y} * ({1 / 120.0!r}{e} - {y} / 252.0{e})"
    steps = "".join(f" - 1.0{e} / (CAST({n} AS DOUBLE) + {i}.0{e})" for i in range(6))
    return f"(ln({x}) - 0.5{e} / {x} - {y} * ({inner}){steps})"


_NEIGHBOURS_SQL = f"""
WITH {EVENT_FLOWS_SQL},
f AS (SELECT row_id AS r, list_position({EVENT_CLASSES}, label) - 1 AS y, value, k, hour FROM flows),
g AS (SELECT r, y, coalesce(value, median(value) OVER ()) AS value, coalesce(k, median(k) OVER ()) AS k, hour,
  CAST(y * 40 + k AS DOUBLE) AS shift0 FROM f),
h AS (SELECT r, y, value, k, hour, coalesce(shift0, median(shift0) OVER ()) AS shift FROM g),
m AS (SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) AS b_{c}' for c in EVENT_FEATURES)} FROM h),
sc AS (SELECT r, y, {', '.join(f'({c} - a_{c}) / (b_{c} - a_{c}) AS {c}' for c in EVENT_FEATURES)} FROM h, m),
lg AS (UNPIVOT sc ON {', '.join(EVENT_FEATURES)} INTO NAME feature VALUE x),
sz AS (SELECT y, count(*) AS ny FROM f GROUP BY y HAVING count(*) > 1),
p AS (SELECT feature, r, x, ny, least(3, ny - 1) AS kk, list_sort(list_filter(
    [{', '.join(f'abs(x - {w}(x, {i}) OVER w)' for i in (1, 2, 3) for w in ('lag', 'lead'))}], lambda v: v IS NOT NULL))[least(3, ny - 1)] AS d
  FROM lg JOIN sz USING (y) WINDOW w AS (PARTITION BY feature, y ORDER BY x, r)),
v AS (SELECT feature, x AS v, count(*) AS c FROM p GROUP BY feature, x),
n AS (SELECT p.feature, p.r, sum(c) AS m FROM p JOIN v ON p.feature = v.feature
  AND v.v >= p.x - p.d AND v.v <= p.x + p.d AND (p.d = 0 OR (v.v > p.x - p.d AND v.v < p.x + p.d)) GROUP BY p.feature, p.r),
t AS (SELECT feature, count(*) AS n, avg({_digamma_sql('kk')}) AS a, avg({_digamma_sql('ny')}) AS b, avg({_digamma_sql('m')}) AS c
  FROM p JOIN n USING (feature, r) GROUP BY feature)
SELECT feature, CAST(list_position({EVENT_FEATURES}, feature) - 1 AS INTEGER) AS pos,
  round(greatest(0.0::DOUBLE, {_digamma_sql('n')} + a - b - c), 6) AS score FROM t"""


@query("rank_information_neighbours", _NEIGHBOURS_SQL)
def _mi(spark, sf):
    return rankers.RANKERS["mi"](_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id").select(
        "feature", "pos", F.round("score", 6).alias("score"))


@query("rank_forest")
def _rfi(spark, sf):
    return rankers.RANKERS["rfi"](_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id", SMALL)


@query("rank_boosting_gain")
def _gain(spark, sf):
    return rankers.RANKERS["boost"](_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id", SMALL)


@query("rank_shapley")
def _shap(spark, sf):
    return rankers.RANKERS["shap"](_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id", SMALL)


@query("rank_permutation")
def _perm(spark, sf):
    return rankers.RANKERS["pi_svm"](_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id", SMALL)


@query("rank_sequence_gradient")
def _seqrank(spark, sf):
    return rankers.rank_sequence(_event_scaled(spark, sf), EVENT_FEATURES, "y", "row_id",
                                 SelectionSettings(window=4), 42, "user_id", "ts")


@query("rank_pca")
def _pca(spark, sf):
    return rankers.rank_pca(scaled(spark, sf), FEATURES)


def vote_scores(spark, sf):
    d = scaled(spark, sf)
    return selection.union_scores({
        "dmm": rankers.rank_mean_median(d, FEATURES, "y", "row_id"),
        "sd": rankers.rank_deviation(d, FEATURES, "y", "row_id"),
        "pcc": rankers.rank_pearson(d, FEATURES, "y")})


_VOTES = _SCALED + """,
p0 AS (SELECT unnest(['quantity','price','discount','tax']) AS feature, unnest([0,1,2,3]) AS pos),
ss AS (SELECT 'dmm' AS ranker, feature, abs(avg(x) - median(x)) AS score FROM lg GROUP BY feature
  UNION ALL SELECT 'sd', feature, stddev_pop(x) FROM lg GROUP BY feature
  UNION ALL SELECT 'pcc', feature, max(r) FROM (SELECT feature, k, abs(corr(x, CASE WHEN label = k THEN 1 ELSE 0 END)) AS r
    FROM lg, (SELECT unnest(['N','R','A']) AS k) GROUP BY feature, k) GROUP BY feature),
rk AS (SELECT *, row_number() OVER (PARTITION BY ranker ORDER BY score DESC, pos) AS rank FROM ss JOIN p0 USING (feature) WHERE score > 0)
"""


@query("top_features", f"""
WITH {_VOTES} SELECT ranker, feature, CAST(rank AS INTEGER) AS rank, round(1.0 - (rank - 1) / 2.0, 6) AS nr FROM rk WHERE rank <= 3""")
def _topk(spark, sf):
    m = selection.rank_share(selection.top_k(vote_scores(spark, sf), 3), 3)
    return m.select("ranker", "feature", "rank", F.round("nr", 6).alias("nr"))


@query("vote_fusion", f"""
WITH {_VOTES},
mm AS (SELECT *, 1.0 - (rank - 1) / 2.0 AS nr FROM rk WHERE rank <= 3),
v AS (SELECT p0.feature, any_value(p0.pos) AS pos, count(m.ranker) AS votes, coalesce(sum(nr), 0) / 3 AS score,
  {', '.join(f"CAST(count(m.ranker) FILTER (m.ranker = '{r}') AS INTEGER) AS in_{r}, coalesce(max(round(nr, 6)) FILTER (m.ranker = '{r}'), 0) AS nr_{r}" for r in ('dmm', 'sd', 'pcc'))}
  FROM p0 LEFT JOIN mm m ON m.feature = p0.feature GROUP BY p0.feature)
SELECT feature, votes, round(score, 6) AS score, in_dmm, in_sd, in_pcc, CAST(nr_dmm AS DOUBLE) AS nr_dmm, CAST(nr_sd AS DOUBLE) AS nr_sd,
  CAST(nr_pcc AS DOUBLE) AS nr_pcc, CAST(votes >= 2 AS INTEGER) AS in_pool,
  CAST(row_number() OVER (ORDER BY votes >= 2 DESC, score DESC, votes DESC, pos) AS INTEGER) AS place FROM v""")
def _votes(spark, sf):
    t = selection.fuse_rankings(vote_scores(spark, sf), ["dmm", "sd", "pcc"], 3, 2)
    return t.drop("pos").withColumn("score", F.round("score", 6))


LISTS = SelectionSettings(
    top_k=3, vote_threshold=2, rankers=("dmm", "sd", "pcc"), recipes=(
        Recipe("every feature", read="all"), Recipe("one", ("dmm",), 1), Recipe("two", ("dmm", "sd"), 1),
        Recipe("most votes", read="votes"), Recipe("votes, then rank", read="pool"), Recipe("absent", ("mi",), 1)))


def _list_sql(recipe: Recipe, size: int = 2) -> str:
    names = recipe.rankers or LISTS.rankers
    k = size if len(names) == 1 else LISTS.top_k
    votes = LISTS.vote_threshold if recipe.votes is None else recipe.votes
    fused = f"""(SELECT p0.feature, any_value(p0.pos) AS pos, count(m.ranker) AS votes,
      coalesce(sum(1.0 - (rank - 1) / {k - 1}.0), 0) / {len(names)} AS score
      FROM p0 LEFT JOIN rk m ON m.feature = p0.feature AND m.rank <= {k} AND m.ranker IN {tuple(names) if len(names) > 1 else f"('{names[0]}')"}
      GROUP BY p0.feature)"""
    best = f"votes >= {votes} DESC, score DESC, votes DESC, pos"
    if recipe.read == "all":
        rows = "SELECT feature, row_number() OVER (ORDER BY pos) AS place FROM p0"
    elif recipe.read == "pool":
        rows = f"""SELECT feature, row_number() OVER (ORDER BY {best}) AS place FROM {fused}
          WHERE votes >= {votes} OR (SELECT max(votes) FROM {fused}) < {votes}"""
    elif recipe.read == "votes":
        rows = f"SELECT feature, row_number() OVER (ORDER BY votes DESC, {best}) AS place FROM {fused} WHERE votes >= {votes}"
    else:
        some = "WHERE votes > 0" if len(names) == 1 else ""
        rows = f"SELECT feature, row_number() OVER (ORDER BY {best}) AS place FROM {fused} {some}"
    limit = "" if recipe.read == "all" else f"WHERE place <= {size}"
    return f"SELECT '{recipe.name}' AS experiment, CAST(place AS INTEGER) AS place, feature FROM ({rows}) {limit}"


@query("ablation_lists", f"""
WITH {_VOTES}
{' UNION ALL '.join(_list_sql(r) for r in selection.recipes_of(LISTS) if r.name != 'absent')}""")
def _lists(spark, sf):
    found = selection.ablation_subsets(cut_lineage(vote_scores(spark, sf)), 2, LISTS)
    rows = [(name, i + 1, f) for name, features in found.items() for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "experiment string, place int, feature string")


@query("sensitivity_pools", f"""
WITH {_VOTES},
g AS (SELECT CAST(k AS INTEGER) AS "K", CAST(e AS INTEGER) AS eta, CAST(n AS INTEGER) AS "N" FROM (SELECT unnest([1,2,3]) k) a, (SELECT unnest([1,2,3]) e) b, (SELECT unnest([1,2,4]) n) c),
h AS (SELECT kk, feature, count(*) AS votes FROM rk, (SELECT unnest([1,2,3]) AS kk) WHERE rank <= kk GROUP BY kk, feature),
s AS (SELECT g."K", g.eta, g."N", count(h.feature) AS pool_size FROM g LEFT JOIN h ON h.kk = g."K" AND h.votes >= g.eta GROUP BY ALL)
SELECT "K", eta, "N", pool_size, CASE WHEN pool_size < "N" THEN 'pool smaller than N' ELSE '' END AS note FROM s""")
def _sens(spark, sf):
    return selection.sensitivity_pools(vote_scores(spark, sf), ["dmm", "sd", "pcc"], [1, 2, 3], [1, 2, 3], [1, 2, 4])


@query("subset_size_search")
def _nstar(spark, sf):
    d = _event_scaled(spark, sf)
    s = selection.union_scores({"sd": rankers.rank_deviation(d, EVENT_FEATURES, "y", "row_id"),
                                "dmm": rankers.rank_mean_median(d, EVENT_FEATURES, "y", "row_id")})
    votes = selection.fuse_rankings(s, ["sd", "dmm"], 3, 1)
    cut = F.col("ts") < F.lit("2024-01-20").cast("timestamp")
    _, curve = selection.select_size(votes, d.filter(cut), d.filter(~cut), "y", "row_id", SMALL)
    return curve.select("N", "macro_f1", "weighted_f1", "pr_auc")
