"""Repair, labels, cleaning and fitted transformers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmine.functions.columns import normalise_text, quote
from flowmine.operators import clean, fitted, reports
from flowmine.settings import SURROGATE_START
from flowmine.queries.common import TIME_BLOCKS_SQL, event_split, query
from flowmine.sources.views import EVENT_FLOWS_SQL, event_flows, table

LABELS = {"1-urgent": "High", "2 high": "High", "3-MEDIUM": "Middle", "5-low": "Low"}
LABEL_CLASSES = ["Low", "Middle", "High"]


def order_labels(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(p.startswith("4"), F.lit(" NaN ")).otherwise(p).alias("Label"))


ORDER_LABELS_SQL = """
o AS (SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '4') THEN ' NaN ' ELSE o_orderpriority END AS label
      FROM orders),
n AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM o),
g AS (SELECT *, CASE norm WHEN '1 urgent' THEN 'High' WHEN '2 high' THEN 'High'
        WHEN '3 medium' THEN 'Middle' WHEN '5 low' THEN 'Low' END AS grp FROM n)
"""


@query("label_normalise", f"WITH {ORDER_LABELS_SQL} SELECT o_orderkey, norm FROM g")
def _norm(spark, sf):
    return order_labels(spark, sf).select("o_orderkey", normalise_text(F.col("Label")).alias("norm"))


@query("label_grouping", f"""
WITH {ORDER_LABELS_SQL}
SELECT o_orderkey, label AS label_raw, grp AS label_group,
  CAST(CASE grp WHEN 'Low' THEN 0 WHEN 'Middle' THEN 1 ELSE 2 END AS INTEGER) AS y
FROM g WHERE grp IS NOT NULL OR norm NOT IN ('', 'nan', 'none', 'null', 'na', 'label')""")
def _group(spark, sf):
    return clean.group_labels(order_labels(spark, sf), "Label", LABELS, LABEL_CLASSES).drop("Label")


@query("label_counts", f"""
WITH {ORDER_LABELS_SQL}
SELECT count(*) AS n_rows, count(*) FILTER (grp IS NULL AND norm IN ('', 'nan', 'none', 'null', 'na', 'label')) AS unlabelled,
  count(*) FILTER (grp IS NULL AND norm NOT IN ('', 'nan', 'none', 'null', 'na', 'label')) AS unmapped FROM g""")
def _lcounts(spark, sf):
    return clean.unlabelled_counts(order_labels(spark, sf), "Label", LABELS)


@query("class_distribution", f"""
WITH {ORDER_LABELS_SQL}
SELECT label AS raw_label, grp AS grouped_class, count(*) AS records,
  round(count(*) / (sum(count(*)) OVER ()) * 100, 4) AS pct
FROM g WHERE grp IS NOT NULL GROUP BY label, grp""")
def _cdist(spark, sf):
    d = clean.group_labels(order_labels(spark, sf), "Label", LABELS, LABEL_CLASSES)
    return reports.class_distribution(d, "label_raw", "label_group")


@query("grouped_class_totals", f"""
WITH {ORDER_LABELS_SQL}
SELECT grp AS grouped_class, count(*) AS records FROM g WHERE grp IS NOT NULL GROUP BY grp""")
def _gtot(spark, sf):
    d = clean.group_labels(order_labels(spark, sf), "Label", LABELS, LABEL_CLASSES)
    return reports.grouped_totals(reports.class_distribution(d, "label_raw", "label_group"))


# Orders as capture files: a weekday in the name, an afternoon mark, and a text
# clock. The last file writes the month first and holds only late days.
def order_files(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    k = F.col("o_custkey") % 5
    late = (k == 4) & (F.dayofmonth("d") > 12)
    clock = (F.col("d") + F.make_dt_interval(hours=(F.col("o_orderkey") % 12).cast("int"),
                                             mins=(F.col("o_orderkey") % 60).cast("int")))
    name = F.when(late, "Friday-Export.csv").otherwise(F.concat(
        F.get(F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Other")]),
              k.cast("int")),
        F.when(F.col("o_orderkey") % 2 == 0, "-WorkingHours.csv").otherwise("-Afternoon.csv")))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select(
        F.col("o_orderkey").alias("row"), name.alias("source"),
        F.when(late, F.date_format(clock, "MM/dd/yyyy HH:mm:ss")).otherwise(
            F.date_format(clock, "dd/MM/yyyy HH:mm:ss")).alias("text"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("Price")).otherwise(price).alias("price"),
        F.when(k.isin(1, 2), F.when(F.col("o_orderkey") % 3 == 0, price).otherwise(F.col("o_orderpriority")))
        .otherwise(price).alias("mixed"))


ORDER_FILES_SQL = """
b AS (SELECT *, o_custkey % 5 AS k, o_custkey % 5 = 4 AND day(o_orderdate) > 12 AS late,
        o_orderdate + to_hours(CAST(o_orderkey % 12 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS clock,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders),
f AS (SELECT o_orderkey AS row_, CASE WHEN late THEN 'Friday-Export.csv' ELSE
          ['Monday','Tuesday','Wednesday','Thursday','Other'][k + 1] ||
          CASE WHEN o_orderkey % 2 = 0 THEN '-WorkingHours.csv' ELSE '-Afternoon.csv' END END AS source,
        CASE WHEN late THEN strftime(clock, '%m/%d/%Y %H:%M:%S') ELSE strftime(clock, '%d/%m/%Y %H:%M:%S') END AS text,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Price' ELSE p END AS price,
        CASE WHEN k IN (1, 2) THEN CASE WHEN o_orderkey % 3 = 0 THEN p ELSE o_orderpriority END ELSE p END AS mixed
      FROM b)
"""


@query("timestamp_repair", f"""
WITH {ORDER_FILES_SQL},
u AS (SELECT *, count(try_strptime(text, '%d/%m/%Y %H:%M:%S')) OVER (PARTITION BY source) AS ok FROM f),
t AS (SELECT *, CASE WHEN ok > 0 THEN try_strptime(text, '%d/%m/%Y %H:%M:%S')
        ELSE try_strptime(text, '%m/%d/%Y %H:%M:%S') END AS ts FROM u)
SELECT row_ AS row, source, epoch_us(CASE WHEN contains(lower(source), 'afternoon') AND hour(ts) < 12
  THEN ts + INTERVAL 12 HOURS ELSE ts END) AS us FROM t""")
def _ts(spark, sf):
    return clean.fix_timestamps(order_files(spark, sf), "text", "source").select(
        "row", "source", F.unix_micros("ts").alias("us"))


@query("weekday_from_name", f"""
WITH {ORDER_FILES_SQL}
SELECT source, CAST(CASE WHEN contains(lower(source), 'monday') THEN 0 WHEN contains(lower(source), 'tuesday') THEN 1
  WHEN contains(lower(source), 'wednesday') THEN 2 WHEN contains(lower(source), 'thursday') THEN 3
  WHEN contains(lower(source), 'friday') THEN 4 END AS INTEGER) AS weekday, contains(lower(source), 'afternoon') AS afternoon,
  count(*) AS n_rows
FROM f GROUP BY source""")
def _weekday(spark, sf):
    s = F.col("source")
    return order_files(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "source", clean.weekday_of(s).alias("weekday"), clean.is_afternoon(s).alias("afternoon"), "n_rows")


@query("surrogate_time", f"""
WITH {ORDER_FILES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_) - 1 AS p FROM f)
SELECT row_ AS row, epoch_us(TIMESTAMP '2017-07-03 09:00:00') + 1000000 * (p +
  CASE WHEN contains(lower(source), 'monday') THEN 0 WHEN contains(lower(source), 'tuesday') THEN 86400
  WHEN contains(lower(source), 'wednesday') THEN 172800 WHEN contains(lower(source), 'thursday') THEN 259200
  WHEN contains(lower(source), 'friday') THEN 345600 ELSE 0 END +
  CASE WHEN contains(lower(source), 'afternoon') THEN 43200 ELSE 0 END) AS us FROM r""")
def _surrogate(spark, sf):
    d = order_files(spark, sf).withColumn("part", F.floor(F.col("row") / 1000))
    d = clean.number_rows(d, "source", "part", "row")
    return clean.synthesise_timestamps(d, "source", "row_in_source", SURROGATE_START).select(
        "row", F.unix_micros("ts").alias("us"))


@query("numeric_repair", f"""
WITH {ORDER_FILES_SQL},
r AS (SELECT *, count(try_cast(mixed AS DOUBLE)) OVER (PARTITION BY source) >= 0.5 * count(*) OVER (PARTITION BY source) AS num FROM f)
SELECT row_ AS row, try_cast(price AS DOUBLE) AS price,
  CASE WHEN num AND try_cast(mixed AS DOUBLE) IS NULL THEN NULL ELSE mixed END AS mixed FROM r""")
def _repair(spark, sf):
    out, _ = clean.repair_numeric(order_files(spark, sf), ["price", "mixed"], "source")
    return out.select("row", "price", "mixed")


@query("numeric_repair_report", f"""
WITH {ORDER_FILES_SQL},
l AS (SELECT source, 'price' AS "column", count(*) AS cells, count(price) AS filled, count(try_cast(price AS DOUBLE)) AS parsed
  FROM f GROUP BY source
  UNION ALL SELECT source, 'mixed', count(*), count(mixed), count(try_cast(mixed AS DOUBLE)) FROM f GROUP BY source)
SELECT *, parsed = filled OR parsed >= 0.5 * cells AS "numeric" FROM l""")
def _repair_report(spark, sf):
    return clean.repair_numeric(order_files(spark, sf), ["price", "mixed"], "source")[1]


SPARSE_SQL = ORDER_FILES_SQL + """,
sp AS (SELECT row_, source, CASE WHEN row_ % 5 < 2 THEN NULL WHEN row_ % 5 = 2 THEN mixed ELSE price END AS sparse FROM f),
sr AS (SELECT source, count(*) AS cells, count(sparse) AS filled, count(try_cast(sparse AS DOUBLE)) AS parsed FROM sp GROUP BY source)
"""


def _sparse(spark, sf):
    """Order files with a column that is empty in two of five rows."""
    k = F.col("row") % 5
    return order_files(spark, sf).select("row", "source", F.when(k == 2, F.col("mixed")).when(k > 2, F.col("price")).alias("sparse"))


@query("numeric_repair_nulls", f"""
WITH {SPARSE_SQL}
SELECT sp.row_ AS row, CASE WHEN (parsed = filled OR parsed >= 0.5 * cells) AND try_cast(sparse AS DOUBLE) IS NULL
  THEN NULL ELSE sparse END AS sparse
FROM sp JOIN sr USING (source)""")
def _repair_nulls(spark, sf):
    return clean.repair_numeric(_sparse(spark, sf), ["sparse"], "source")[0].select("row", F.col("sparse").cast("string").alias("sparse"))


@query("numeric_repair_nulls_report", f"""
WITH {SPARSE_SQL}
SELECT source, 'sparse' AS "column", cells, filled, parsed, parsed = filled OR parsed >= 0.5 * cells AS "numeric" FROM sr""")
def _repair_nulls_report(spark, sf):
    return clean.repair_numeric(_sparse(spark, sf), ["sparse"], "source")[1]


@query("timestamp_repair_ampm", f"""
WITH {ORDER_FILES_SQL},
a AS (SELECT row_, source, CASE row_ % 4 WHEN 0 THEN strftime(clock, '%d/%m/%Y %I:%M:%S %p') WHEN 1 THEN strftime(clock, '%d/%m/%Y %I:%M %p')
    WHEN 2 THEN NULL ELSE 'at ' || strftime(clock, '%H') END AS text, date_trunc('minute', clock) AS stamp
  FROM (SELECT f.row_, f.source, b.clock FROM f JOIN b ON f.row_ = b.o_orderkey))
SELECT row_ AS row, epoch_us(CASE WHEN row_ % 4 > 1 THEN NULL WHEN contains(lower(source), 'afternoon') AND hour(stamp) < 12
  THEN stamp + INTERVAL 12 HOURS ELSE stamp END) AS us FROM a""")
def _ampm(spark, sf):
    k = F.col("o_orderkey")
    files = order_files(spark, sf).select("row", "source")
    o = table(spark, sf, "orders").withColumn("clock", F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        F.lit(0), (k % 12).cast("int"), (k % 60).cast("int")))
    text = F.when(k % 4 == 0, F.date_format("clock", "dd/MM/yyyy hh:mm:ss a")).when(
        k % 4 == 1, F.date_format("clock", "dd/MM/yyyy hh:mm a")).when(k % 4 == 3, F.concat(F.lit("at "), F.date_format("clock", "HH")))
    stamped = o.select(k.alias("row"), text.alias("text")).join(files, "row")
    return clean.fix_timestamps(stamped, "text", "source").select("row", F.unix_micros("ts").alias("us"))


@query("surrogate_time_per_file", f"""
WITH {ORDER_FILES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_) - 1 AS p,
  CASE WHEN source LIKE 'Monday%' THEN NULL WHEN source LIKE 'Tuesday%' AND row_ % 2 = 0 THEN NULL
    ELSE TIMESTAMP '2020-01-01 00:00:00' + to_seconds(row_) END AS ts FROM f)
SELECT row_ AS row, epoch_us(CASE WHEN count(ts) OVER (PARTITION BY source) > 0 THEN ts
  ELSE TIMESTAMP '2017-07-03 09:00:00' + to_seconds(p + CASE WHEN source LIKE 'Tuesday%' THEN 86400 ELSE 0 END
    + CASE WHEN contains(lower(source), 'afternoon') THEN 43200 ELSE 0 END) END) AS us
FROM r""")
def _surrogate_per_file(spark, sf):
    d = order_files(spark, sf).withColumn("part", F.floor(F.col("row") / 1000))
    made = F.timestamp_seconds(F.lit(1577836800) + F.col("row"))
    lost = F.col("source").startswith("Monday") | (F.col("source").startswith("Tuesday") & (F.col("row") % 2 == 0))
    d = clean.number_rows(d, "source", "part", "row").withColumn("ts", F.when(~lost, made))
    return clean.fill_clocks(d, "source", "row_in_source", SURROGATE_START).select("row", F.unix_micros("ts").alias("us"))


@query("aligned_union", """
SELECT o_orderkey AS key, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS segment, 'orders' AS source FROM orders
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'customer' FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def _union(spark, sf):
    from flowmine.sources.files import aligned_union
    return aligned_union({
        "orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount")),
        "customer": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount")),
    })


@query("row_order", f"""
WITH {ORDER_FILES_SQL} SELECT row_ AS row, source,
  row_number() OVER (PARTITION BY source ORDER BY text NULLS LAST, row_) AS pos FROM f""")
def _order(spark, sf):
    from flowmine.operators.blocks import add_running
    # The first five characters are a prefix of the order, so they cut a large
    # file into slices.
    d = order_files(spark, sf).withColumn("slice", F.substring("text", 1, 5))
    out = add_running(d, ["source"], ["text", "row"], "slice", {"pos": F.lit(1).cast("long")})
    return out.select("row", "source", "pos")


@query("global_row_number", f"""
WITH {ORDER_FILES_SQL}, d AS (SELECT row_, source, CASE WHEN row_ % 11 > 0 THEN o_orderdate END AS ts
  FROM f JOIN orders ON row_ = o_orderkey)
SELECT row_ AS row, source, row_number() OVER (ORDER BY ts NULLS LAST, source, row_) AS row_no FROM d""")
def _row_no(spark, sf):
    """Many rows a day tie, some have no time; slices of 1,000 rows, so that most numbers cross slices."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.when(
        F.col("o_orderkey") % 11 > 0, F.col("o_orderdate").cast("timestamp")).alias("ts"))
    d = order_files(spark, sf).select("row", "source").join(o, "row")
    return clean.number_in_order(d, "ts", "source", "row", rows=1000).select("row", "source", "row_no")


DIRTY = ["rate", "shift", "window", "k"]


def dirty(spark, sf):
    """Events with infinities, gaps, negatives, a sentinel column and copies."""
    e = event_flows(spark, sf)
    d = e.select(
        "row_id", "ts", "us", "user_id", "label",
        F.when(F.col("row_id") % 97 == 0, F.lit(float("inf")))
        .when(F.col("row_id") % 101 == 0, F.lit(float("-inf")))
        .when(F.col("row_id") % 89 == 0, F.lit(None)).otherwise(F.col("value")).alias("rate"),
        (F.col("k") - 20).alias("shift"),
        F.when(F.col("row_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("hour")).alias("window"), "k",
        F.lit("a").alias("source"))
    copies = d.filter(F.col("row_id") % 10 < 3).withColumn("source", F.lit("b"))
    return d.unionByName(copies)


DIRTY_SQL = EVENT_FLOWS_SQL + """,
d0 AS (SELECT row_id, ts, us, user_id, label,
    CASE WHEN row_id % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN row_id % 101 = 0 THEN CAST('-inf' AS DOUBLE)
         WHEN row_id % 89 = 0 THEN NULL ELSE value END AS rate,
    k - 20 AS shift, CASE WHEN row_id % 5 = 0 THEN CAST(-1 AS DOUBLE) ELSE hour END AS "window", k, 'a' AS source FROM flows),
d AS (SELECT * FROM d0 UNION ALL SELECT * REPLACE ('b' AS source) FROM d0 WHERE row_id % 10 < 3)
"""


@query("infinite_to_null", f"""
WITH {DIRTY_SQL} SELECT row_id, source, CASE WHEN isfinite(rate) THEN rate END AS rate FROM d""")
def _inf(spark, sf):
    return clean.blank_infinite(dirty(spark, sf), DIRTY).select("row_id", "source", "rate")


@query("negative_to_null", f"""
WITH {DIRTY_SQL} SELECT row_id, source, CASE WHEN shift >= 0 THEN shift END AS shift, "window" FROM d""")
def _neg(spark, sf):
    return clean.blank_negative(dirty(spark, sf), ["shift", "window"], ["window"]).select(
        "row_id", "source", "shift", "window")


@query("account_negatives", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer""")
def _neg2(spark, sf):
    return clean.blank_negative(table(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("invalid_cell_counts", f"""
WITH {DIRTY_SQL},
l AS (UNPIVOT (SELECT rate, shift, "window", k FROM d) ON rate, shift, "window", k INTO NAME "column" VALUE v)
SELECT "column", count(*) FILTER (isinf(v)) AS infinite,
  count(*) FILTER (v < 0 AND v > CAST('-inf' AS DOUBLE) AND "column" <> 'window') AS negative,
  count(*) FILTER (v < 0 AND v > CAST('-inf' AS DOUBLE) AND "column" = 'window') AS kept FROM l GROUP BY "column\"""")
def _invalid(spark, sf):
    return clean.invalid_counts(dirty(spark, sf), DIRTY, ["window"])


@query("exact_dedup", f"""
WITH {DIRTY_SQL} SELECT row_id, ts, user_id, label, rate, shift, "window", k, min(source) AS source
FROM d GROUP BY ALL""")
def _dedup(spark, sf):
    d = dirty(spark, sf).drop("us")
    return clean.drop_copies(d, [c for c in d.columns if c != "source"], ["source"])


@query("cleaning_report", f"""
WITH {DIRTY_SQL},
u AS (SELECT DISTINCT row_id, ts, user_id, label, rate, shift, "window", k FROM d)
SELECT (SELECT count(*) FROM d) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM d) - count(*) AS duplicates,
  count(*) FILTER (isinf(rate)) AS inf_cells,
  CAST(count(*) FILTER (rate < 0 AND rate > CAST('-inf' AS DOUBLE)) + count(*) FILTER (shift < 0) + count(*) FILTER (k < 0) AS BIGINT) AS negative_cells,
  count(*) FILTER ("window" < 0) AS sentinels_kept, (SELECT count(DISTINCT user_id) FROM d) AS sessions,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM u""")
def _report(spark, sf):
    return reports.cleaning_report(
        dirty(spark, sf), DIRTY, ["window"], "user_id", "ts", "label",
        ["row_id", "ts", "user_id", "label", "rate", "shift", "window", "k"])


@query("median_imputer", f"""
WITH {DIRTY_SQL},
m AS (SELECT median(rate) FILTER (isfinite(rate)) AS mr FROM d WHERE epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-20'))
SELECT row_id, source, round(CASE WHEN isfinite(rate) THEN rate ELSE mr END, 6) AS rate FROM d, m""")
def _median(spark, sf):
    d = dirty(spark, sf)
    m = fitted.medians(d.filter("ts < timestamp '2024-01-20'"), ["rate"])
    return fitted.impute(d, m).select("row_id", "source", F.round("rate", 6).alias("rate"))


_SCALED_SQL = f"""
WITH {TIME_BLOCKS_SQL},
m AS (SELECT min(value) AS a1, max(value) AS b1, min(k) AS a2, max(k) AS b2 FROM rows_split WHERE split = 'train'),
sc AS (SELECT row_id, protocol, split, greatest(least((value - a1) / (b1 - a1), 1), 0) AS value,
  greatest(least((k - a2) / (b2 - a2), 1), 0) AS k FROM rows_split, m)
"""


@query("minmax_scaler", _SCALED_SQL + "SELECT row_id, round(value, 6) AS value, round(k, 6) AS k FROM sc")
def _scaler(spark, sf):
    d = event_split(spark, sf)
    p = fitted.Preprocessor(["value", "k"]).fit(d.filter("split = 'train'"))
    return p.transform(d, ["row_id"]).select(
        "row_id", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@query("one_hot", f"""
WITH {EVENT_FLOWS_SQL}
SELECT row_id, CAST(protocol = 0 AS DOUBLE) AS "protocol=0", CAST(protocol = 6 AS DOUBLE) AS "protocol=6" FROM flows""")
def _onehot(spark, sf):
    d = event_flows(spark, sf)
    p = fitted.Preprocessor([], ["protocol"]).fit(d.filter("protocol <> 17"))
    return p.transform(d, ["row_id"])


@query("one_hot_wide", """
WITH v AS (SELECT o_custkey AS value, row_number() OVER (ORDER BY o_custkey) - 1 AS pos
  FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 > 0))
SELECT o_orderkey AS row, (SELECT count(*) FROM v) AS width, pos FROM orders LEFT JOIN v ON o_custkey = value""")
def _onehot_wide(spark, sf):
    """Customers of two thirds of the orders; those seen in the last third only have no position."""
    o = table(spark, sf, "orders")
    p = fitted.Preprocessor([], ["o_custkey"], wide=50).fit(o.filter("o_orderkey % 3 > 0"))
    v = F.unwrap_udt(quote("o_custkey=*"))
    return p.transform(o, ["o_orderkey"]).select(
        F.col("o_orderkey").alias("row"), v["size"].cast("long").alias("width"), F.get(v["indices"], F.lit(0)).cast("long").alias("pos"))


@query("flow_states", f"""
WITH {TIME_BLOCKS_SQL},
q AS (SELECT quantile_cont(value, [1/3, 2/3]) AS a, quantile_cont(k, [1/3, 2/3]) AS b, quantile_cont(hour, [1/3, 2/3]) AS c
      FROM rows_split WHERE split = 'train')
SELECT row_id, 'D' || (CAST(value > a[1] AS INT) + CAST(value > a[2] AS INT)) || '|B' ||
  (CAST(k > b[1] AS INT) + CAST(k > b[2] AS INT)) || '|P' || (CAST(hour > c[1] AS INT) + CAST(hour > c[2] AS INT)) AS event
FROM rows_split, q""")
def _states(spark, sf):
    d = event_split(spark, sf)
    st = fitted.FlowStates({"D": "value", "B": "k", "P": "hour"}).fit(d.filter("split = 'train'"))
    return st.transform(d).select("row_id", "event")


@query("quantile_edges", """
SELECT c.name AS "column", round(c.q[1], 6) AS q25, round(c.q[2], 6) AS q50, round(c.q[3], 6) AS q90 FROM (
  SELECT unnest([{'name': 'l_extendedprice', 'q': quantile_cont(l_extendedprice, [0.25, 0.5, 0.9])},
                 {'name': 'l_quantity', 'q': quantile_cont(l_quantity, [0.25, 0.5, 0.9])}]) AS c FROM lineitem)""")
def _edges(spark, sf):
    """Forces the distributed path: brackets, counts, and ordering inside them."""
    from flowmine.operators.quantiles import exact_quantiles
    li = table(spark, sf, "lineitem")
    q = exact_quantiles(li, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.9], small_rows=1000,
                        bracket_rows=1000)
    return spark.createDataFrame([(c, *[round(v, 6) for v in vs]) for c, vs in q.items()],
                                 "column string, q25 double, q50 double, q90 double")
