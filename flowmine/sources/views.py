"""Flow-shaped views over the given tables, for the registered queries.

``EVENT_FLOWS_SQL`` and ``LINE_FLOWS_SQL`` state the same views for the SQL
check. ``events`` supplies an event per row with a user and a label; the second
endpoint and the direction follow from the event number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.session import use_utc

EVENT_CLASSES = ["view", "click", "signup", "purchase", "error"]
LINE_CLASSES = ["N", "R", "A"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flows: endpoints, ports, protocol, features, class."""
    e = table(spark, sf_dir, "events")
    server = F.col("event_id") % 3
    out = F.col("event_id") % 2 == 0
    user_end, server_end = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("s"), server)
    client_port, service_port = 20000 + F.col("event_id") % 30000, 8000 + server
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("row_id"), ts.alias("ts"),
        F.unix_micros(ts).alias("us"), "user_id",
        F.when(out, user_end).otherwise(server_end).alias("src_ip"),
        F.when(out, server_end).otherwise(user_end).alias("dst_ip"),
        F.when(out, client_port).otherwise(service_port).alias("src_port"),
        F.when(out, service_port).otherwise(client_port).alias("dst_port"),
        F.when(server == 0, 6).when(server == 1, 17).otherwise(0).cast("long").alias("protocol"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour(ts).cast("double").alias("hour"),
        F.col("event_type").alias("label"))


EVENT_FLOWS_SQL = """
flows AS (
  SELECT event_id AS row_id, ts, epoch_us(ts) AS us, user_id,
    CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 's' || (event_id % 3) END AS src_ip,
    CASE WHEN event_id % 2 = 0 THEN 's' || (event_id % 3) ELSE 'u' || user_id END AS dst_ip,
    CASE WHEN event_id % 2 = 0 THEN 20000 + event_id % 30000 ELSE 8000 + event_id % 3 END AS src_port,
    CASE WHEN event_id % 2 = 0 THEN 8000 + event_id % 3 ELSE 20000 + event_id % 30000 END AS dst_port,
    CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 0 END AS protocol,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CAST(hour(ts) AS DOUBLE) AS hour, event_type AS label
  FROM events)
"""


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled rows: four numeric features, a copy, a constant."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    return li.select(
        key.alias("row_id"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity_copy"), F.lit(0.0).alias("constant"),
        (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("price_like"))


LINE_FLOWS_SQL = """
lines AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           strftime(l_shipdate, '%Y-%m-%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
    l_returnflag AS label, l_quantity AS quantity, l_extendedprice AS price,
    l_discount AS discount, l_tax AS tax, l_quantity AS quantity_copy,
    CAST(0 AS DOUBLE) AS constant, l_extendedprice * 2 + l_quantity AS price_like
  FROM lineitem)
"""
