"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.operators.sessions import communication_key, sessionize
from flowmine.settings import SessionSettings
from flowmine.sources.views import EVENT_CLASSES, EVENT_FLOWS_SQL, event_flows

HALF_DAY = SessionSettings(timeout_s=43200.0, max_flows=0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def with_key(flows: DataFrame, mode: str = "service_port") -> DataFrame:
    return flows.withColumn("skey", communication_key(
        mode, F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("protocol")))


def sessions_of(spark: SparkSession, sf_dir: str, settings: SessionSettings = HALF_DAY) -> DataFrame:
    """Event flows with a 12-hour idle timeout."""
    return sessionize(with_key(event_flows(spark, sf_dir)), "skey", "ts", ["row_id"], settings)


KEYED_SQL = EVENT_FLOWS_SQL + """,
keyed AS (
  SELECT *, least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) || '|' ||
    least(src_port, dst_port) || '|' || protocol AS skey FROM flows)
"""

SESSIONS_SQL = KEYED_SQL + """,
marked AS (
  SELECT *, CASE WHEN lag(us) OVER k IS NULL OR (us - lag(us) OVER k) / 1e6 > 43200 THEN 1 ELSE 0 END AS brk
  FROM keyed WINDOW k AS (PARTITION BY skey ORDER BY us, row_id)),
s AS (
  SELECT *, skey || '#' || CAST(sum(brk) OVER (PARTITION BY skey ORDER BY us, row_id) AS BIGINT) AS session_id
  FROM marked)
"""

RANKS_SQL = """,
ranks AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC,
    list_position(['view','click','signup','purchase','error'], label)) - 1 AS rk
  FROM s GROUP BY label)
"""

SESSION_TABLE_SQL = SESSIONS_SQL + RANKS_SQL + """,
st AS (
  SELECT session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_flows,
    arg_max(label, rk) AS primary_class
  FROM s JOIN ranks USING (label) GROUP BY session_id)
"""

# Session-level time blocks for every class (no class needs the fallback here:
# the query ``time_block_fallback`` covers that case on other keys).
TIME_BLOCKS_SQL = SESSION_TABLE_SQL + """,
cum AS (
  SELECT *, sum(n_flows) OVER (PARTITION BY primary_class ORDER BY start_us, session_id) AS c,
    sum(n_flows) OVER (PARTITION BY primary_class) AS total FROM st),
bounds AS (
  SELECT primary_class,
    min_by(end_us, (start_us, session_id)) FILTER (c >= greatest(1.0, total * CAST(0.7 AS DOUBLE))) AS t1,
    min_by(end_us, (start_us, session_id)) FILTER (c >= greatest(1.0, total * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)))) AS t2,
    (max_by(end_us, (start_us, session_id)) - min(start_us)) * CAST(0.005 AS DOUBLE) AS gap
  FROM cum GROUP BY primary_class),
placed AS (
  SELECT st.*, CASE WHEN end_us <= t1 THEN 'train'
    WHEN start_us > t1 + gap AND end_us <= t2 THEN 'val'
    WHEN start_us > t2 + gap THEN 'test' ELSE 'gap' END AS split
  FROM st JOIN bounds USING (primary_class)),
rows_split AS (
  SELECT s.*, placed.split, placed.primary_class AS assign_group
  FROM s JOIN placed USING (session_id))
"""


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event flows with sessions and the time-blocked split."""
    from flowmine.operators.splits import time_blocked_split
    return time_blocked_split(sessions_of(spark, sf_dir), "session_id", "ts", "label", "row_id",
                              EVENT_CLASSES)
