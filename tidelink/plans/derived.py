"""Inputs derived from the given tables for the link-level jobs.

The test data has no query log, request table, message log or service log,
so these are derived row-for-row from ``events`` (and so grow with it).
Each derivation is one SQL expression string, used by Spark through
``F.expr`` and pasted verbatim into the DuckDB oracle, so both engines see
identical inputs while the operators themselves are implemented separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event time splitting the log into "already loaded" (first days) and "new".
SPLIT_TS = "2024-01-04 00:00:00"

# Port each event's connection used.
PORT_EXPR = """CASE
  WHEN event_type = 'view' THEN 5432
  WHEN event_type = 'click' AND value >= 40 THEN 27017
  WHEN event_type = 'click' THEN 3306
  WHEN event_type = 'purchase' THEN 8181
  WHEN event_type = 'signup' THEN 6379
  ELSE 7000 END"""

# Link message type carried by each event.
MSG_TYPE_EXPR = """CASE event_type
  WHEN 'signup' THEN 'session_create'
  WHEN 'view' THEN 'session_data'
  WHEN 'click' THEN 'session_data_response'
  WHEN 'purchase' THEN 'session_close'
  ELSE 'heartbeat' END"""

# Query-log text.
QUERY_TEXT_EXPR = """CASE
  WHEN event_type = 'view' THEN ' select * from orders where o_custkey = ' || CAST(user_id AS STRING)
  WHEN event_type = 'click' AND value >= 30 THEN 'SHOW TABLES'
  WHEN event_type = 'click' THEN 'WITH t AS (SELECT ' || CAST(user_id AS STRING) || ' AS id) SELECT * FROM t'
  WHEN event_type = 'purchase' THEN 'INSERT INTO orders VALUES (' || CAST(event_id AS STRING) || ')'
  WHEN event_type = 'signup' AND value >= 30 THEN 'describe customer'
  WHEN event_type = 'signup' THEN '(SELECT ' || CAST(user_id AS STRING) || ') /* ' || repeat('x', 120) || ' */'
  ELSE '-- c' || chr(10) || 'SELECT 1' END"""

# Request text in every shape the parser distinguishes.
REQUEST_TEXT_EXPR = """CASE
  WHEN event_type = 'view' THEN 'SELECT c_name FROM customer WHERE c_custkey = ' || CAST(user_id AS STRING)
  WHEN event_type = 'click' THEN '{"query":"SELECT ' || CAST(user_id AS STRING) || '","target":"db' || CAST(user_id AS STRING) || ':5433"}'
  WHEN event_type = 'purchase' THEN '{"query":"SELECT 1","target":"db1"}'
  WHEN event_type = 'signup' THEN '  {"query":"SELECT 2"}'
  WHEN value < 5 THEN '{"query":"SELECT 1","target":"a:b:c"}'
  WHEN value < 10 THEN '{bad'
  WHEN value < 15 THEN '{"target":"db1:1"}'
  WHEN value < 20 THEN '{"query":"SELECT 1","target":"db1:x"}'
  WHEN value < 25 THEN '{"query":5}'
  WHEN value < 30 THEN '{"query":"SELECT 1","target":":5433"}'
  WHEN value < 35 THEN '{"query":"SELECT 1","target":5}'
  WHEN value < 40 THEN '{"query":"SELECT 1","target":null}'
  WHEN value < 45 THEN ''
  ELSE '{"query":"SELECT 1","target":"db1:70000"}' END"""

# Request batch over more than a thousand distinct queries, plus failing rows of every kind.
BATCH_TEXT_EXPR = """CASE
  WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'SELECT raise_error(''stop'') AS y'
  WHEN event_type = 'click' AND event_id % 50 = 1 THEN 'SELECT 1 AS a, 2 AS a'
  WHEN event_type = 'purchase' AND event_id % 2 = 0
    THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(event_id % 2400 AS STRING)
  WHEN event_type = 'view' THEN 'SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment'
  WHEN event_type = 'click' THEN '{"query":"SELECT n_name FROM nation WHERE n_regionkey = 1"}'
  WHEN event_type = 'purchase' THEN 'SELECT o_orderkey FROM orders WHERE o_totalprice > 400000'
  WHEN event_type = 'signup' THEN '{"target":"db1:1"}'
  WHEN value < 10 THEN 'DELETE FROM orders'
  ELSE 'SELECT * FROM missing_table' END"""

# Requests whose rows are compared: times, nulls, floats and an order of their own.
ROWS_TEXT_EXPR = """CASE
  WHEN event_type = 'view' THEN 'SELECT c_custkey, c_name FROM customer WHERE c_nationkey = '
    || CAST(event_id % 25 AS STRING) || ' ORDER BY c_custkey DESC'
  WHEN event_type = 'click' THEN 'SELECT n_nationkey, CAST(NULL AS STRING) AS none, TIMESTAMP_NTZ ''2024-01-01 00:00:00.123456'' AS at FROM nation'
  WHEN event_type = 'purchase' THEN 'SELECT raise_error(''stop'') AS y'
  ELSE 'SELECT TIMESTAMP_NTZ ''2024-01-01 00:00:00'' AS at' END"""

# Requests with results longer than a page, in an order of their own.
PAGED_TEXT_EXPR = """CASE
  WHEN event_type = 'view' THEN 'SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 8 = '
    || CAST(event_id % 8 AS STRING) || ' ORDER BY o_orderkey DESC'
  WHEN event_type = 'click' THEN 'SELECT o_orderkey FROM orders WHERE o_orderkey < 0'
  WHEN event_type = 'purchase' THEN 'SELECT c_custkey FROM customer ORDER BY c_custkey'
  ELSE 'SELECT * FROM missing_table' END"""

# Session markers, and link reconnects, from events.
MARKER_EXPR = """CASE
  WHEN event_type = 'signup' THEN 'create'
  WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'close'
  WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'error'
  WHEN event_type = 'error' THEN 'reset'
  WHEN event_type = 'purchase' AND event_id % 97 = 0 THEN 'reconnect'
  ELSE 'data' END"""
LINK_EXPR = "user_id % 5"

# Requests routed by target: the remote database, the default source, nowhere.
ROUTED_TEXT_EXPR = """CASE
  WHEN event_type = 'view' THEN '{"query":"SELECT N_NAME FROM NATION WHERE N_REGIONKEY = 2","target":"remote-db:1527"}'
  WHEN event_type = 'click' THEN '{"query":"SELECT COUNT(*) AS N FROM NATION","target":"remote-db"}'
  WHEN event_type = 'purchase' THEN '{"query":"SELECT 1 AS one","target":"elsewhere:5432"}'
  ELSE 'SELECT r_name FROM region' END"""

# Service log fields.
LOGGER_EXPR = """CASE WHEN event_type IN ('signup', 'error') THEN 'link_agent' ELSE '__main__' END"""
LEVEL_EXPR = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END"""
MESSAGE_EXPR = """CASE event_type
  WHEN 'signup' THEN 'Agent authenticated and ready: peer ' || CAST(user_id AS STRING)
  WHEN 'error' THEN 'Authentication failed for peer ' || CAST(user_id AS STRING)
  WHEN 'view' THEN 'frame in, kind=data, id=' || CAST(event_id AS STRING)
  WHEN 'click' THEN 'frame skipped - kind=click is not known'
  ELSE 'statement done in 1 - 2 ms, id=' || CAST(event_id AS STRING) END"""


def connections(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "user_id", "event_type", F.expr(PORT_EXPR).alias("port"))


def messages(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "user_id", "event_type", "props",
                         F.expr(MSG_TYPE_EXPR).alias("msg_type"))


def query_log(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.expr(QUERY_TEXT_EXPR).alias("query"))


def request_table(events: DataFrame, expr: str = REQUEST_TEXT_EXPR) -> DataFrame:
    return events.select(F.col("event_id").alias("row_index"), F.expr(expr).alias("input"))


def session_log(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.expr(LINK_EXPR).alias("link"), "ts", "event_id",
                         F.expr(MARKER_EXPR).alias("marker"))


def service_log(events: DataFrame) -> DataFrame:
    from tidelink.streaming.logs import format_line
    return events.select("event_id", format_line(F.col("ts"), F.expr(LOGGER_EXPR), F.expr(LEVEL_EXPR),
                                                 F.expr(MESSAGE_EXPR)).alias("line"))
