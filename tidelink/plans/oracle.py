"""DuckDB SQL twins of the query register (same column names and types).

Written independently of the Spark code paths; derived inputs reuse the
shared expression strings in ``tidelink.plans.derived``.
"""

from __future__ import annotations

from tidelink.plans import derived as d
from tidelink.plans.queries import RUN_TS

_SPLIT = f"TIMESTAMP '{d.SPLIT_TS}'"

_STATUS = """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_orders,
       CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_price FROM orders GROUP BY o_orderstatus"""

ORACLE_SQL = {
    "user_orders": f"""
SELECT c.c_custkey AS user_id, c.c_name AS user_name, o.o_orderkey AS order_id,
       o.o_orderstatus AS order_status, round(o.o_totalprice, 2) AS total_amount,
       o.o_orderdate AS order_date
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
ORDER BY user_id, order_date DESC NULLS FIRST""",

    "order_listing": """
SELECT o.o_orderkey AS order_id, c.c_name AS user_name, o.o_orderstatus AS order_status,
       round(o.o_totalprice, 2) AS total_amount
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
ORDER BY o.o_orderkey LIMIT 5""",

    "table_counts": """
SELECT 'Customers:' AS status, CAST(count(*) AS BIGINT) AS row_count FROM customer
UNION ALL SELECT 'Orders:' AS status, CAST(count(*) AS BIGINT) AS row_count FROM orders
UNION ALL SELECT 'Line items:' AS status, CAST(count(*) AS BIGINT) AS row_count FROM lineitem""",

    "bound_params": """
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total_price
FROM orders WHERE o_totalprice > 300000.0 AND o_orderstatus = 'F'""",

    "federated_below_avg": """
WITH s AS (SELECT c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS total, count(c_acctbal) AS n,
                  CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS segment_avg
           FROM customer GROUP BY c_mktsegment)
SELECT c.c_custkey, c.c_name, n.n_name, c.c_mktsegment, round(c.c_acctbal, 2) AS c_acctbal,
       round(s.segment_avg, 2) AS segment_avg
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN s ON c.c_mktsegment = s.c_mktsegment
WHERE CAST(c.c_acctbal AS DECIMAL(18,2)) * s.n < s.total""",

    "remote_query": _STATUS,
    "remote_append": _STATUS,
    "remote_catalog": _STATUS,

    "remote_scan": """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment
FROM customer ORDER BY c_custkey LIMIT 5""",

    "insert_where_not_exists": f"""
SELECT s.user_id, s.event_type
FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= {_SPLIT}) s
WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.ts < {_SPLIT}
                  AND t.user_id = s.user_id AND t.event_type = s.event_type)""",

    "insert_ignore": """
WITH b AS (
  SELECT doc_id, source, n_chars, text,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE source >= 'src5')
SELECT doc_id, source, n_chars FROM b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.source < 'src5' AND t.text = b.text)""",

    "surrogate_key": """
SELECT c_custkey AS source_key,
       CAST((SELECT max(c_custkey) FROM customer WHERE c_acctbal >= 0)
            + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS new_key
FROM customer WHERE c_acctbal < 0""",

    "default_fill": f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate ELSE TIMESTAMP '{RUN_TS}' END AS order_date,
       o_orderkey % 7 = 0 AS is_default
FROM orders""",

    "constraint_report": """
SELECT 'customer primary key c_custkey' AS rule, CAST(count(*) AS BIGINT) AS violations
  FROM (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_custkey HAVING count(*) > 1)
UNION ALL SELECT 'customer not null c_name', CAST(count(*) FILTER (WHERE c_name IS NULL) AS BIGINT) FROM customer
UNION ALL SELECT 'customer c_name varchar(25)', CAST(count(*) FILTER (WHERE length(c_name) > 25) AS BIGINT) FROM customer
UNION ALL SELECT 'orders primary key o_orderkey', CAST(count(*) AS BIGINT)
  FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders o_custkey references customer', CAST(count(*) AS BIGINT)
  FROM orders o WHERE o.o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'lineitem unique (l_orderkey, l_linenumber)', CAST(count(*) AS BIGINT)
  FROM (SELECT l_orderkey, l_linenumber FROM lineitem
        WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lineitem l_orderkey references orders', CAST(count(*) AS BIGINT)
  FROM lineitem l WHERE l.l_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)""",

    "ingest_full": _STATUS,
    "ingest_incremental": """
SELECT o_orderstatus, count(*) AS n_orders,
       CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_price,
       CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(DISTINCT o_orderkey) AS n_keys
FROM orders GROUP BY o_orderstatus""",

    "ingest_changes": """
WITH f AS (SELECT o_orderkey AS k FROM orders)
SELECT o_orderstatus AS name, CAST(count(*) AS BIGINT) AS n_rows, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_price
FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'run 1 inserted', count(*) FILTER (k % 10 <> 3) + count(*) FILTER (k % 11 = 0 AND k > 0), NULL FROM f
UNION ALL SELECT 'run 1 updated', 0, NULL
UNION ALL SELECT 'run 1 deleted', 0, NULL
UNION ALL SELECT 'run 2 inserted', count(*) FILTER (k % 10 = 3), NULL FROM f
UNION ALL SELECT 'run 2 updated', count(*) FILTER (k % 10 <> 3 AND k % 7 = 0), NULL FROM f
UNION ALL SELECT 'run 2 deleted', count(*) FILTER (k % 11 = 0 AND k > 0), NULL FROM f
UNION ALL SELECT 'run 3 ' || n, 0, NULL FROM (SELECT unnest(['inserted', 'updated', 'deleted', 'rewritten']) AS n)""",

    "copy_reconcile": """
SELECT 'source' AS side, CAST(count(*) AS BIGINT) AS n_rows, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_amount,
       true AS match FROM orders
UNION ALL
SELECT 'target' AS side, CAST(count(*) AS BIGINT) AS n_rows, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_amount,
       true AS match FROM orders""",

    "catalog_read": """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_price
FROM orders GROUP BY o_orderpriority""",

    "encode_roundtrip": """
SELECT c_custkey, lower(hex(c_name)) AS name_hex, to_base64(encode(c_name)) AS name_b64,
       true AS roundtrip_ok FROM customer""",

    "protect_columns": """
SELECT c_custkey, c_name, true AS roundtrip_ok FROM customer""",

    "result_envelope": """
WITH e AS (
  SELECT event_id, user_id, event_type, value,
         strftime(ts, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts_iso
  FROM events)
SELECT event_id, user_id, ts_iso, round(value, 2) AS value,
       CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type,
                     'ts_iso': ts_iso}) AS VARCHAR) AS row_json
FROM e""",

    "statement_kind": f"""
WITH q AS (SELECT event_id, {d.QUERY_TEXT_EXPR} AS query FROM events)
SELECT event_id,
       CASE WHEN regexp_matches(upper(query), '^\\s*(SELECT|SHOW|DESC|WITH)') THEN 'read' ELSE 'write' END AS kind_service,
       CASE WHEN regexp_matches(upper(query), '^\\s*(SELECT|SHOW|DESC)') THEN 'read' ELSE 'write' END AS kind_agent,
       substring(query, 1, 100) AS query_head
FROM q""",

    "request_parse": f"""
WITH r AS (SELECT event_id AS row_index, {d.REQUEST_TEXT_EXPR} AS input FROM events),
j AS (
  SELECT row_index, input,
         regexp_matches(input, '^\\s*\\{{') AND json_valid(input) AS as_json
  FROM r),
k AS (
  SELECT row_index, input, as_json,
         CASE WHEN as_json THEN json_type(input, '$.query') END AS qtype,
         CASE WHEN as_json THEN json_type(input, '$.target') END AS ttype,
         CASE WHEN as_json THEN json_extract_string(input, '$.query') END AS jquery,
         CASE WHEN as_json THEN json_extract_string(input, '$.target') END AS target
  FROM j),
m AS (
  SELECT *,
         CASE WHEN input IS NULL THEN NULL WHEN NOT as_json THEN input
              WHEN qtype = 'VARCHAR' THEN jquery END AS q,
         len(string_split(target, ':')) AS nparts,
         string_split(target, ':')[1] AS host,
         CASE WHEN len(string_split(target, ':')) = 2 THEN TRY_CAST(string_split(target, ':')[2] AS INTEGER) END AS port,
         as_json AND ttype IS NOT NULL AND ttype <> 'NULL' AS has_target
  FROM k),
n AS (
  SELECT *,
         has_target AND (ttype <> 'VARCHAR' OR nparts > 2 OR host = ''
                          OR (nparts = 2 AND (port IS NULL OR port < 1 OR port > 65535))) AS bad_target
  FROM m),
e AS (
  SELECT *,
         CASE WHEN input IS NULL OR trim(input) = '' THEN 'No SQL query provided'
              WHEN as_json AND (qtype IS NULL OR qtype = 'NULL') THEN 'No SQL query provided'
              WHEN as_json AND qtype <> 'VARCHAR' THEN 'Invalid query type'
              WHEN bad_target THEN 'Invalid target'
              WHEN trim(q) = '' THEN 'No SQL query provided' END AS error
  FROM n)
SELECT row_index,
       CASE WHEN error IS NULL THEN q END AS query,
       CASE WHEN error IS NULL AND has_target AND NOT bad_target THEN host END AS target_host,
       CASE WHEN error IS NULL AND has_target AND NOT bad_target THEN port END AS target_port,
       error
FROM e""",

    "request_batch": """
WITH e AS (
  SELECT event_id, event_type, value,
         CASE WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'USER_RAISED_EXCEPTION'
              WHEN event_type = 'click' AND event_id % 50 = 1 THEN 'Duplicate column names in result'
              WHEN event_type IN ('view', 'click', 'purchase') THEN NULL
              WHEN event_type = 'signup' THEN 'No SQL query provided'
              WHEN value < 10 THEN 'Only read statements are accepted'
              ELSE 'TABLE_OR_VIEW_NOT_FOUND' END AS error,
         CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN event_id % 2400 END AS asked
  FROM events),
o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT event_id AS row_index, error IS NULL AS success,
       CAST(CASE WHEN error IS NOT NULL THEN 0
         WHEN asked IS NOT NULL THEN coalesce(o.n, 0)
         WHEN event_type = 'view' THEN (SELECT count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY c_mktsegment))
         WHEN event_type = 'click' THEN (SELECT count(*) FROM nation WHERE n_regionkey = 1)
         ELSE (SELECT count(*) FROM orders WHERE o_totalprice > 400000) END AS BIGINT) AS rowcount,
       error
FROM e LEFT JOIN o ON o.o_custkey = e.asked""",

    "request_rows": f"""
WITH t AS (SELECT DISTINCT event_type, event_id % 25 AS k, {d.ROWS_TEXT_EXPR.replace("TIMESTAMP_NTZ ''", "TIMESTAMP_NTZ ''")} AS input
           FROM events)
SELECT DISTINCT input, '{{"c_custkey":' || c.c_custkey || ',"c_name":"' || c.c_name || '"}}' AS row_json
FROM t JOIN customer c ON c.c_nationkey = t.k WHERE t.event_type = 'view'
UNION ALL
SELECT * FROM (SELECT DISTINCT input FROM t WHERE event_type = 'click'),
  (SELECT '{{"n_nationkey":' || n_nationkey || ',"none":null,"at":"2024-01-01T00:00:00.123456"}}' FROM nation)
UNION ALL
SELECT DISTINCT input, '{{"at":"2024-01-01T00:00:00"}}' FROM t WHERE event_type IN ('signup', 'error')""",

    "request_pages": f"""
WITH t AS (SELECT DISTINCT event_type, event_id % 8 AS k, {d.PAGED_TEXT_EXPR} AS input FROM events),
r AS (
  SELECT t.input, row_number() OVER (PARTITION BY t.input ORDER BY o.o_orderkey DESC) AS rn,
         '{{"o_orderkey":' || o.o_orderkey || ',"o_orderstatus":"' || o.o_orderstatus || '"}}' AS row_json
  FROM t JOIN orders o ON o.o_custkey % 8 = t.k WHERE t.event_type = 'view'
  UNION ALL
  SELECT i.input, row_number() OVER (PARTITION BY i.input ORDER BY c_custkey), '{{"c_custkey":' || c_custkey || '}}'
  FROM (SELECT DISTINCT input FROM t WHERE event_type = 'purchase') i, customer)
SELECT input, (rn - 1) // 500 AS page, count(*) AS n_rows, '[' || string_agg(row_json, ',' ORDER BY rn) || ']' AS rows_json
FROM r GROUP BY ALL""",

    "request_routing": """
SELECT event_id AS row_index,
       event_type <> 'purchase' AS success,
       CAST(CASE event_type
         WHEN 'view' THEN (SELECT count(*) FROM nation WHERE n_regionkey = 2)
         WHEN 'click' THEN 1
         WHEN 'purchase' THEN 0
         ELSE (SELECT count(*) FROM region) END AS BIGINT) AS rowcount,
       CASE WHEN event_type = 'purchase' THEN 'Unknown target' END AS error
FROM events""",

    "group_percentiles": """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
FROM lineitem GROUP BY l_returnflag""",

    "range_join": """
SELECT e.event_id AS error_id, p.event_id AS purchase_id, round((epoch_us(p.ts) - epoch_us(e.ts)) / 1000000.0, 6) AS after_s
FROM (SELECT event_id, ts, ts + to_minutes(event_id % 5 + 1) AS closed FROM events WHERE event_type = 'error') e
JOIN (SELECT event_id, ts FROM events WHERE event_type = 'purchase') p ON p.ts >= e.ts AND p.ts <= e.closed""",

    "moving_window": """
SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS n_hour,
       CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS value_hour
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",

    "protocol_lookup": f"""
WITH c AS (SELECT event_id, {d.PORT_EXPR} AS port FROM events)
SELECT event_id, port,
       CASE port WHEN 5432 THEN 'postgresql' WHEN 5433 THEN 'postgresql' WHEN 3306 THEN 'mysql'
         WHEN 3307 THEN 'mysql' WHEN 1433 THEN 'mssql' WHEN 1521 THEN 'oracle'
         WHEN 27017 THEN 'mongodb' WHEN 27018 THEN 'mongodb' WHEN 6379 THEN 'redis'
         WHEN 11211 THEN 'memcached' WHEN 5672 THEN 'rabbitmq' WHEN 9092 THEN 'kafka'
         WHEN 8181 THEN 'iceberg-rest' WHEN 9000 THEN 's3' WHEN 9001 THEN 's3-console'
         WHEN 8080 THEN 'http' WHEN 8888 THEN 'http' WHEN 8000 THEN 'http'
         WHEN 9200 THEN 'elasticsearch' WHEN 9300 THEN 'elasticsearch' ELSE 'unknown' END AS protocol
FROM c""",

    "connection_inventory": f"""
WITH c AS (SELECT {d.PORT_EXPR} AS port FROM events),
p AS (SELECT port, CAST(count(*) AS BIGINT) AS active_connections FROM c GROUP BY port)
SELECT port,
       CASE port WHEN 5432 THEN 'postgresql' WHEN 3306 THEN 'mysql' WHEN 27017 THEN 'mongodb'
         WHEN 6379 THEN 'redis' WHEN 8181 THEN 'iceberg-rest' ELSE 'unknown' END AS protocol,
       active_connections,
       CAST(count(*) OVER () AS BIGINT) AS total_count
FROM p ORDER BY port""",

    "source_health": f"""
WITH c AS (SELECT user_id, ts, event_type, {d.PORT_EXPR} AS port FROM events)
SELECT user_id,
       CASE WHEN arg_max(event_type, ts) <> 'error' AND count(DISTINCT port) >= 1
            THEN 'healthy' ELSE 'degraded' END AS status,
       arg_max(event_type, ts) AS last_state,
       CAST(count(DISTINCT port) AS BIGINT) AS active_ports,
       CAST(count(*) AS BIGINT) AS n_events
FROM c GROUP BY user_id""",

    "message_route": f"""
WITH m AS (SELECT {d.MSG_TYPE_EXPR} AS msg_type FROM events)
SELECT CASE WHEN msg_type IN ('session_create', 'session_data', 'session_close',
                              'request_port_mappings', 'forward_data', 'tcp_forward', 'query') THEN 'agent'
            WHEN msg_type IN ('port_mapping', 'session_create_response', 'session_data_response',
                              'session_reset') THEN 'sidecar'
            ELSE 'dead_letter' END AS route,
       msg_type, CAST(count(*) AS BIGINT) AS n_messages
FROM m GROUP BY ALL""",

    "session_batch": """
WITH l AS (
  SELECT user_id, ts, event_id,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
  FROM events),
s AS (
  SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
  FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
       CAST(count(*) AS BIGINT) AS n_events
FROM s GROUP BY user_id, sid""",

    "session_markers": f"""
WITH e AS (SELECT user_id, {d.LINK_EXPR} AS link, ts, event_id, {d.MARKER_EXPR} AS m FROM events),
ep AS (
  SELECT *, CAST(sum(CASE WHEN m = 'reconnect' THEN 1 ELSE 0 END) OVER (
    PARTITION BY link ORDER BY ts, CASE WHEN m = 'reconnect' THEN 0 ELSE 1 END, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM e),
r AS (SELECT link, epoch, ts FROM ep WHERE m = 'reconnect'),
x AS (
  SELECT *, coalesce(sum(CASE WHEN m <> 'data' THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
  FROM ep WHERE m <> 'reconnect'),
seg AS (
  SELECT user_id, link, epoch, CAST(segment AS BIGINT) AS segment,
         CAST(sum(CASE WHEN m = 'data' THEN 1 ELSE 0 END) AS BIGINT) AS n_data,
         max(CASE WHEN m <> 'data' THEN m END) AS end_marker, max(CASE WHEN m <> 'data' THEN ts END) AS end_ts
  FROM x GROUP BY user_id, link, epoch, segment)
SELECT p.user_id, p.epoch, p.segment + 1 AS segment, p.end_ts AS session_start,
       coalesce(s.end_ts, r.ts) AS session_end, coalesce(s.n_data, 0) AS n_data,
       CASE s.end_marker WHEN 'close' THEN 'closed' WHEN 'create' THEN 'recreated' WHEN 'error' THEN 'error'
         WHEN 'reset' THEN 'reset' ELSE CASE WHEN r.ts IS NOT NULL THEN 'reconnect' ELSE 'open' END END AS end_reason
FROM seg p LEFT JOIN seg s ON s.user_id = p.user_id AND s.epoch = p.epoch AND s.segment = p.segment + 1
LEFT JOIN r ON r.link = p.link AND r.epoch = p.epoch + 1
WHERE p.end_marker = 'create'""",

    # Append mode emits a session once the final watermark (latest event
    # time at millisecond precision minus the 10-minute delay) reaches its end.
    "session_stream": """
WITH l AS (
  SELECT user_id, ts, event_id,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
  FROM events),
s AS (
  SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
  FROM l),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events),
g AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
         CAST(count(*) AS BIGINT) AS n_events
  FROM s GROUP BY user_id, sid)
SELECT g.* FROM g WHERE g.session_end <= (SELECT wm FROM w)""",

    "session_bytes": """
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n_messages,
       CAST(sum(length(hex(props)) / 2) AS BIGINT) AS n_bytes
FROM events GROUP BY user_id, event_type""",

    "early_data": """
WITH x AS (
  SELECT user_id, ts, event_id, event_type,
         event_type IN ('signup', 'error') AS is_marker,
         coalesce(sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
  FROM events),
seg AS (
  SELECT user_id, CAST(segment AS BIGINT) AS segment,
         CAST(sum(CASE WHEN is_marker THEN 0 ELSE 1 END) AS BIGINT) AS n_early,
         max(CASE WHEN is_marker THEN event_type END) AS closing_marker
  FROM x GROUP BY user_id, segment),
j AS (
  SELECT s.*, p.closing_marker AS prev_marker
  FROM seg s LEFT JOIN seg p ON p.user_id = s.user_id AND p.segment + 1 = s.segment)
SELECT user_id, segment, n_early, closing_marker,
       CAST(CASE WHEN closing_marker = 'signup' THEN n_early % 6 ELSE 0 END AS BIGINT) AS replayed,
       CAST(n_early - n_early % 6 AS BIGINT) AS dropped,
       CAST(n_early // 6 AS BIGINT) AS resets,
       CAST(CASE WHEN closing_marker = 'error' THEN n_early % 6 ELSE 0 END AS BIGINT) AS cleared,
       CAST(CASE WHEN closing_marker IS NULL THEN n_early % 6 ELSE 0 END AS BIGINT) AS held
FROM j WHERE (prev_marker IS NULL OR prev_marker = 'error') AND n_early > 0""",

    "early_data_stream": """
WITH x AS (
  SELECT user_id, ts, event_id, event_type,
         event_type IN ('signup', 'error') AS is_marker,
         coalesce(sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
  FROM events),
seg AS (
  SELECT user_id, CAST(segment AS BIGINT) AS segment,
         CAST(sum(CASE WHEN is_marker THEN 0 ELSE 1 END) AS BIGINT) AS n_early,
         max(CASE WHEN is_marker THEN event_type END) AS closing_marker,
         max(CASE WHEN is_marker THEN ts END) AS closed_at
  FROM x GROUP BY user_id, segment),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events),
j AS (
  SELECT s.*, p.closing_marker AS prev_marker
  FROM seg s LEFT JOIN seg p ON p.user_id = s.user_id AND p.segment + 1 = s.segment)
SELECT user_id, segment, n_early, closing_marker,
       CAST(CASE WHEN closing_marker = 'signup' THEN n_early % 6 ELSE 0 END AS BIGINT) AS replayed,
       CAST(n_early - n_early % 6 AS BIGINT) AS dropped,
       CAST(n_early // 6 AS BIGINT) AS resets,
       CAST(CASE WHEN closing_marker = 'error' THEN n_early % 6 ELSE 0 END AS BIGINT) AS cleared
FROM j WHERE (prev_marker IS NULL OR prev_marker = 'error') AND n_early > 0
  AND closing_marker IS NOT NULL AND closed_at < (SELECT wm FROM w)""",

    "request_response": """
WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (
  SELECT v.event_id AS request_id, v.user_id,
         arg_min(p.event_id, p.ts) AS response_id, min(p.ts) AS rts, v.ts AS vts
  FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
  GROUP BY v.event_id, v.user_id, v.ts)
SELECT request_id, user_id, response_id,
       round(CASE WHEN response_id IS NOT NULL THEN epoch_us(rts) - epoch_us(vts) END / 1000000.0, 6) AS latency_s,
       CASE WHEN response_id IS NOT NULL THEN 'matched' ELSE 'timeout' END AS status
FROM m""",

    # Keyed-state twin: a request is emitted once the watermark (latest event
    # time at ms precision minus 10 minutes) has passed its first response, or
    # the end of its hour.
    "request_response_stream": """
WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm
      FROM events WHERE event_type IN ('view', 'purchase')),
m AS (
  SELECT v.event_id AS request_id, v.user_id,
         arg_min(p.event_id, p.ts) AS response_id, min(p.ts) AS rts, v.ts AS vts
  FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
  GROUP BY v.event_id, v.user_id, v.ts)
SELECT request_id, user_id, response_id,
       round(CASE WHEN response_id IS NOT NULL THEN epoch_us(rts) - epoch_us(vts) END / 1000000.0, 6) AS latency_s,
       CASE WHEN response_id IS NOT NULL THEN 'matched' ELSE 'timeout' END AS status
FROM m
WHERE coalesce(rts, vts + INTERVAL 1 HOUR) < (SELECT wm FROM w)""",

    "message_route_stream": f"""
WITH m AS (SELECT {d.MSG_TYPE_EXPR} AS msg_type FROM events)
SELECT CASE WHEN msg_type IN ('session_create', 'session_data', 'session_close',
                              'request_port_mappings', 'forward_data', 'tcp_forward', 'query') THEN 'agent'
            WHEN msg_type IN ('port_mapping', 'session_create_response', 'session_data_response',
                              'session_reset') THEN 'sidecar'
            ELSE 'dead_letter' END AS route,
       msg_type, CAST(count(*) AS BIGINT) AS n_messages
FROM m GROUP BY ALL""",

    "log_parse": f"""
SELECT event_id, date_trunc('millisecond', ts) AS log_ts, {d.LOGGER_EXPR} AS logger,
       {d.LEVEL_EXPR} AS level, {d.MESSAGE_EXPR} AS message
FROM events""",

    "log_rate": f"""
WITH l AS (SELECT date_trunc('minute', ts) AS minute, {d.LEVEL_EXPR} AS level,
                  {d.MESSAGE_EXPR} AS message FROM events)
SELECT minute, level, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN contains(message, 'Authentication failed') THEN 1 ELSE 0 END) AS BIGINT) AS n_auth_failed
FROM l GROUP BY minute, level""",

    # A tumbling window is emitted once the final watermark (latest log time
    # minus 2 minutes) reaches its end.
    "log_rate_stream": f"""
WITH l AS (SELECT date_trunc('minute', ts) AS minute, date_trunc('millisecond', ts) AS log_ts,
                  {d.LEVEL_EXPR} AS level, {d.MESSAGE_EXPR} AS message FROM events),
w AS (SELECT max(log_ts) - INTERVAL 2 MINUTE AS wm FROM l)
SELECT minute, level, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN contains(message, 'Authentication failed') THEN 1 ELSE 0 END) AS BIGINT) AS n_auth_failed
FROM l WHERE minute + INTERVAL 1 MINUTE <= (SELECT wm FROM w)
GROUP BY minute, level""",
}
# The same sessions, once the final watermark has passed their end.
ORACLE_SQL["session_markers_stream"] = f"""
SELECT * FROM ({ORACLE_SQL["session_markers"]})
WHERE session_end < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"""
ORACLE_SQL["auth_bursts"] = f"""
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS peer, date_trunc('minute', ts) AS minute, count(*) AS n
           FROM events WHERE event_type = 'error' GROUP BY ALL),
w AS (SELECT peer, minute, CAST(sum(n) OVER (PARTITION BY peer ORDER BY minute
        RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS n_failed FROM f)
SELECT * FROM w WHERE n_failed >= 2"""
# The same alerts, of the minutes that the final watermark (latest log time minus 2 minutes) has closed.
ORACLE_SQL["auth_bursts_stream"] = f"""
SELECT * FROM ({ORACLE_SQL["auth_bursts"]})
WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM events)"""
