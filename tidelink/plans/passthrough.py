"""Pass-through SQL surface.

The reference forwards any read statement to the remote engine, so the
relational surface a user reaches is that engine's SQL.  Spark SQL supplies
it; these conformance queries run the same text in Spark (over temp views of
the given tables) and in DuckDB.  Money is summed as exact decimals.  They avoid constructs whose plans gather a
whole group in one task (exact percentiles, windows over raw rows per key)
and NOT IN (null-aware anti join), preferring NOT EXISTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelink.tables import register_views

PASSTHROUGH_SQL = {
    "sql_rollup": """
SELECT r.r_name AS region, n.n_name AS nation,
       CAST(count(*) AS BIGINT) AS n_customers,
       CAST(round(sum(CAST(c.c_acctbal AS DECIMAL(18,2))), 2) AS DOUBLE) AS balance,
       CAST(grouping(n.n_name) AS INT) AS is_subtotal
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ROLLUP (r.r_name, n.n_name)""",

    "sql_set_ops": """
SELECT 'intersect' AS op, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') a
UNION ALL
SELECT 'except' AS op, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT c_custkey FROM customer
  EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000) b
UNION ALL
SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) c""",

    "sql_exists": """
SELECT c.c_custkey, c.c_name
FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""",

    "sql_scalar_subquery": """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_above_avg
FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
GROUP BY o_orderpriority""",

    "sql_filter_distinct": """
SELECT o_orderpriority,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_finished,
       CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers,
       CAST(count(*) AS BIGINT) AS n_orders
FROM orders GROUP BY o_orderpriority
HAVING count(*) > 0""",

    "sql_window_rank": """
WITH t AS (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey)
SELECT nat.n_name, nat.n_regionkey, t.n,
       CAST(rank() OVER (PARTITION BY nat.n_regionkey ORDER BY t.n DESC, nat.n_name) AS BIGINT) AS rnk,
       lag(t.n) OVER (PARTITION BY nat.n_regionkey ORDER BY t.n DESC, nat.n_name) AS prev_n,
       CAST(sum(t.n) OVER (PARTITION BY nat.n_regionkey ORDER BY t.n DESC, nat.n_name
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_n
FROM t JOIN nation nat ON t.c_nationkey = nat.n_nationkey""",

    "sql_full_join": """
SELECT coalesce(n.n_nationkey, s.s_nationkey) AS nationkey, n.n_name,
       CAST(coalesce(s.n_suppliers, 0) AS BIGINT) AS n_suppliers
FROM nation n
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY s_nationkey) s
  ON n.n_nationkey = s.s_nationkey""",

    "sql_revenue_by_nation": """
WITH rev AS (
  SELECT o.o_custkey,
         sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS revenue
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_returnflag = 'R'
  GROUP BY o.o_custkey)
SELECT n.n_name, CAST(count(*) AS BIGINT) AS n_customers,
       CAST(round(sum(rev.revenue), 2) AS DOUBLE) AS revenue
FROM rev
JOIN customer c ON rev.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name""",

    "sql_string_functions": """
SELECT c_custkey,
       upper(c_mktsegment) AS segment_upper,
       lower(substring(c_name, 1, 8)) AS name_head,
       regexp_replace(c_name, '[0-9]+', '#') AS name_masked,
       CAST(length(c_name) AS BIGINT) AS name_len,
       concat(c_mktsegment, '/', CAST(c_nationkey AS STRING)) AS segment_nation,
       CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band
FROM customer""",

    "sql_recursive_cte": """
WITH RECURSIVE walk(n_regionkey, n_nationkey, step) AS (
  SELECT n_regionkey, min(n_nationkey), 0 FROM nation GROUP BY n_regionkey
  UNION ALL
  SELECT w.n_regionkey, x.next_key, w.step + 1
  FROM walk w
  JOIN (SELECT n_nationkey,
               lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next_key
        FROM nation) x ON x.n_nationkey = w.n_nationkey
  WHERE x.next_key IS NOT NULL)
SELECT n_regionkey, n_nationkey, CAST(step AS BIGINT) AS step FROM walk""",

    "sql_statistics": """
SELECT o_orderpriority,
       round(stddev_samp(o_totalprice), 2) AS price_stddev,
       round(stddev_pop(o_totalprice), 2) AS price_stddev_pop,
       round(corr(o_totalprice, CAST(o_custkey AS DOUBLE)), 4) AS price_cust_corr
FROM orders GROUP BY o_orderpriority""",

    "sql_date_functions": """
SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon,
       CAST(count(*) AS BIGINT) AS n_orders,
       CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_price
FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""",
}


def passthrough_query(key: str):
    sql = PASSTHROUGH_SQL[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, ("region", "nation", "customer", "supplier", "orders", "lineitem"))
        return spark.sql(sql)

    run.__name__ = f"q_{key}"
    return run


PASSTHROUGH_QUERIES = {k: passthrough_query(k) for k in PASSTHROUGH_SQL}
