"""Link inventory: port -> protocol lookup, per-port connection counts,
per-source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelink.functions.temporal import ntz_micros


# Well-known port -> protocol, everything else is 'unknown'.
PORT_PROTOCOLS = (
    (5432, "postgresql"),
    (5433, "postgresql"),
    (3306, "mysql"),
    (3307, "mysql"),
    (1433, "mssql"),
    (1521, "oracle"),
    (27017, "mongodb"),
    (27018, "mongodb"),
    (6379, "redis"),
    (11211, "memcached"),
    (5672, "rabbitmq"),
    (9092, "kafka"),
    (8181, "iceberg-rest"),
    (9000, "s3"),
    (9001, "s3-console"),
    (8080, "http"),
    (8888, "http"),
    (8000, "http"),
    (9200, "elasticsearch"),
    (9300, "elasticsearch"),
)
UNKNOWN = "unknown"


def protocol_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PORT_PROTOCOLS), "port int, protocol string")


def with_protocol(df: DataFrame, port_col: str = "port") -> DataFrame:
    """Add ``protocol`` for ``port_col``; the lookup table has 20 rows."""
    ports = F.broadcast(protocol_table(df.sparkSession)
                        .withColumnRenamed("port", "_lp"))
    return (df.join(ports, F.col(port_col) == F.col("_lp"), "left")
            .withColumn("protocol", F.coalesce(F.col("protocol"), F.lit(UNKNOWN)))
            .drop("_lp"))


def connection_inventory(connections: DataFrame, port_col: str = "port") -> DataFrame:
    """One row per port: protocol, lifetime connection count, number of ports.

    The counter in the reference is only ever incremented, so the figure is
    a lifetime count.  Counting is a partial aggregation; the final
    ``count(*) over ()`` runs over one row per port (at most 65,536 rows).
    """
    per_port = connections.groupBy(F.col(port_col).alias("port")).agg(
        F.count(F.lit(1)).cast("long").alias("active_connections"))
    per_port = with_protocol(per_port, "port")
    total = F.count(F.lit(1)).over(Window.partitionBy()).cast("long")
    return per_port.withColumn("total_count", total).orderBy("port")


def source_health(events: DataFrame, source_col: str, ts_col: str, state_col: str,
                  port_col: str, down_state: str, states) -> DataFrame:
    """Per source: healthy iff the last state is not ``down_state`` and it
    has at least one port.

    ``states`` lists the state names (at most 63; others count as no state).
    Time and state go into one long, micros * 64 + number of the state in
    sorted order, whose maximum is the last state (ties at one instant: the
    largest).  So one scan with fixed-width hash aggregation answers all.
    """
    names = sorted(states)
    if len(names) > 63:
        raise ValueError("at most 63 states")
    code = F.coalesce(*[F.when(F.col(state_col) == F.lit(n), F.lit(i)) for i, n in enumerate(names, 1)], F.lit(0))
    out = events.groupBy(source_col).agg(
        F.max(ntz_micros(ts_col) * 64 + code).alias("_last"),
        F.count_distinct(port_col).cast("long").alias("active_ports"),
        F.count(F.lit(1)).cast("long").alias("n_events"))
    state = F.try_element_at(F.array(*[F.lit(n) for n in names]), F.pmod(F.col("_last"), F.lit(64)).cast("int"))
    state = F.when(F.pmod(F.col("_last"), F.lit(64)) > 0, state)
    out = out.withColumn("last_state", state).drop("_last")
    healthy = F.coalesce(F.col("last_state") != F.lit(down_state), F.lit(False)) & (F.col("active_ports") >= 1)
    return out.withColumn("status", F.when(healthy, "healthy").otherwise("degraded"))
