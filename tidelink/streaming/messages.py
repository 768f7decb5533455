"""Message-log jobs: type routing with a dead letter, bytes moved per
session, and the stream fan-out sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.functions.codec import hex_byte_length, to_hex

# Message types each side of the link handles.
AGENT_TYPES = (
    "session_create", "session_data", "session_close", "request_port_mappings",
    "forward_data", "tcp_forward", "query",
)
SIDECAR_TYPES = (
    "port_mapping", "session_create_response", "session_data_response", "session_reset",
)
DEAD_LETTER = "dead_letter"


def with_route(df: DataFrame, type_col: str = "msg_type") -> DataFrame:
    t = F.col(type_col)
    route = (F.when(t.isin(*AGENT_TYPES), F.lit("agent"))
             .when(t.isin(*SIDECAR_TYPES), F.lit("sidecar"))
             .otherwise(F.lit(DEAD_LETTER)))
    return df.withColumn("route", route)


def route_counts(messages: DataFrame, type_col: str = "msg_type") -> DataFrame:
    return (with_route(messages, type_col)
            .groupBy("route", F.col(type_col).alias("msg_type"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_messages")))


def fan_out_writer(out_dir: str):
    """``foreachBatch`` function writing each micro-batch split by route.

    The batch id is part of the path and the write overwrites it, so a
    replayed batch (after a failure) replaces rather than duplicates output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (with_route(batch).write.mode("overwrite").partitionBy("route")
         .parquet(f"{out_dir.rstrip('/')}/batch={batch_id}"))
    return write


def with_payload(df: DataFrame, data_col: str) -> DataFrame:
    """Hex payload as carried on the wire and the byte count it stands for."""
    return (df.withColumn("payload_hex", to_hex(F.col(data_col)))
            .withColumn("n_bytes", hex_byte_length(F.col("payload_hex"))))


def bytes_per_session(messages: DataFrame, session_cols, type_col: str) -> DataFrame:
    return (messages.groupBy(*session_cols, type_col)
            .agg(F.count(F.lit(1)).cast("long").alias("n_messages"),
                 F.sum("n_bytes").cast("long").alias("n_bytes")))


def route_stream(spark, source_dir: str, file_glob: str, schema, derive, out_dir: str,
                 checkpoint_dir: str, max_files: int = 1):
    """Route a message stream: each micro-batch is split by route (agent,
    sidecar, dead letter) in one partitioned write; returns the routed rows
    read back from the sink."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir))
    routed = with_route(derive(stream))
    schema = routed.schema.add("batch", "long")
    # The sink exists from the start, so a stream without rows reads back as an empty table.
    spark.createDataFrame([], routed.drop("route").schema).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch=-1/route={DEAD_LETTER}")
    q = (derive(stream).writeStream.foreachBatch(fan_out_writer(out_dir))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out_dir)
