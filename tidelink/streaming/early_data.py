"""Early-data buffer accounting.

Data for a session that has not been created yet is held; when more than
``BUFFER_LIMIT`` messages are held, all of them are dropped and a reset is
requested; a create replays what is held; a close clears it.  For ``n``
early messages in a segment: replayed = n mod 6 (if a create follows),
dropped = n - n mod 6, resets = n div 6.

Per key, the log is cut into segments at create/close markers (segment
number = markers strictly before the row, computed with the skew-safe
running sum); a segment holds early data when the marker before it is a
close (or there is none).  Everything after the running sum is one partial
aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.operators.sequence import marker_segments, split_valid
from tidelink.session import state_partitions
from tidelink.streaming.waiting import NEVER, InOrder, timed

# Fixed value: held messages tolerated before the buffer is dropped.
BUFFER_LIMIT = 5


def early_data(df: DataFrame, key: str, ts: str, type_col: str, create: str, close: str,
               tiebreak=(), slices: int | None = None) -> DataFrame:
    """One row per segment that held early data; rows with a null key or time
    take no part (``split_valid`` gives them)."""
    valid, _ = split_valid(df, key, ts)
    code = F.when(F.col(type_col) == F.lit(create), 1).when(F.col(type_col) == F.lit(close), 2)
    seg = marker_segments(valid, [key], ts, code, list(tiebreak), slices)
    j = (seg.filter((F.col("open_code").isNull() | (F.col("open_code") == 2)) & (F.col("n_data") > 0))
         .withColumnRenamed("n_data", "n_early")
         .withColumn("closing_marker", F.when(F.col("end_code") == 1, F.lit(create))
                     .when(F.col("end_code") == 2, F.lit(close))))
    cycle = BUFFER_LIMIT + 1
    rem = F.col("n_early") % cycle
    return j.select(
        key, "segment", "n_early", "closing_marker",
        F.when(F.col("closing_marker") == F.lit(create), rem).otherwise(0).cast("long").alias("replayed"),
        (F.col("n_early") - rem).cast("long").alias("dropped"),
        F.floor(F.col("n_early") / cycle).cast("long").alias("resets"),
        F.when(F.col("closing_marker") == F.lit(close), rem).otherwise(0).cast("long").alias("cleared"),
        F.when(F.col("closing_marker").isNull(), rem).otherwise(0).cast("long").alias("held"),
    )


class _Segments(InOrder):
    """Segments of one key in event order.

    State beside what waits: the next segment's number, the data messages held
    in the open segment, and the code of the marker that closed the one before
    (0: none, 1: create, 2: close).  The k-th marker closes segment k, so the
    counts come from one ``bincount``.
    """

    columns = {"id": "long", "kind": "long"}

    def __init__(self, create: str, close: str, key: str):
        self.create, self.close_marker, self.key = create, close, key

    def open(self, handle):
        self.segments = handle.getValueState("segments", "segment long, held long, before int")

    def step(self, key, rows, until_us):
        kind = rows["kind"][np.lexsort((rows["id"], rows["us"]))]
        if not len(kind):
            return [], NEVER
        segment, held, before = self.segments.get() or (0, 0, 0)
        marker = kind > 0
        m = int(marker.sum())
        n = np.bincount((np.cumsum(marker) - marker)[~marker], minlength=m + 1).astype("int64")
        n[0] += held
        codes = np.concatenate([[before], kind[marker]])  # codes[i] opened the i-th of these segments, codes[i + 1] closed it
        self.segments.update((int(segment + m), int(n[m]), int(codes[m])))
        idx = np.flatnonzero((codes[:m] != 1) & (n[:m] > 0))
        if not len(idx):
            return [], NEVER
        early, created = n[idx], codes[idx + 1] == 1
        rest = early % (BUFFER_LIMIT + 1)
        return [pd.DataFrame({
            self.key: [key[0]] * len(idx),
            "segment": segment + idx,
            "n_early": early,
            "closing_marker": np.where(created, self.create, self.close_marker).astype(object),
            "replayed": np.where(created, rest, 0),
            "dropped": early - rest,
            "resets": early // (BUFFER_LIMIT + 1),
            "cleared": np.where(created, 0, rest),
        })], NEVER


def early_data_stream(spark, source_dir: str, file_glob: str, schema, key: str, ts: str,
                      order_col: str, type_col: str, create: str, close: str, watermark: str, out_dir: str,
                      checkpoint_dir: str, max_files: int = 100, partitions: int | None = None):
    """Streaming twin: keyed state per ``key`` (``transformWithState``).

    Messages may arrive out of order by up to ``watermark``: they wait in the
    state until it has passed them and are then taken in order of ``ts`` and
    ``order_col``.  Closed segments are given once the watermark has passed
    their closing marker; ``state.open_state`` reads what is still held.
    """
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir)
              .filter(F.col(key).isNotNull() & F.col(ts).isNotNull()))
    code = F.when(F.col(type_col) == F.lit(create), 1).when(F.col(type_col) == F.lit(close), 2).otherwise(0)
    rows = timed(stream, ts, watermark, F.col(key).alias("key"), F.col(order_col).cast("long").alias("id"), code.cast("long").alias("kind"))
    out_schema = (f"{key} {stream.schema[key].dataType.simpleString()}, segment long, n_early long, closing_marker string, "
                  "replayed long, dropped long, resets long, cleared long")
    result = rows.groupBy("key").transformWithStateInPandas(_Segments(create, close, key), out_schema, "append", "eventTime")
    with state_partitions(spark, partitions, rocksdb=True):
        q = (result.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out_schema).parquet(out_dir)
