"""Request/response correlation with a timeout.

Each request is matched with the first response of the same key at or
after it; no response within ``within`` means a timeout.

Batch form: an as-of ("next response") scan per key via the skew-safe
two-level window - linear in the input, no pairs within a key are formed.
Stream form: keyed state holding requests and responses until the watermark
settles them - again one row per request, never request x response pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelink.functions.temporal import interval, seconds_between
from tidelink.operators.sequence import split_valid, with_next
from tidelink.session import state_partitions
from tidelink.streaming.waiting import NEVER, InOrder, Waiting, timed


def first_response(requests: DataFrame, responses: DataFrame, key: str, ts: str, id_col: str,
                   within: str, slices: int | None = None) -> DataFrame:
    """``request_id, key, response_id, latency_s, status`` per request.

    Rows with a null key or time take no part (``split_valid`` gives them).
    """
    req = requests.select(key, ts, id_col, F.lit(0).alias("_resp"))
    rsp = responses.select(key, ts, id_col, F.lit(1).alias("_resp"))
    return _first_response(req.unionByName(rsp), key, ts, id_col, within, slices)


def first_response_in_log(log: DataFrame, key: str, ts: str, id_col: str, type_col: str, request_type: str,
                          response_type: str, within: str, slices: int | None = None) -> DataFrame:
    """The same where both stand in one log, told apart by ``type_col``: one scan."""
    both = log.filter(F.col(type_col).isin(request_type, response_type)).select(
        key, ts, id_col, (F.col(type_col) == F.lit(response_type)).cast("int").alias("_resp"))
    return _first_response(both, key, ts, id_col, within, slices)


def _first_response(both: DataFrame, key: str, ts: str, id_col: str, within: str, slices: int | None) -> DataFrame:
    # Order (ts, requests before responses, id): a response at the same
    # instant counts as after the request.
    valid, _ = split_valid(both, key, ts)
    d = with_next(valid, [key], ts, F.col("_resp") == 1, ts, id_col, out="_nx",
                  tiebreak=["_resp", id_col], slices=slices)
    d = d.filter(F.col("_resp") == 0)
    hit = F.col("_nx").isNotNull() & (F.col("_nx.ts") <= F.col(ts) + interval(within))
    return d.select(
        F.col(id_col).alias("request_id"), key,
        F.when(hit, F.col("_nx.id")).alias("response_id"),
        F.when(hit, F.round(seconds_between(F.col(ts), F.col("_nx.ts")), 6)).alias("latency_s"),
        F.when(hit, F.lit("matched")).otherwise(F.lit("timeout")).alias("status"),
    )


class _Responses(InOrder):
    """Requests and responses of one key in event order.

    A request that no response has followed yet is pending: appended once,
    taken by the first response after it or by the end of its horizon.  One
    row per request, no request x response pairs.
    """

    columns = {"id": "long", "response": "long"}

    def __init__(self, key: str, within_us: int):
        self.key, self.within_us = key, within_us

    def open(self, handle):
        self.pending = Waiting(handle, "pending", {"id": "long"})

    def _settled(self, key, us, ids, response_us, response_id):
        """A frame of requests, each with the first response after it (time NEVER: none)."""
        hit = response_us <= us + self.within_us
        return pd.DataFrame({
            "request_id": ids,
            self.key: [key[0]] * len(ids),
            "response_id": pd.array(np.where(hit, response_id, None), dtype="Int64"),
            "latency_s": pd.array([round(v / 1e6, 6) if h else None for v, h in zip((response_us - us).tolist(), hit)], dtype="Float64"),
            "status": np.where(hit, "matched", "timeout").astype(object),
        })

    def step(self, key, rows, until_us):
        order = np.lexsort((rows["id"], rows["response"], rows["us"]))  # a response at a request's instant follows it
        us, ids, response = (rows[c][order] for c in ("us", "id", "response"))
        answers = np.flatnonzero(response)
        frames = []
        if len(answers):
            before, _ = self.pending.take(NEVER)
            if len(before["us"]):
                frames.append(self._settled(key, before["us"], before["id"], us[answers[0]], ids[answers[0]]))
        asked = np.flatnonzero(response == 0)
        following = np.searchsorted(answers, asked)
        met = following < len(answers)
        if met.any():
            answer = answers[following[met]]
            frames.append(self._settled(key, us[asked[met]], ids[asked[met]], us[answer], ids[answer]))
        if not met.all():
            self.pending.add({"us": us[asked[~met]], "id": ids[asked[~met]]})
        late, due = self.pending.take(until_us - self.within_us)
        if len(late["us"]):
            frames.append(self._settled(key, late["us"], late["id"], np.int64(NEVER), np.int64(0)))
        return frames, min(due + self.within_us, NEVER)


def first_response_stream(spark: SparkSession, source_dir: str, file_glob: str, schema, key: str,
                          ts: str, id_col: str, type_col: str, request_type: str, response_type: str,
                          within_seconds: int, watermark: str, out_dir: str, checkpoint_dir: str,
                          max_files: int = 100, partitions: int | None = None) -> DataFrame:
    """Streaming twin of ``first_response`` with keyed state
    (``transformWithState``, event-time timers), right for any arrival
    order within ``watermark``.  State per key holds the messages that the
    watermark has not passed and the requests still without a response, each
    written once; ``state.open_state`` reads them (``waiting``, ``pending``)."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir)
              .filter(F.col(type_col).isin(request_type, response_type) & F.col(key).isNotNull() & F.col(ts).isNotNull()))
    rows = timed(stream, ts, watermark, F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"),
                 (F.col(type_col) == F.lit(response_type)).cast("long").alias("response"))
    out_schema = (f"request_id long, {key} {stream.schema[key].dataType.simpleString()}, response_id long, latency_s double, "
                  "status string")
    result = rows.groupBy("key").transformWithStateInPandas(
        _Responses(key, within_seconds * 1_000_000), out_schema, "append", "eventTime")
    with state_partitions(spark, partitions, rocksdb=True):
        q = (result.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out_schema).parquet(out_dir)
