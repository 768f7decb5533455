"""Session reconstruction from a message/event log.

Batch form: gap-based sessions computed within (key, slice of rows) plus a
small summary per slice (see ``tidelink.operators.sequence``), so one very
active key is still split over many tasks.  Stream form: ``session_window`` with a watermark, emitted in
append mode once a session can no longer grow.  Sessions cut by markers have a batch form of the same kind
and a stream form on keyed state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelink.functions.temporal import instant_to_ntz, interval, ntz_to_instant
from tidelink.operators.sequence import SLICE, marker_segments, slice_rows, split_valid, with_running_sum
from tidelink.session import state_partitions
from tidelink.streaming.waiting import NEVER, InOrder, timed

DEFAULT_GAP = "30 minutes"


def sessionize(df: DataFrame, key: str, ts: str, gap: str = DEFAULT_GAP, tiebreak=(),
               slices: int | None = None) -> DataFrame:
    """Add ``session_seq`` (1, 2, ... per key): a new session starts when the
    time since the key's previous row is at least ``gap``.

    Rows with a null key or time belong to no session; ``split_valid(df, key,
    ts)[1]`` gives them.
    """
    g = interval(gap)
    order = [F.col(ts), *[F.col(c) for c in tiebreak]]
    w = Window.partitionBy(key, SLICE).orderBy(*order)
    valid, _ = split_valid(df, key, ts)
    a = slice_rows(valid, [key], ts, list(tiebreak), slices).withColumn("_lag", F.lag(ts).over(w))
    a = a.withColumn("_brk", (F.col("_lag").isNotNull() & (F.col(ts) >= F.col("_lag") + g)).cast("long"))
    a = a.withColumn("_lc", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Same keys as the window: this aggregation needs no further shuffle.
    summ = a.groupBy(key, SLICE).agg(F.min(ts).alias("_bmin"), F.max(ts).alias("_bmax"),
                                     F.max("_lc").alias("_bbrk"))
    wk = Window.partitionBy(key).orderBy(SLICE)
    summ = (summ.withColumn("_pmax", F.lag("_bmax").over(wk))
            .withColumn("_first", (F.col("_pmax").isNull()
                                   | (F.col("_bmin") >= F.col("_pmax") + g)).cast("long"))
            .withColumn("_starts", F.col("_first") + F.col("_bbrk"))
            .withColumn("_off", F.coalesce(
                F.sum("_starts").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    j = a.join(summ.select(key, SLICE, "_first", "_off"), [key, SLICE], "inner")
    return (j.withColumn("session_seq", (F.col("_off") + F.col("_first") + F.col("_lc")).cast("long"))
            .drop(SLICE, "_lag", "_brk", "_lc", "_first", "_off"))


def sessions(df: DataFrame, key: str, ts: str, gap: str = DEFAULT_GAP, tiebreak=(),
             slices: int | None = None) -> DataFrame:
    """One row per session: start, end (= last event + gap), event count."""
    s = sessionize(df, key, ts, gap, tiebreak, slices)
    return (s.groupBy(key, "session_seq")
            .agg(F.min(ts).alias("session_start"),
                 (F.max(ts) + interval(gap)).alias("session_end"),
                 F.count(F.lit(1)).cast("long").alias("n_events")))


def session_stream(spark: SparkSession, source_dir: str, file_glob: str, schema, key: str,
                   ts: str, out_dir: str, checkpoint_dir: str, gap: str = DEFAULT_GAP,
                   watermark: str = "10 minutes", max_files: int = 100,
                   partitions: int | None = None) -> DataFrame:
    """Sessions from a file stream; runs all available input and returns the
    closed sessions read back from the sink.  Sessions that may still grow stay
    in the state: ``state.open_state(spark, checkpoint_dir)`` reads them."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", max_files).parquet(source_dir))
    stream = stream.withColumn("_t", ntz_to_instant(ts)).withWatermark("_t", watermark)
    agg = stream.groupBy(F.col(key), F.session_window("_t", gap).alias("sw")).agg(
        F.count(F.lit(1)).cast("long").alias("n_events"))
    out = agg.select(key, instant_to_ntz(F.col("sw.start")).alias("session_start"),
                     instant_to_ntz(F.col("sw.end")).alias("session_end"), "n_events")
    with state_partitions(spark, partitions):
        q = (out.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_dir)


def link_epochs(df: DataFrame, link: str, ts: str, is_reconnect, tiebreak=(), slices: int | None = None) -> DataFrame:
    """Add ``epoch``: how many reconnects of its link lie at or before a row (reconnects first at one instant)."""
    flagged = df.withColumn("_up", F.when(is_reconnect, F.lit(0)).otherwise(F.lit(1)))
    return with_running_sum(flagged, [link], ts, F.lit(1) - F.col("_up"), out="epoch", inclusive=True,
                            tiebreak=["_up", *tiebreak], slices=slices).drop("_up")


def marker_sessions(df: DataFrame, key: str, ts: str, type_col: str, create: str, ends: dict[str, str],
                    link: str | None = None, reconnect: str | None = None, tiebreak=(),
                    slices: int | None = None) -> DataFrame:
    """Sessions delimited by explicit markers: a ``create`` opens one, data
    extends it, a marker of ``ends`` (type -> reason) or another ``create`` ends it.

    With ``link`` and ``reconnect``, a row of that type ends all open sessions
    of its link: rows are numbered by the reconnects of their link so far, and
    sessions are cut within (key, epoch).  Rows with a null key, link, time or
    type belong to no session (``split_valid`` gives them).
    """
    needed = [key, ts, type_col, *([link] if link else [])]
    rows, _ = split_valid(df, *needed)
    keys = [key]
    times = None
    if link:
        rows = link_epochs(rows, link, ts, F.col(type_col) == F.lit(reconnect), tiebreak, slices)
        times = rows.filter(F.col(type_col) == F.lit(reconnect)).select(
            link, (F.col("epoch") - 1).alias("epoch"), F.col(ts).alias("_cut"))
        rows = rows.filter(F.col(type_col) != F.lit(reconnect))
        keys = [key, link, "epoch"]
    reasons = {1: "recreated", **{i: r for i, r in enumerate(ends.values(), 2)}}
    code = F.when(F.col(type_col) == F.lit(create), 1)
    for i, name in enumerate(ends, 2):
        code = code.when(F.col(type_col) == F.lit(name), i)
    seg = marker_segments(rows, keys, ts, code, list(tiebreak), slices).filter(F.col("open_code") == 1)
    reason = F.coalesce(*[F.when(F.col("end_code") == i, F.lit(r)) for i, r in reasons.items()])
    if times is None:
        return seg.select(key, "segment", F.col("open_ts").alias("session_start"), F.col("end_ts").alias("session_end"),
                          "n_data", F.coalesce(reason, F.lit("open")).alias("end_reason"))
    seg = seg.join(times, [link, "epoch"], "left")
    cut = F.when(F.col("_cut").isNotNull(), F.lit("reconnect")).otherwise(F.lit("open"))
    return seg.select(key, "epoch", "segment", F.col("open_ts").alias("session_start"),
                      F.coalesce("end_ts", "_cut").alias("session_end"), "n_data",
                      F.coalesce(reason, cut).alias("end_reason"))


_DATA, _CREATE, _RECONNECT = 0, 1, -1
_CUT = "reconnect"


class _Markers(InOrder):
    """Marker sessions of the keys in one bucket of a link, in event order.

    State beside what waits: the link's epoch, the open sessions by key, and
    how many markers each key had in this epoch.  A step reads and writes the
    entries of the keys that its messages name, and all open ones only when
    the link reconnects, which ends them.
    """

    def __init__(self, reasons: dict[int, str], kind: str, out: str):
        self.reasons, self.kind, self.out = reasons, kind, out
        self.columns = {"id": "long", "code": "long", "owner": kind}

    def open(self, handle):
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.sessions = handle.getMapState("open", f"owner {self.kind}", "segment long, start long, n_data long")
        self.marks = handle.getMapState("marks", f"owner {self.kind}", "n long")

    def step(self, key, rows, until_us):
        order = np.lexsort((rows["id"], rows["code"] != _RECONNECT, rows["us"]))
        us, code, owner = (rows[c][order].tolist() for c in ("us", "code", "owner"))
        if not us:
            return [], NEVER
        epoch = (self.epoch.get() or (0,))[0]
        sessions, marks, out = {}, {}, []
        emptied = False  # the stored maps hold nothing that still counts

        def end(name, at, reason):
            segment, start, n_data = sessions[name]
            out.append((name, epoch, segment, start, at, n_data, reason))

        for t, c, name in zip(us, code, owner):
            if c == _RECONNECT:
                if not emptied:
                    for (stored,), value in self.sessions.iterator():
                        sessions.setdefault(stored, value)
                    self.sessions.clear()
                    self.marks.clear()
                    emptied = True
                for open_one in [n for n, v in sessions.items() if v]:
                    end(open_one, t, _CUT)
                sessions, marks, epoch = {}, {}, epoch + 1
                continue
            if name not in sessions:
                sessions[name] = None if emptied else self.sessions.getValue((name,))
            if c == _DATA:
                if sessions[name]:
                    segment, start, n_data = sessions[name]
                    sessions[name] = (segment, start, n_data + 1)
                continue
            if name not in marks:
                marks[name] = 0 if emptied else (self.marks.getValue((name,)) or (0,))[0]
            marks[name] += 1
            if sessions[name]:
                end(name, t, self.reasons[c])
            sessions[name] = (marks[name], t, 0) if c == _CREATE else None
        self.epoch.update((epoch,))
        for name, value in sessions.items():
            if value:
                self.sessions.updateValue((name,), value)
            elif not emptied:
                self.sessions.removeKey((name,))
        for name, n in marks.items():
            self.marks.updateValue((name,), (n,))
        columns = [self.out, "epoch", "segment", "start", "end", "n_data", "end_reason"]
        return ([pd.DataFrame(out, columns=columns)] if out else []), NEVER


def marker_sessions_stream(spark: SparkSession, source_dir: str, file_glob: str, schema, derive, key: str, ts: str, order_col: str,
                           type_col: str, create: str, ends: dict[str, str], watermark: str, out_dir: str, checkpoint_dir: str,
                           link: str | None = None, reconnect: str | None = None, buckets: int = 16, max_files: int = 100,
                           partitions: int | None = None) -> DataFrame:
    """Streaming twin of ``marker_sessions`` (``transformWithState``): ended sessions, from ``derive`` of a file stream.

    State is keyed by (link, bucket of the key), so a link's sessions spread
    over ``buckets`` tasks, and every bucket gets the link's few reconnects.
    Messages may arrive in any order within ``watermark``; a session is given
    once the watermark has passed its end.  ``state.open_state`` reads what is
    left (``waiting``, ``open``).  ``buckets`` is fixed for a checkpoint's life.
    """
    stream = derive(spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
                    .option("maxFilesPerTrigger", max_files).parquet(source_dir))
    needed = [key, ts, type_col, *([link] if link else [])]
    rows, _ = split_valid(stream, *needed)
    reasons = {_CREATE: "recreated", **{i: r for i, r in enumerate(ends.values(), 2)}}
    code = F.when(F.col(type_col) == F.lit(create), _CREATE)
    for i, name in enumerate(ends, 2):
        code = code.when(F.col(type_col) == F.lit(name), i)
    if link:
        code = code.when(F.col(type_col) == F.lit(reconnect), _RECONNECT)
    code = code.otherwise(_DATA).cast("long")
    own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    where = F.when(code == _RECONNECT, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(own))
    given = timed(rows, ts, watermark, F.col(link) if link else F.lit(0).alias("link"), F.explode(where).alias("bucket"),
                  F.col(order_col).cast("long").alias("id"), code.alias("code"), F.col(key).alias("owner"))
    kind = stream.schema[key].dataType.simpleString()
    state_schema = f"{key} {kind}, epoch long, segment long, start long, end long, n_data long, end_reason string"
    found = given.groupBy(link or "link", "bucket").transformWithStateInPandas(
        _Markers(reasons, kind, key), state_schema, "append", "eventTime")
    out = found.select(key, "epoch", "segment", instant_to_ntz(F.timestamp_micros("start")).alias("session_start"),
                       instant_to_ntz(F.timestamp_micros("end")).alias("session_end"), "n_data", "end_reason")
    with state_partitions(spark, partitions, rocksdb=True):
        q = (out.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_dir)
