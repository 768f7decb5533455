"""Service log monitoring: format, parse, per-minute rates, bursts of failed logins.

Line format ``<asctime> - <logger> - <LEVEL> - <message>`` with
``asctime`` = ``yyyy-MM-dd HH:mm:ss,SSS``; the message may itself contain
`` - ``, so only the first three separators split.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidelink.functions.temporal import instant_to_ntz, ntz_to_instant, tumbling_start
from tidelink.operators.moving import moving_sums
from tidelink.session import state_partitions
from tidelink.streaming.waiting import timed

ASCTIME = "yyyy-MM-dd HH:mm:ss,SSS"
ASCTIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}$"
LEVEL_PATTERN = r"^[A-Z]+$"
# Log messages that mark authentication outcomes.
READY_MARKER = "authenticated and ready"
AUTH_FAILED_MARKER = "Authentication failed"
_MINUTE_US, _MINUTE_MS = 60_000_000, 60_000


def format_line(ts, logger, level, message):
    return F.concat_ws(" - ", F.date_format(ts, ASCTIME), logger, level, message)


def parse_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Split each line on its first three separators (one pass, no regex
    captures); lines not in the format keep nulls instead of failing the job.
    The time is parsed as UTC wall clock with ``try_to_timestamp`` (an
    impossible date gives null, not an error) and kept as ``timestamp_ntz``."""
    parts = F.split(F.col(line_col), " - ", 4)
    ok = ((F.size(parts) == 4) & parts.getItem(0).rlike(ASCTIME_PATTERN)
          & parts.getItem(2).rlike(LEVEL_PATTERN))
    return df.select(
        *[c for c in df.columns if c != line_col],
        F.when(ok, instant_to_ntz(F.try_to_timestamp(
            F.concat(parts.getItem(0), F.lit("Z")), F.lit(ASCTIME + "X")))).alias("log_ts"),
        F.when(ok, parts.getItem(1)).alias("logger"),
        F.when(ok, parts.getItem(2)).alias("level"),
        F.when(ok, parts.getItem(3)).alias("message"),
    )


def with_auth_flags(parsed: DataFrame) -> DataFrame:
    return (parsed.withColumn("auth_ready", F.col("message").contains(READY_MARKER))
            .withColumn("auth_failed", F.col("message").contains(AUTH_FAILED_MARKER)))


def log_rate(parsed: DataFrame, width: str = "1 minute") -> DataFrame:
    """Lines per tumbling window and level, with failed-auth counts."""
    flagged = with_auth_flags(parsed)
    return (flagged.groupBy(tumbling_start("log_ts", width).alias("minute"), "level")
            .agg(F.count(F.lit(1)).cast("long").alias("n_lines"),
                 F.sum(F.col("auth_failed").cast("long")).cast("long").alias("n_auth_failed")))


def log_rate_stream(spark: SparkSession, lines: DataFrame, out_dir: str, checkpoint_dir: str,
                    width: str = "1 minute", watermark: str = "2 minutes",
                    partitions: int | None = None) -> DataFrame:
    """Streaming twin of ``log_rate`` over a streaming DataFrame of lines."""
    parsed = with_auth_flags(parse_lines(lines))
    parsed = parsed.withColumn("_t", ntz_to_instant("log_ts")).withWatermark("_t", watermark)
    agg = (parsed.groupBy(F.window("_t", width).alias("w"), "level")
           .agg(F.count(F.lit(1)).cast("long").alias("n_lines"),
                F.sum(F.col("auth_failed").cast("long")).cast("long").alias("n_auth_failed")))
    out = agg.select(instant_to_ntz(F.col("w.start")).alias("minute"), "level", "n_lines", "n_auth_failed")
    with state_partitions(spark, partitions):
        q = (out.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_dir)


def failed_peer() -> Column:
    """The peer that a failed login names; null for other messages."""
    peer = F.regexp_extract("message", AUTH_FAILED_MARKER + r".*\bpeer (\S+)", 1)
    return F.when(F.col("message").contains(AUTH_FAILED_MARKER) & (peer != ""), peer)


def auth_bursts(parsed: DataFrame, minutes: int, least: int, slices: int | None = None) -> DataFrame:
    """``peer, minute, n_failed``: minutes with a failed login of a peer in which it had ``least`` or more
    in this minute and the ``minutes - 1`` before.  A peer with very many failures is cut into slices."""
    failed = parsed.select(failed_peer().alias("peer"), tumbling_start("log_ts", "1 minute").alias("minute")).dropna()
    counts = failed.groupBy("peer", "minute").agg(F.count(F.lit(1)).alias("_failed"))
    moved = moving_sums(counts, ["peer"], "minute", (minutes - 1) * _MINUTE_US, "_failed", "_minutes", "n_failed", slices)
    return moved.filter(F.col("n_failed") >= least).select("peer", "minute", F.col("n_failed").cast("long").alias("n_failed"))


class _Ring(StatefulProcessor):
    """Failed logins of one peer in its last closed minutes, for as many minutes as an alert looks back.

    A micro-batch brings the counts of the minutes that it closes.  They are
    summed in one pass; only those that a later minute looks back to are kept.
    """

    def __init__(self, minutes: int, least: int):
        self.minutes, self.least = minutes, least

    def init(self, handle):
        self.handle = handle
        self.counts = handle.getMapState("minutes", "minute long", "n long")

    def _keep(self, known, new, timerValues):  # noqa: N803
        """Write what a minute that is still open looks back to, and wake when the first of it is of no more use."""
        oldest = timerValues.getCurrentWatermarkInMs() // _MINUTE_MS - self.minutes + 1
        for minute in known:
            if minute < oldest:
                self.counts.removeKey((minute,))
        for minute, n in new.items():
            if minute >= oldest:
                self.counts.updateValue((minute,), (n,))
        first = min((minute for minute in (*known, *new) if minute >= oldest), default=None)
        if first is not None:
            self.handle.registerTimer((first + self.minutes) * _MINUTE_MS)

    def _known(self):
        return {minute: n for (minute,), (n,) in self.counts.iterator()}

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known, new = self._known(), {r["minute"]: r["n"] for r in rows}
        frame, total, alerts = deque(), 0, []
        for minute, n in sorted((known | new).items()):
            frame.append((minute, n))
            total += n
            while frame[0][0] <= minute - self.minutes:
                total -= frame.popleft()[1]
            if minute in new and total >= self.least:
                alerts.append(Row(peer=key[0], us=minute * _MINUTE_US, n_failed=total))
        self._keep(known, new, timerValues)
        return iter(alerts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._keep(self._known(), {}, timerValues)
        return iter(())

    def close(self):
        pass


def auth_bursts_stream(spark: SparkSession, lines: DataFrame, minutes: int, least: int, out_dir: str, checkpoint_dir: str,
                       watermark: str = "2 minutes", partitions: int | None = None) -> DataFrame:
    """Streaming twin of ``auth_bursts`` (``transformWithState``): alerts of the minutes that the watermark has closed.

    Failed logins are counted by peer and minute (a windowed aggregation); the counts of closed minutes go on to a
    ring per peer.  Every line of the log moves the watermark.
    """
    parsed = parse_lines(lines)
    rows = timed(parsed.withColumn("peer", failed_peer()), "log_ts", watermark, "peer")
    # Names the instant, so that the filter stays above the watermark.
    rows = rows.filter(F.when(F.col("instant").isNotNull(), F.col("peer").isNotNull()))
    counts = rows.groupBy("peer", F.window("instant", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    closed = counts.select("peer", F.window_time("w").alias("instant"), F.expr(f"unix_micros(w.start) div {_MINUTE_US}").alias("minute"), "n")
    found = closed.groupBy("peer").transformWithState(_Ring(minutes, least), "peer string, us long, n_failed long", "append", "eventTime")
    out = found.select("peer", instant_to_ntz(F.timestamp_micros("us")).alias("minute"), "n_failed")
    with state_partitions(spark, partitions, rocksdb=True):
        q = (out.writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_dir)
