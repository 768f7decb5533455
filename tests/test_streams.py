"""Sessions, early data, correlation, logs: goldens, skew invariance, and
streaming twins compared with their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tidelink.operators import sequence
from tidelink.operators.sequence import with_next, with_prev, with_running_sum
from tidelink.session import shared_dir
from tidelink.streaming import correlate, early_data, logs, messages, sessions, state
from tidelink.tables import read_table

T0 = datetime(2024, 1, 1)
EV = "user_id long, ts timestamp_ntz, event_id long, event_type string"


def _events(spark, rows):
    return spark.createDataFrame(rows, EV)


@pytest.mark.parametrize("n,expected", [(0, None), (5, (5, 0, 0)), (6, (0, 6, 1)), (7, (1, 6, 1)), (13, (1, 12, 2))])
def test_early_data_golden(spark, n, expected):
    rows = [(1, T0 + timedelta(seconds=i), i, "data") for i in range(n)]
    rows.append((1, T0 + timedelta(seconds=n), n, "create"))
    out = early_data.early_data(_events(spark, rows), "user_id", "ts", "event_type", "create", "close",
                                tiebreak=("event_id",)).collect()
    if expected is None:
        assert out == []
    else:
        assert [(r.replayed, r.dropped, r.resets) for r in out] == [expected]


def test_early_data_close_clears_and_open_session_not_early(spark):
    rows = [(1, T0, 0, "data"), (1, T0 + timedelta(seconds=1), 1, "close"),
            (1, T0 + timedelta(seconds=2), 2, "create"), (1, T0 + timedelta(seconds=3), 3, "data"),
            (1, T0 + timedelta(seconds=4), 4, "close"), (1, T0 + timedelta(seconds=5), 5, "data")]
    out = early_data.early_data(_events(spark, rows), "user_id", "ts", "event_type", "create", "close",
                                tiebreak=("event_id",)).orderBy("segment").collect()
    assert [(r.segment, r.n_early, r.cleared, r.held) for r in out] == [(0, 1, 1, 0), (3, 1, 0, 1)]


def test_correlation_golden(spark):
    req = spark.createDataFrame([(1, T0, 10), (2, T0, 20), (3, T0, 30)], "user_id long, ts timestamp_ntz, event_id long")
    rsp = spark.createDataFrame([(1, T0 + timedelta(seconds=29), 11), (2, T0 + timedelta(seconds=31), 21),
                                 (9, T0, 99)], "user_id long, ts timestamp_ntz, event_id long")
    out = {r.request_id: (r.response_id, r.status) for r in
           correlate.first_response(req, rsp, "user_id", "ts", "event_id", "30 seconds").collect()}
    assert out == {10: (11, "matched"), 20: (None, "timeout"), 30: (None, "timeout")}


def _skewed(spark):
    """One hot key with most rows spread over many buckets, plus small keys."""
    hot = spark.range(0, 3000).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("event_id"),
                                      (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(
                                          secs=(F.col("id") * 37 % 86400).cast("decimal(18,6)"))).alias("ts"))
    small = spark.range(0, 300).select((F.col("id") % 7 + 1).alias("k"), (F.col("id") + 10_000).alias("event_id"),
                                       (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(
                                           secs=(F.col("id") * 611).cast("decimal(18,6)"))).alias("ts"))
    return hot.unionByName(small).withColumn("flag", (F.col("event_id") % 3 == 0))


@pytest.mark.parametrize("slices", [1, 7])
def test_sequence_helpers_match_plain_windows(spark, slices):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    plain = (df.withColumn("p", F.lag("ts").over(w))
             .withColumn("s", F.sum(F.col("flag").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("n", F.first(F.when(F.col("flag"), F.col("event_id")), ignorenulls=True)
                         .over(w.rowsBetween(1, Window.unboundedFollowing)))
             .select("event_id", "p", F.coalesce("s", F.lit(0)).alias("s"), "n"))
    ours = with_prev(df, ["k"], "ts", out="p", tiebreak=["event_id"], slices=slices)
    ours = with_running_sum(ours, ["k"], "ts", "flag", out="s", inclusive=False, tiebreak=["event_id"], slices=slices)
    ours = with_next(ours, ["k"], "ts", F.col("flag"), "ts", "event_id", out="n",
                     tiebreak=["event_id"], slices=slices)
    ours = ours.select("event_id", "p", "s", F.col("n.id").alias("n"))
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_sessions_independent_of_slices(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    base = sessions.sessions(ev, "user_id", "ts", "30 minutes", ("event_id",), slices=1)
    other = sessions.sessions(ev, "user_id", "ts", "30 minutes", ("event_id",), slices=13)
    assert sorted(base.collect()) == sorted(other.collect())


def test_hot_key_within_one_hour_is_cut_by_rows(spark):
    hot = spark.range(0, 4000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("event_id"),
                                      (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(
                                          secs=(F.col("id") % 3600).cast("decimal(18,6)"))).alias("ts"))
    rest = spark.range(0, 8000).select((F.col("id") % 50 + 2).alias("k"), (F.col("id") + 10_000).alias("event_id"),
                                       (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(
                                           hours=(F.col("id") % 700).cast("int"))).alias("ts"))
    rows = hot.unionByName(rest)
    cut = sequence.slice_rows(rows, ["k"], "ts", ["event_id"], slices=12)
    largest = cut.groupBy("k", "_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 2.0 * 12_000 / 12
    got = with_running_sum(rows, ["k"], "ts", F.lit(1), out="n", tiebreak=["event_id"], slices=12)
    assert got.filter("k = 1").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 4000, 4000)


def test_null_keys_and_times_are_rejected_by_name(spark):
    rows = [(None, T0, 1, "data"), (None, T0, 2, "data"), (1, None, 3, "data"), (1, T0, 4, "data")]
    ev = _events(spark, rows)
    got = sessions.sessions(ev, "user_id", "ts", tiebreak=("event_id",)).collect()
    assert [(r.user_id, r.session_seq, r.n_events) for r in got] == [(1, 1, 1)]
    assert sorted(r.event_id for r in sequence.split_valid(ev, "user_id", "ts")[1].collect()) == [1, 2, 3]
    early = early_data.early_data(ev, "user_id", "ts", "event_type", "create", "close", ("event_id",)).collect()
    assert [(r.user_id, r.segment, r.n_early) for r in early] == [(1, 0, 1)]


def test_session_ends(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(1, 7, at(0), 1, "create"), (1, 7, at(1), 2, "data"), (1, 7, at(2), 3, "close"),
            (2, 7, at(0), 4, "create"), (2, 7, at(3), 5, "error"), (2, 7, at(4), 6, "create"), (2, 7, at(5), 7, "create"),
            (2, 7, at(6), 8, "reset"), (3, 7, at(7), 9, "create"), (3, 7, at(8), 10, "data"), (4, 7, at(8), 11, "create"),
            (9, 7, at(9), 12, "reconnect"), (3, 7, at(10), 13, "data"), (3, 7, at(11), 14, "create"),
            (5, 8, at(1), 15, "create"), (5, 8, at(20), 16, "data"), (None, 7, at(1), 17, "create")]
    log = spark.createDataFrame(rows, "user_id long, link int, ts timestamp_ntz, event_id long, kind string")
    got = sessions.marker_sessions(log, "user_id", "ts", "kind", "create", {"close": "closed", "error": "error", "reset": "reset"},
                                   link="link", reconnect="reconnect", tiebreak=("event_id",), slices=5).collect()
    assert sorted((r.user_id, r.session_start.second, r.session_end.second if r.session_end else None, r.n_data, r.end_reason)
                  for r in got) == [
        (1, 0, 2, 1, "closed"), (2, 0, 3, 0, "error"), (2, 4, 5, 0, "recreated"), (2, 5, 6, 0, "reset"),
        (3, 7, 9, 1, "reconnect"), (3, 11, None, 0, "open"), (4, 8, 9, 0, "reconnect"), (5, 1, None, 1, "open")]


def test_session_stream_equals_batch_for_closed_sessions(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    out = shared_dir(spark, "test_session_stream")
    stream = sessions.session_stream(spark, sf_dir, "events.parquet", ev.schema, "user_id", "ts",
                                     f"{out}/data", f"{out}/ckpt", gap="30 minutes", watermark="10 minutes")
    batch = sessions.sessions(ev, "user_id", "ts", "30 minutes", ("event_id",))
    s_rows = {(r.user_id, r.session_start, r.session_end, r.n_events) for r in stream.collect()}
    b_rows = {(r.user_id, r.session_start, r.session_end, r.n_events) for r in batch.collect()}
    assert s_rows and s_rows <= b_rows
    max_ts = ev.agg(F.max("ts")).first()[0]
    closed = {r for r in b_rows if r[2] <= max_ts - timedelta(minutes=10)}
    assert closed <= s_rows


def _shuffled_within_delay(spark, ev, name):
    """Three files that overlap in time: every row is late by up to nine minutes."""
    src = shared_dir(spark, name)
    moved = ev.withColumn("_a", F.col("ts") + F.make_dt_interval(mins=(F.xxhash64("event_id") % 5).cast("int") + 4))
    bounds = ["2024-01-01", "2024-01-10", "2024-01-21", "2030-01-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        part = moved.filter((F.col("_a") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("_a") < F.lit(hi).cast("timestamp_ntz")))
        part.drop("_a").coalesce(1).write.mode("append").parquet(src)
    return src


def test_first_response_stream_matches_batch_across_batches(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    out = shared_dir(spark, "test_rr_stream")
    got = correlate.first_response_stream(spark, _shuffled_within_delay(spark, ev, "test_rr_src"), "*.parquet", ev.schema,
                                          "user_id", "ts", "event_id", "event_type", "view", "purchase", 3600,
                                          "10 minutes", f"{out}/d", f"{out}/c", max_files=1)
    batch = correlate.first_response_in_log(ev, "user_id", "ts", "event_id", "event_type", "view", "purchase", "1 hour")
    g, b = [tuple(r) for r in got.collect()], {tuple(r) for r in batch.collect()}
    assert len(g) == len(set(g)) and set(g) <= b
    last = ev.filter("event_type in ('view', 'purchase')").agg(F.max("ts")).first()[0]
    settled = {r.event_id for r in ev.filter("event_type = 'view'").collect() if r.ts + timedelta(minutes=71) < last}
    assert settled <= {r[0] for r in g}
    waiting = sum(state.open_state(spark, f"{out}/c", variable=v).count() for v in ("waiting", "pending"))
    assert waiting >= 1


def test_response_before_its_request_arrives(spark):
    src, out = shared_dir(spark, "test_rr_order"), shared_dir(spark, "test_rr_order_out")
    at = lambda s: T0 + timedelta(seconds=s)
    for rows in ([(1, at(30), 2, "purchase")], [(1, at(0), 1, "view")], [(8, at(90_000), 9, "view")]):
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    got = correlate.first_response_stream(spark, src, "*.parquet", _events(spark, []).schema, "user_id", "ts", "event_id",
                                          "event_type", "view", "purchase", 3600, "10 minutes", f"{out}/d", f"{out}/c", max_files=1)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 2, 30.0, "matched")]


def test_fan_out_writer_is_replay_safe(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    out = shared_dir(spark, "test_fan_out")
    batch = ev.select("event_id", F.expr("CASE WHEN event_type = 'signup' THEN 'session_create' "
                                         "WHEN event_type = 'click' THEN 'port_mapping' ELSE 'bogus' END")
                      .alias("msg_type"))
    writer = messages.fan_out_writer(out)
    writer(batch, 0)
    writer(batch, 0)  # replay of the same micro-batch
    back = spark.read.parquet(out)
    assert back.count() == ev.count()
    assert {r.route for r in back.select("route").distinct().collect()} == {"agent", "sidecar", "dead_letter"}


def test_log_parse_splits_on_first_three_separators(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07,179 - __main__ - INFO - ✅ Agent authenticated and ready - x",)],
                               "line string")
    r = logs.with_auth_flags(logs.parse_lines(df)).first()
    assert (r.logger, r.level, r.message) == ("__main__", "INFO", "✅ Agent authenticated and ready - x")
    assert r.log_ts == datetime(2024, 1, 1, 0, 0, 7, 179000) and r.auth_ready and not r.auth_failed


def test_log_rate_stream_matches_batch(spark, sf_dir):
    from tidelink.plans import derived
    ev = read_table(spark, sf_dir, "events")
    lines_dir = shared_dir(spark, "test_log_lines")
    derived.service_log(ev).select("line").write.parquet(lines_dir)
    stream_lines = spark.readStream.schema("line string").parquet(lines_dir)
    out = shared_dir(spark, "test_log_rate")
    got = logs.log_rate_stream(spark, stream_lines, f"{out}/data", f"{out}/ckpt", watermark="2 minutes")
    batch = logs.log_rate(logs.parse_lines(derived.service_log(ev)))
    g = {tuple(r) for r in got.select("minute", "level", "n_lines", "n_auth_failed").collect()}
    b = {tuple(r) for r in batch.select("minute", "level", "n_lines", "n_auth_failed").collect()}
    assert g and g <= b


def test_early_data_stream_matches_batch_across_batches(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    out = shared_dir(spark, "test_early_stream")
    got = early_data.early_data_stream(spark, _shuffled_within_delay(spark, ev, "test_early_src"), "*.parquet", ev.schema,
                                       "user_id", "ts", "event_id", "event_type", "signup", "error", "10 minutes",
                                       f"{out}/d", f"{out}/c", max_files=1)
    batch = early_data.early_data(ev, "user_id", "ts", "event_type", "signup", "error", tiebreak=("event_id",))
    cols = ["user_id", "segment", "n_early", "closing_marker", "replayed", "dropped", "resets", "cleared"]
    last = ev.agg(F.max("ts")).first()[0] - timedelta(minutes=11)
    closed = batch.filter((F.col("end_ts") < F.lit(last)) if "end_ts" in batch.columns else F.col("closing_marker").isNotNull())
    g, b = [tuple(r) for r in got.select(*cols).collect()], {tuple(r) for r in closed.select(*cols).collect()}
    assert len(g) == len(set(g)) and set(g) <= b and len(b) - len(g) <= 5
    assert state.open_state(spark, f"{out}/c", variable="waiting").count() >= 1


def test_early_data_marker_file_before_data_file(spark):
    src, out = shared_dir(spark, "test_early_order"), shared_dir(spark, "test_early_order_out")
    at = lambda s: T0 + timedelta(seconds=s)
    for rows in ([(1, at(5), 3, "create")], [(1, at(1), 1, "data"), (1, at(2), 2, "data")], [(8, at(90_000), 9, "data")]):
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    got = early_data.early_data_stream(spark, src, "*.parquet", _events(spark, []).schema, "user_id", "ts", "event_id",
                                       "event_type", "create", "close", "10 minutes", f"{out}/d", f"{out}/c", max_files=1)
    assert [(r.user_id, r.segment, r.n_early, r.replayed) for r in got.collect()] == [(1, 0, 2, 2)]


def test_malformed_log_lines_do_not_fail(spark):
    df = spark.createDataFrame([("not a log line",), ("2024-13-45 99:99:99,999 - x - INFO - y",),
                                ("2024-01-01 00:00:00,000 - a - b - c",)], "line string")
    rows = logs.parse_lines(df).collect()
    assert rows[0].log_ts is None and rows[0].level is None
    assert rows[1].log_ts is None and rows[1].level == "INFO"  # impossible date -> null
    assert rows[2].log_ts is None  # level 'b' is not a level name


class _Cell:
    """A state variable in memory that counts what is written to it."""

    def __init__(self):
        self.value, self.values, self.written = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.written = value, self.written + len(str(value))

    def clear(self):
        self.value = None

    def getValue(self, key):  # noqa: N802
        return self.values.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.values[key], self.written = value, self.written + len(str(value))

    def removeKey(self, key):  # noqa: N802
        self.values.pop(key, None)


class _Handle:
    def __init__(self):
        self.cells = {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.cells.setdefault(name, _Cell())

    getValueState = getMapState  # noqa: N815


def test_waiting_messages_are_written_once():
    import numpy as np

    from tidelink.streaming.waiting import NEVER, Waiting
    handle = _Handle()
    box = Waiting(handle, "w", {"id": "long"}, slot_us=1_000_000)
    rng, sent, written = np.random.default_rng(1), [], []
    for batch in range(30):  # a key that gets 500 messages in every micro-batch, none of them due
        us = rng.integers(10 ** 6, 3 * 10 ** 6, 500)
        ids = np.arange(500) + 500 * batch
        before = sum(c.written for c in handle.cells.values())
        assert box.add({"us": us, "id": ids}) == min([*us, *(t for t, _ in sent)])
        written.append(sum(c.written for c in handle.cells.values()) - before)
        sent += zip(us.tolist(), ids.tolist())
    assert max(written[-5:]) < 1.5 * max(written[:5])  # 15,000 messages wait by now
    got = []
    for until in (10 ** 6, 1_500_000, 1_500_001, 2_000_000, 2_900_000, NEVER):
        before = handle.cells["w"].written
        rows, due = box.take(until)
        assert handle.cells["w"].written == before  # taking writes no message again
        got += zip(rows["us"].tolist(), rows["id"].tolist())
        assert sorted(got) == sorted(x for x in sent if x[0] < until)
        assert due == min((t for t, _ in sent if t >= until), default=NEVER)
    assert not handle.cells["w"].values and handle.cells["w_index"].value is None


def test_marker_session_stream_equals_batch(spark, sf_dir):
    from tidelink.plans import derived
    ev = read_table(spark, sf_dir, "events")
    out, src = shared_dir(spark, "test_marker_stream"), _shuffled_within_delay(spark, ev, "test_marker_src")
    ends = {"close": "closed", "error": "error", "reset": "reset"}
    got = sessions.marker_sessions_stream(spark, src, "*.parquet", ev.schema, derived.session_log, "user_id", "ts", "event_id", "marker",
                                          "create", ends, "10 minutes", f"{out}/d", f"{out}/c", link="link", reconnect="reconnect",
                                          buckets=3, max_files=1)
    batch = sessions.marker_sessions(derived.session_log(ev), "user_id", "ts", "marker", "create", ends, link="link",
                                     reconnect="reconnect", tiebreak=("event_id",))
    cols = ["user_id", "epoch", "segment", "session_start", "session_end", "n_data", "end_reason"]
    g, b = [tuple(r) for r in got.select(*cols).collect()], {tuple(r) for r in batch.select(*cols).collect()}
    last = ev.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    assert len(g) == len(set(g))
    assert set(g) == {r for r in b if r[4] is not None and r[4] < last.replace(microsecond=last.microsecond // 1000 * 1000)}
    assert {"reconnect", "closed", "recreated"} <= {r[6] for r in g}
    left = state.open_state(spark, f"{out}/c", variable="open").count()
    assert 0 < left <= sum(r[6] == "open" or r[4] >= last for r in b)


def test_marker_session_stream_with_text_keys_and_without_link(spark):
    src, out = shared_dir(spark, "test_marker_text"), shared_dir(spark, "test_marker_text_out")
    at = lambda s: T0 + timedelta(seconds=s)
    kind = "who string, ts timestamp_ntz, event_id long, kind string"
    for rows in ([("a", at(9), 4, "close"), ("b", at(2), 9, "create")], [("a", at(1), 1, "create"), ("a", at(2), 2, "data"), (None, at(2), 3, "create")],
                 [("a", at(90_000), 5, "data")], [("b", at(95_000), 6, "create")], [("c", at(200_000), 7, "data")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    got = sessions.marker_sessions_stream(spark, src, "*.parquet", spark.createDataFrame([], kind).schema, lambda d: d, "who", "ts", "event_id",
                                          "kind", "create", {"close": "closed"}, "10 minutes", f"{out}/d", f"{out}/c", max_files=1)
    assert sorted((r.who, r.epoch, r.segment, r.n_data, r.end_reason, r.session_end) for r in got.collect()) == [
        ("a", 0, 1, 1, "closed", at(9)), ("b", 0, 1, 0, "recreated", at(95_000))]


def _failures(spark, rows):
    line = F.concat_ws(" - ", F.date_format("ts", logs.ASCTIME), F.lit("agent"), F.lit("ERROR"),
                       F.concat(F.when(F.col("ok"), F.lit("frame in for peer ")).otherwise(F.lit("Authentication failed for peer ")), F.col("peer")))
    return spark.createDataFrame(rows, "ts timestamp_ntz, peer string, ok boolean").select(line.alias("line"))


def test_auth_bursts_batch_and_stream(spark):
    at = lambda m, s=0: T0 + timedelta(minutes=m, seconds=s)
    early = [(at(0, 5), "a", False), (at(0, 50), "a", False), (at(3), "a", False), (at(4, 59), "a", False), (at(5), "a", False),
             (at(1), "b", False), (at(9), "b", False), (at(2), "c", True), (at(2, 1), "c", True), (at(2, 2), "c", True)]
    hot = [(at(20 + i % 7, i % 60), "hot", False) for i in range(2000)]
    rest = [(at(40), "a", False), (at(60), "quiet", True), (at(59, 30), "late", False)]
    want = {("a", at(3), 3), ("a", at(4), 4), ("a", at(5), 3)}
    per = [sum(1 for i in range(2000) if i % 7 == m) for m in range(7)]
    want |= {("hot", at(20 + m), sum(per[max(0, m - 4):m + 1])) for m in range(7)}
    for slices in (1, 8):
        got = logs.auth_bursts(logs.parse_lines(_failures(spark, early + hot + rest)), 5, 3, slices)
        assert {tuple(r) for r in got.collect()} == want
    src, out = shared_dir(spark, "test_auth_src"), shared_dir(spark, "test_auth_out")
    for part in (hot[::2], early[::-1], hot[1::2], rest):  # a file that is late by less than the delay
        _failures(spark, part).coalesce(1).write.mode("append").parquet(src)
    lines = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(src)
    got = logs.auth_bursts_stream(spark, lines, 5, 3, f"{out}/d", f"{out}/c", watermark="30 minutes")
    assert {tuple(r) for r in got.collect()} == {w for w in want if w[1] + timedelta(minutes=1) <= at(30)}
    left = {r.minute for r in state.open_state(spark, f"{out}/c", variable="minutes").select("key.*", "user_map_key.*").collect()}
    assert min(left) * 60 >= (at(26) - datetime(1970, 1, 1)).total_seconds()  # nothing that no later minute looks back to


def test_auth_bursts_stream_over_many_micro_batches(spark):
    rows = [(T0 + timedelta(seconds=37 * i + i * i % 101), f"p{i * i % 5}", i % 4 == 0) for i in range(600)]
    src, out = shared_dir(spark, "test_auth_many_src"), shared_dir(spark, "test_auth_many_out")
    for k in range(0, 600, 75):
        _failures(spark, rows[k:k + 75]).coalesce(1).write.mode("append").parquet(src)
    lines = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(src)
    got = logs.auth_bursts_stream(spark, lines, 20, 4, f"{out}/d", f"{out}/c", partitions=2)
    batch = logs.auth_bursts(logs.parse_lines(spark.read.schema("line string").parquet(src)), 20, 4)
    end = max(r[0] for r in rows) - timedelta(minutes=2)
    want = sorted(tuple(r) for r in batch.collect() if r.minute + timedelta(minutes=1) <= end)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want
    held = state.open_state(spark, f"{out}/c", variable="minutes").select("user_map_key.*").collect()
    assert held and min(r.minute for r in held) > (end - timedelta(minutes=20) - datetime(1970, 1, 1)).total_seconds() // 60


def test_auth_bursts_state_calls_do_not_grow_with_the_log():
    class Handle:
        """A map state and timers that count what is asked of them."""

        def __init__(self):
            self.calls, self.held, self.timers = 0, {}, set()

        def getMapState(self, *_):  # noqa: N802
            return self

        def _counted(self, found=None):
            self.calls += 1
            return found

        def iterator(self):
            return self._counted(iter(list(self.held.items())))

        def getValue(self, key):  # noqa: N802
            return self._counted(self.held.get(key))

        def updateValue(self, key, value):  # noqa: N802
            self._counted(self.held.update({key: value}))

        def removeKey(self, key):  # noqa: N802
            self._counted(self.held.pop(key))

        def registerTimer(self, at):  # noqa: N802
            self._counted(self.timers.add(at))

    class Clock:
        def __init__(self, minute):
            self.minute = minute

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.minute * 60_000

    def closed(n):
        """A peer that fails twice in each of ``n`` minutes, closed at once."""
        handle, ring = Handle(), logs._Ring(5, 7)
        ring.init(handle)
        first = list(ring.handleInputRows(("a",), iter([Row(minute=m, n=2) for m in range(n)]), Clock(n)))
        more = list(ring.handleInputRows(("a",), iter([Row(minute=n + 1, n=1)]), Clock(n + 2)))
        calls = handle.calls
        assert [(r.us // 60_000_000, r.n_failed) for r in first] == [(m, min(2 * m + 2, 10)) for m in range(3, n)]
        assert [(r.us // 60_000_000, r.n_failed) for r in more] == [(n + 1, 7)]
        assert sorted(m for m, in handle.held) == [n - 2, n - 1, n + 1] and min(t for t in handle.timers if t > (n + 2) * 60_000) == (n + 3) * 60_000
        for minute in range(n + 3, n + 8):
            if minute * 60_000 in handle.timers:
                assert list(ring.handleExpiredTimer(("a",), Clock(minute), None)) == []
        assert not handle.held
        return calls

    assert closed(40) == closed(4000) < 40


def test_message_route_stream_without_rows(spark):
    src, out = shared_dir(spark, "test_route_empty"), shared_dir(spark, "test_route_out")
    empty = spark.createDataFrame([], "event_id long, msg_type string")
    empty.write.parquet(src)
    got = messages.route_stream(spark, src, "*.parquet", empty.schema, lambda d: d, f"{out}/d", f"{out}/c")
    assert got.collect() == [] and {"event_id", "msg_type", "route"} <= set(got.columns)
