"""The query register: one callable ``(spark, sf_dir) -> DataFrame`` per job.

Stand-ins for the reference's tables: users -> ``customer``, orders ->
``orders``, link messages / logs / requests -> derived from ``events``.
Every query reads whole tables; none caps, samples or subsets rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelink.functions import codec
from tidelink.functions.statements import READ_PREFIXES_AGENT, log_head, statement_kind
from tidelink.functions.numeric import MONEY, exact_sum
from tidelink.functions.temporal import iso_text, ntz_literal, seconds_between
from tidelink.operators import inventory, keyed, moving, percentiles, relational
from tidelink.operators.range_join import range_join
from tidelink.operators.requests import parse_requests, result_pages, run_requests
from tidelink.plans import derived
from tidelink.session import shared_dir
from tidelink.sources.registry import SourceCatalog
from tidelink.sources import lake, remote
from tidelink.streaming import correlate, early_data, logs, messages, sessions
from tidelink.tables import read_table, register_views

RUN_TS = "2025-01-01 00:00:00"
SESSION_GAP = "30 minutes"
RESPONSE_WITHIN = "1 hour"
STREAM_DELAY = "10 minutes"
LOG_DELAY = "2 minutes"
DERBY = "tidelink"
PAGE_ROWS = 500
BURST_MINUTES, BURST_LEAST = 60, 2


def _t(spark, sf_dir, name) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _state_partitions(spark) -> int:
    """State partitions for the streaming twins: one per core of the cluster."""
    return spark.sparkContext.defaultParallelism


# --- relational -----------------------------------------------------------

def q_user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the join, created and then selected from; whole tables."""
    view = relational.create_user_orders_view(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"))
    return spark.sql(f"SELECT * FROM {view} ORDER BY user_id, order_date DESC NULLS FIRST")


def q_order_listing(spark, sf_dir):
    return relational.order_listing(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"))


def q_table_counts(spark, sf_dir):
    return relational.table_counts([
        ("Customers:", _t(spark, sf_dir, "customer")),
        ("Orders:", _t(spark, sf_dir, "orders")),
        ("Line items:", _t(spark, sf_dir, "lineitem")),
    ])


def q_bound_params(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total_price "
        "FROM {orders} WHERE o_totalprice > ? AND o_orderstatus = ?",
        args=[300000.0, "F"], orders=_t(spark, sf_dir, "orders"))


def q_federated_below_avg(spark, sf_dir):
    """Remote customers (partitioned JDBC scan) joined with the local nations."""
    src = remote.embedded_derby(DERBY)
    cust = _t(spark, sf_dir, "customer")
    remote.remote_append(cust, src, "FED_CUSTOMER", column_types=remote.string_column_types(cust), mode="overwrite")
    far = remote.remote_scan(spark, src, "FED_CUSTOMER", partition_column="c_custkey", num_partitions=8)
    out = relational.below_group_average(
        far, _t(spark, sf_dir, "nation"),
        ("c_nationkey", "n_nationkey"), "c_mktsegment", "c_acctbal")
    return out.select("c_custkey", "c_name", "n_name", "c_mktsegment",
                      F.round("c_acctbal", 2).alias("c_acctbal"),
                      F.round("group_avg", 2).alias("segment_avg"))


# --- percentiles, ranges, moving frames --------------------------------------

def q_group_percentiles(spark, sf_dir):
    """Median and 95th percentile of the line price by return flag."""
    found = percentiles.group_percentiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    return found.select("l_returnflag", F.col("n_rows").cast("long").alias("n_rows"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


def q_range_join(spark, sf_dir):
    """Purchases inside the window that an error opens (one to five minutes, by its id)."""
    ev = _t(spark, sf_dir, "events")
    windows = ev.filter("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), F.col("ts").alias("opened"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5 + 1).cast("int"))).alias("closed"))
    bought = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "ts")
    return range_join(bought, "ts", windows, "opened", "closed").select(
        "error_id", "purchase_id", F.round(seconds_between(F.col("opened"), F.col("ts")), 6).alias("after_s"))


def q_moving_window(spark, sf_dir):
    """Every event with its user's events and value of the last hour."""
    ev = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").cast(MONEY).alias("value"))
    found = moving.moving_sums(ev, ["user_id"], "ts", 3_600_000_000, "value", "n_hour", "value_hour")
    return found.select("event_id", "user_id", F.col("n_hour").cast("long").alias("n_hour"), F.col("value_hour").cast("double").alias("value_hour"))


# --- remote sources (JDBC, embedded Derby as the remote engine) ------------

def _stage_orders(spark, sf_dir, table: str, frame: DataFrame | None = None, mode="overwrite"):
    src = remote.embedded_derby(DERBY)
    df = frame if frame is not None else _t(spark, sf_dir, "orders")
    remote.remote_append(df, src, table, column_types=remote.string_column_types(df), mode=mode)
    return src


_GROUP_SQL = ('SELECT "o_orderstatus" AS "o_orderstatus", COUNT(*) AS "n_orders", '
              'SUM(CAST("o_totalprice" AS DECIMAL(18,2))) AS "total_price" FROM {t} GROUP BY "o_orderstatus"')


def _status_summary(df: DataFrame) -> DataFrame:
    return df.select("o_orderstatus", F.col("n_orders").cast("long").alias("n_orders"),
                     F.round("total_price", 2).cast("double").alias("total_price"))


def q_remote_query(spark, sf_dir):
    src = _stage_orders(spark, sf_dir, "RQ_ORDERS")
    return _status_summary(remote.remote_query(spark, src, _GROUP_SQL.format(t="RQ_ORDERS")))


def q_remote_append(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    cut = ntz_literal("1998-01-01 00:00:00")
    src = _stage_orders(spark, sf_dir, "RA_ORDERS", orders.filter(F.col("o_orderdate") < cut))
    _stage_orders(spark, sf_dir, "RA_ORDERS", orders.filter(F.col("o_orderdate") >= cut), mode="append")
    return _status_summary(remote.remote_query(spark, src, _GROUP_SQL.format(t="RA_ORDERS")))


def q_remote_catalog(spark, sf_dir):
    src = _stage_orders(spark, sf_dir, "RC_ORDERS")
    cat = remote.register_jdbc_catalog(spark, "tidelink_remote", src)
    t = spark.table(f"{cat}.APP.RC_ORDERS")
    # Aggregates are pushed into the remote engine's query.
    agg = t.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"),
                                         F.sum(F.col("o_totalprice").cast(MONEY)).alias("total_price"))
    return _status_summary(agg)


def q_remote_scan(spark, sf_dir):
    src = remote.embedded_derby(DERBY)
    cust = _t(spark, sf_dir, "customer")
    remote.remote_append(cust, src, "RS_CUSTOMER", column_types=remote.string_column_types(cust),
                         mode="overwrite")
    top = remote.remote_top(spark, src, "RS_CUSTOMER", ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"], 5)
    return top.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                      F.col("c_mktsegment").alias("segment")).orderBy("id")


# --- keyed writes and constraints -------------------------------------------

def q_insert_where_not_exists(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    split = ntz_literal(derived.SPLIT_TS)
    target = ev.filter(F.col("ts") < split).select("user_id", "event_type")
    source = ev.filter(F.col("ts") >= split).select("user_id", "event_type").dropDuplicates()
    return keyed.insert_where_not_exists(target, source, ["user_id", "event_type"])


def q_insert_ignore(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("text_key", F.sha2(F.col("text"), 256))
    target = docs.filter(F.col("source") < F.lit("src5")).select("text_key")
    batch = docs.filter(F.col("source") >= F.lit("src5")).select("doc_id", "source", "n_chars", "text_key")
    rows = keyed.insert_ignore(target, batch, ["text_key"], "doc_id")
    return rows.select("doc_id", "source", "n_chars")


def q_surrogate_key(spark, sf_dir):
    cust = _t(spark, sf_dir, "customer")
    existing = cust.filter(F.col("c_acctbal") >= 0)
    batch = cust.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("source_key"))
    return keyed.surrogate_keys(existing, batch, "c_custkey", ["source_key"], out="new_key")


def q_default_fill(spark, sf_dir):
    """Orders without a date (here those whose key divides by 7) get the run's time."""
    date = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", date.alias("order_date"))
    orders = orders.withColumn("is_default", F.col("order_date").isNull())
    return keyed.apply_defaults(orders, {"order_date": ntz_literal(RUN_TS)})


def q_constraint_report(spark, sf_dir):
    cust, orders, li = (_t(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    return keyed.constraint_report([
        keyed.rule_unique("customer primary key c_custkey", cust, ["c_custkey"]),
        keyed.rule_row_checks(cust, {
            "customer not null c_name": F.col("c_name").isNull(),
            "customer c_name varchar(25)": F.length("c_name") > 25,
        }),
        keyed.rule_unique("orders primary key o_orderkey", orders, ["o_orderkey"]),
        keyed.rule_foreign_key("orders o_custkey references customer", orders, "o_custkey",
                               cust, "c_custkey"),
        keyed.rule_unique("lineitem unique (l_orderkey, l_linenumber)", li,
                          ["l_orderkey", "l_linenumber"]),
        keyed.rule_foreign_key("lineitem l_orderkey references orders", li, "l_orderkey",
                               orders, "o_orderkey"),
    ])


# --- ingest / copy / catalog -------------------------------------------------

def _status_from(df):
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("long").alias("n_orders"),
                                           exact_sum("o_totalprice").alias("total_price"))


def q_ingest_full(spark, sf_dir):
    path = shared_dir(spark, "ingest_full")
    orders = _t(spark, sf_dir, "orders")
    lake.ingest_full(orders, path)
    lake.ingest_full(orders, path)  # re-run: same table
    return _status_from(spark.read.parquet(path))


def q_ingest_incremental(spark, sf_dir):
    """Remote table -> lake table in runs; each run appends only rows that the
    lake lacks at or above its high-water mark, read through the partitioned
    JDBC scan with the mark pushed into the remote query.  Two thirds of the
    rows of the last loaded day arrive only with the second load."""
    path = shared_dir(spark, "ingest_incremental")
    orders = _t(spark, sf_dir, "orders")
    src = remote.embedded_derby(DERBY, preferTimestampNTZ="true")
    types = remote.string_column_types(orders)
    orders = orders.withColumn("o_orderdate", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    bounds = tuple(orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first())
    cut = ntz_literal("1998-01-01 00:00:00")
    early = (F.col("o_orderdate") < cut) | ((F.col("o_orderdate") == cut) & (F.col("o_orderkey") % 3 == 0))

    def load():
        scan = remote.remote_scan(spark, src, "ING_ORDERS", partition_column="o_orderkey", num_partitions=8, bounds=bounds)
        lake.ingest_incremental(spark, scan, path, "o_orderdate", ["o_orderkey"])

    remote.remote_append(orders.filter(early), src, "ING_ORDERS", column_types=types, mode="overwrite")
    load()                                                                 # initial load
    remote.remote_append(orders.filter(~early), src, "ING_ORDERS")         # new remote rows, some at the mark
    load()                                                                 # rows at or above the mark, by key
    load()                                                                 # re-run: nothing
    return (spark.read.parquet(path).groupBy("o_orderstatus")
            .agg(F.count(F.lit(1)).cast("long").alias("n_orders"), exact_sum("o_totalprice").alias("total_price"),
                 F.sum("o_orderkey").cast("long").alias("key_sum"), F.count_distinct("o_orderkey").alias("n_keys")))


def q_ingest_changes(spark, sf_dir):
    """A lake table after three runs over a changing source: the second brings
    new orders (keys 3 mod 10), changed prices (0 mod 7) and deletions (the
    orders of negative keys), the third nothing."""
    path = shared_dir(spark, "ingest_changes")
    orders = _t(spark, sf_dir, "orders")
    first = orders.filter(F.col("o_orderkey") % 10 != 3).withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(0.0))
    first = first.unionByName(orders.filter((F.col("o_orderkey") % 11 == 0) & (F.col("o_orderkey") > 0)).withColumn("o_orderkey", -F.col("o_orderkey")))
    runs = [lake.ingest_changes(spark, source, path, ["o_orderkey"], buckets=64) for source in (first, orders, orders)]
    report = spark.createDataFrame(
        [(f"run {r.version} {name}", getattr(r, name)) for r in runs for name in ("inserted", "updated", "deleted")]
        + [("run 3 rewritten", len(runs[2].rewritten))], "name string, n_rows long").withColumn("total_price", F.lit(None).cast("double"))
    return _status_from(lake.read_snapshot(spark, path)).select(
        F.col("o_orderstatus").alias("name"), F.col("n_orders").alias("n_rows"), "total_price").unionByName(report)


def q_copy_reconcile(spark, sf_dir):
    path = shared_dir(spark, "copy_reconcile")
    return lake.copy_reconcile(spark, _t(spark, sf_dir, "orders"), path, "o_totalprice")


def q_catalog_read(spark, sf_dir):
    location = shared_dir(spark, "catalog", "sales")
    db_location = shared_dir(spark, "catalog", "tidelink_lake.db", unique=False)
    name = lake.save_catalog_table(spark, _t(spark, sf_dir, "orders"), "tidelink_lake", "sales", location,
                                   database_location=db_location)
    t = lake.read_catalog_table(spark, name)
    return (t.groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).cast("long").alias("n_orders"),
                 exact_sum("o_totalprice").alias("total_price")))


# --- functions ---------------------------------------------------------------

def q_encode_roundtrip(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.withColumn("name_hex", codec.to_hex("c_name")).withColumn("name_b64", codec.to_base64("c_name"))
    ok = ((codec.from_hex_text("name_hex") == F.col("c_name"))
          & (codec.from_base64_text("name_b64") == F.col("c_name")))
    return c.select("c_custkey", "name_hex", "name_b64", ok.alias("roundtrip_ok"))


def q_protect_columns(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    path = shared_dir(spark, "column_key")
    codec.write_key(spark, path, secrets.token_hex(16))  # 32 characters: AES-256
    enc = codec.protect_columns(c.withColumn("_orig", F.col("c_name")), ["c_name"], codec.key_from(spark, path))
    dec = codec.unprotect_columns(enc, ["c_name"], codec.key_from(spark, path))
    return dec.select("c_custkey", "c_name", (F.col("c_name") == F.col("_orig")).alias("roundtrip_ok"))


def q_result_envelope(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("ts_iso", iso_text("ts"))
    row = F.to_json(F.struct("event_id", "user_id", "event_type", "ts_iso"),
                    {"ignoreNullFields": "false"})
    return ev.select("event_id", "user_id", "ts_iso", F.round("value", 2).alias("value"),
                     row.alias("row_json"))


def q_statement_kind(spark, sf_dir):
    ql = derived.query_log(_t(spark, sf_dir, "events"))
    return ql.select("event_id", statement_kind("query").alias("kind_service"),
                     statement_kind("query", READ_PREFIXES_AGENT).alias("kind_agent"),
                     log_head("query").alias("query_head"))


def q_request_parse(spark, sf_dir):
    req = derived.request_table(_t(spark, sf_dir, "events"))
    return parse_requests(req).select("row_index", "query", "target_host", "target_port", "error")


def q_request_batch(spark, sf_dir):
    register_views(spark, sf_dir, ("customer", "nation", "orders"))
    req = derived.request_table(_t(spark, sf_dir, "events"), derived.BATCH_TEXT_EXPR)
    envelopes, _ = run_requests(spark, req)
    return envelopes.select("row_index", "success", "rowcount", "error")


def q_request_rows(spark, sf_dir):
    """Result rows of every distinct request of the batch that succeeded."""
    register_views(spark, sf_dir, ("customer", "nation", "orders"))
    req = derived.request_table(_t(spark, sf_dir, "events"), derived.ROWS_TEXT_EXPR)
    envelopes, results = run_requests(spark, req)
    asked = envelopes.filter("success").join(req, "row_index").select("result_id", "input").distinct()
    return asked.join(results, "result_id").select("input", "row_json")


def q_request_pages(spark, sf_dir):
    """Every distinct request's result in pages of at most 500 rows, a page's rows as one JSON array."""
    register_views(spark, sf_dir, ("customer", "orders"))
    req = derived.request_table(_t(spark, sf_dir, "events"), derived.PAGED_TEXT_EXPR)
    envelopes, results = run_requests(spark, req)
    asked = envelopes.filter("success").join(req, "row_index").select("result_id", "input").distinct()
    return asked.join(result_pages(results, PAGE_ROWS), "result_id").select(
        "input", "page", "n_rows", F.concat(F.lit("["), F.concat_ws(",", "rows"), F.lit("]")).alias("rows_json"))


def q_request_routing(spark, sf_dir):
    """Requests routed by their target: ``remote-db`` (with or without port)
    resolves to the remote database, no target to the default source, an
    unknown host to an error row."""
    register_views(spark, sf_dir, ("region",))
    nation = _t(spark, sf_dir, "nation")
    nation = nation.select(*[F.col(c).alias(c.upper()) for c in nation.columns])
    src = remote.embedded_derby(DERBY)
    remote.remote_append(nation, src, "NATION", column_types=remote.string_column_types(nation),
                         mode="overwrite")
    catalog = SourceCatalog().register("remote-db:1527", src).register("remote-db", src)
    req = derived.request_table(_t(spark, sf_dir, "events"), derived.ROUTED_TEXT_EXPR)
    envelopes, _ = run_requests(spark, req, catalog)
    return envelopes.select("row_index", "success", "rowcount", "error")


# --- link inventory ---------------------------------------------------------

def q_protocol_lookup(spark, sf_dir):
    conns = derived.connections(_t(spark, sf_dir, "events"))
    return inventory.with_protocol(conns, "port").select("event_id", "port", "protocol")


def q_connection_inventory(spark, sf_dir):
    return inventory.connection_inventory(derived.connections(_t(spark, sf_dir, "events")))


def q_source_health(spark, sf_dir):
    conns = derived.connections(_t(spark, sf_dir, "events"))
    return inventory.source_health(conns, "user_id", "ts", "event_type", "port", "error",
                                   states=("click", "error", "purchase", "signup", "view")).select(
        "user_id", "status", "last_state", "active_ports", "n_events")


# --- streams and logs -------------------------------------------------------

def q_message_route(spark, sf_dir):
    return messages.route_counts(derived.messages(_t(spark, sf_dir, "events")))


def q_session_batch(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return sessions.sessions(ev, "user_id", "ts", SESSION_GAP, tiebreak=("event_id",)).select(
        "user_id", "session_start", "session_end", "n_events")


def q_session_markers(spark, sf_dir):
    log = derived.session_log(_t(spark, sf_dir, "events"))
    return sessions.marker_sessions(log, "user_id", "ts", "marker", create="create",
                                    ends={"close": "closed", "error": "error", "reset": "reset"},
                                    link="link", reconnect="reconnect", tiebreak=("event_id",))


def q_session_markers_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "session_markers_stream")
    return sessions.marker_sessions_stream(spark, sf_dir, "events.parquet", schema, derived.session_log, "user_id", "ts", "event_id",
                                           "marker", "create", {"close": "closed", "error": "error", "reset": "reset"},
                                           STREAM_DELAY, f"{out}/data", f"{out}/checkpoint", link="link", reconnect="reconnect",
                                           partitions=_state_partitions(spark))


def q_session_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "session_stream")
    return sessions.session_stream(spark, sf_dir, "events.parquet", schema, "user_id", "ts",
                                   f"{out}/data", f"{out}/checkpoint", gap=SESSION_GAP,
                                   partitions=_state_partitions(spark))


def q_session_bytes(spark, sf_dir):
    msgs = messages.with_payload(_t(spark, sf_dir, "events"), "props")
    return messages.bytes_per_session(msgs, ["user_id"], "event_type")


def q_early_data(spark, sf_dir):
    return early_data.early_data(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type",
                                 create="signup", close="error", tiebreak=("event_id",))


def q_early_data_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "early_data_stream")
    return early_data.early_data_stream(spark, sf_dir, "events.parquet", schema, "user_id", "ts",
                                        "event_id", "event_type", "signup", "error",
                                        STREAM_DELAY, f"{out}/data", f"{out}/checkpoint",
                                        partitions=_state_partitions(spark))


def q_request_response(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return correlate.first_response_in_log(ev, "user_id", "ts", "event_id", "event_type", "view", "purchase",
                                           RESPONSE_WITHIN)


def q_request_response_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "request_response_stream")
    return correlate.first_response_stream(spark, sf_dir, "events.parquet", schema, "user_id", "ts",
                                           "event_id", "event_type", "view", "purchase", 3600,
                                           STREAM_DELAY, f"{out}/data", f"{out}/checkpoint",
                                           partitions=_state_partitions(spark))


def q_message_route_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "message_route_stream")
    routed = messages.route_stream(spark, sf_dir, "events.parquet", schema, derived.messages,
                                   f"{out}/data", f"{out}/checkpoint")
    return (routed.groupBy("route", "msg_type")
            .agg(F.count(F.lit(1)).cast("long").alias("n_messages")))


def q_log_parse(spark, sf_dir):
    return logs.parse_lines(derived.service_log(_t(spark, sf_dir, "events")))


def q_log_rate(spark, sf_dir):
    return logs.log_rate(logs.parse_lines(derived.service_log(_t(spark, sf_dir, "events"))))


def q_log_rate_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "log_rate_stream")
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return logs.log_rate_stream(spark, derived.service_log(events), f"{out}/data", f"{out}/checkpoint",
                                watermark=LOG_DELAY, partitions=_state_partitions(spark))


def q_auth_bursts(spark, sf_dir):
    return logs.auth_bursts(logs.parse_lines(derived.service_log(_t(spark, sf_dir, "events"))), BURST_MINUTES, BURST_LEAST)


def q_auth_bursts_stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    out = shared_dir(spark, "auth_bursts_stream")
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return logs.auth_bursts_stream(spark, derived.service_log(events), BURST_MINUTES, BURST_LEAST, f"{out}/data", f"{out}/checkpoint",
                                   watermark=LOG_DELAY, partitions=_state_partitions(spark))


QUERIES = {
    "user_orders": q_user_orders,
    "order_listing": q_order_listing,
    "table_counts": q_table_counts,
    "bound_params": q_bound_params,
    "group_percentiles": q_group_percentiles,
    "range_join": q_range_join,
    "moving_window": q_moving_window,
    "federated_below_avg": q_federated_below_avg,
    "remote_query": q_remote_query,
    "remote_append": q_remote_append,
    "remote_scan": q_remote_scan,
    "remote_catalog": q_remote_catalog,
    "insert_where_not_exists": q_insert_where_not_exists,
    "insert_ignore": q_insert_ignore,
    "surrogate_key": q_surrogate_key,
    "default_fill": q_default_fill,
    "constraint_report": q_constraint_report,
    "ingest_full": q_ingest_full,
    "ingest_incremental": q_ingest_incremental,
    "ingest_changes": q_ingest_changes,
    "copy_reconcile": q_copy_reconcile,
    "catalog_read": q_catalog_read,
    "encode_roundtrip": q_encode_roundtrip,
    "protect_columns": q_protect_columns,
    "result_envelope": q_result_envelope,
    "statement_kind": q_statement_kind,
    "request_parse": q_request_parse,
    "request_batch": q_request_batch,
    "request_rows": q_request_rows,
    "request_pages": q_request_pages,
    "request_routing": q_request_routing,
    "protocol_lookup": q_protocol_lookup,
    "connection_inventory": q_connection_inventory,
    "source_health": q_source_health,
    "message_route": q_message_route,
    "message_route_stream": q_message_route_stream,
    "session_batch": q_session_batch,
    "session_markers": q_session_markers,
    "session_markers_stream": q_session_markers_stream,
    "session_stream": q_session_stream,
    "session_bytes": q_session_bytes,
    "early_data": q_early_data,
    "early_data_stream": q_early_data_stream,
    "request_response": q_request_response,
    "request_response_stream": q_request_response_stream,
    "log_parse": q_log_parse,
    "log_rate": q_log_rate,
    "log_rate_stream": q_log_rate_stream,
    "auth_bursts": q_auth_bursts,
    "auth_bursts_stream": q_auth_bursts_stream,
}
