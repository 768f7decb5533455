"""Port-mapping registry load/refresh and source catalog reads."""

import json
import os
import tempfile

from tidelink.operators.inventory import connection_inventory, with_protocol
from tidelink.sources.registry import (Source, SourceCatalog, load_port_mappings, mappings_from_json_column,
                                       refresh_registry)

FOUR_PORTS = {"mappings": [
    {"local_port": 15001, "remote_host": "ledger.internal", "remote_port": 1521, "description": "billing books"},
    {"local_port": 15002, "remote_host": "ledger.internal", "remote_port": 1521},
    {"local_port": 15003, "remote_host": "10.20.30.40", "remote_port": 9042, "description": ""},
    {"local_port": 443, "remote_host": "edge", "remote_port": 8443, "description": "same far port as none"},
]}


def _write(obj) -> str:
    d = tempfile.mkdtemp(prefix="registry-test-")
    p = os.path.join(d, "mappings.json")
    with open(p, "w") as f:
        json.dump(obj, f)
    return p


def test_load_file_default_and_missing_keys(spark):
    rows = load_port_mappings(spark, _write(FOUR_PORTS)).orderBy("pos").collect()
    assert [(r.local_port, r.remote_host, r.description) for r in rows] == [
        (15001, "ledger.internal", "billing books"), (15002, "ledger.internal", ""), (15003, "10.20.30.40", ""),
        (443, "edge", "same far port as none")]
    default = load_port_mappings(spark, "/nonexistent/registry.json").collect()
    assert [(r.local_port, r.remote_host, r.remote_port, r.description) for r in default] == [
        (5432, "localhost", 5432, "PostgreSQL (default)")]
    assert load_port_mappings(spark, _write({"other": 1})).count() == 0
    no_desc = load_port_mappings(spark, _write({"mappings": [
        {"local_port": 1, "remote_host": "h", "remote_port": 2}]})).first()
    assert no_desc.description == ""


def test_refresh_rejects_and_keeps_first_per_port(spark):
    pushed = {"mappings": [
        {"local_port": 5432, "remote_host": "a", "remote_port": 1},
        {"local_port": 5432, "remote_host": "b", "remote_port": 2},
        {"remote_host": "c", "remote_port": 3},
        {"local_port": 3306, "remote_host": "d", "remote_port": 4},
    ]}
    active, rejected = refresh_registry(load_port_mappings(spark, _write(pushed)))
    assert sorted((r.local_port, r.remote_host) for r in active.collect()) == [(3306, "d"), (5432, "a")]
    assert sorted((r.remote_host, r.reason) for r in rejected.collect()) == [
        ("b", "duplicate local_port"), ("c", "missing required key")]


def test_pushes_as_json_column(spark):
    df = spark.createDataFrame([(1, json.dumps(FOUR_PORTS)), (2, json.dumps({"mappings": []}))],
                               "push_id int, body string")
    rows = mappings_from_json_column(df, "body")
    active, _ = refresh_registry(rows, partition_cols=["push_id"])
    assert active.count() == 4


def test_protocols_and_inventory(spark):
    conns = spark.createDataFrame([(5432,), (5432,), (9999,), (8181,)], "port int")
    got = {r.port: r.protocol for r in with_protocol(conns).collect()}
    assert got == {5432: "postgresql", 9999: "unknown", 8181: "iceberg-rest"}
    inv = connection_inventory(conns).collect()
    assert [(r.port, r.active_connections, r.total_count) for r in inv] == [
        (5432, 2, 3), (8181, 1, 3), (9999, 1, 3)]


def test_source_catalog_parquet(spark, sf_dir):
    cat = SourceCatalog().register("lake", Source("parquet", sf_dir))
    assert cat.read(spark, "lake", "region").count() == 5
    assert cat.resolve(None) is cat.default
    assert cat.resolve("lake") is not None and cat.resolve("nowhere") is None
