"""Session construction and the shared output folder.

Every job that writes (ingest, copy, keyed appends, streaming sinks and
checkpoints, lineage cuts) writes below ``spark.checkpoint.dir``: on a
cluster that setting names a folder all executors share.  It is read from
the session; where it is unset, a local master (tests) gets a folder of its
own and a cluster gets an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "tidelink",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench (the driver brings its own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDELINK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_PROVIDER_KEY, _ROCKSDB)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a local one only if unset."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    base = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not base:
        base = spark.conf.get(_CHECKPOINT_KEY, None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"{_CHECKPOINT_KEY} is unset: name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidelink-ckpt-")  # one process: its own folder is shared
    sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A fresh folder below the shared checkpoint folder for outputs of a run."""
    base = spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None) or ensure_checkpoint_dir(spark)
    path = "/".join([base.rstrip("/"), "tidelink", *parts])
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    return path


@contextmanager
def state_partitions(spark: SparkSession, n: int | None, rocksdb: bool = False):
    """Start a stateful stream with ``n`` state partitions, if ``rocksdb`` in the RocksDB state store.

    A streaming query copies the session conf when it starts and keeps its
    state partition count for its whole life (checkpoint), so the settings are
    applied around ``start()`` only and the caller's session is restored.
    """
    settings = {"spark.sql.shuffle.partitions": None if n is None else str(n), _PROVIDER_KEY: _ROCKSDB if rocksdb else None}
    settings = {k: v for k, v in settings.items() if v is not None}
    previous = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in previous.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
