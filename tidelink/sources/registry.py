"""Source registry: port mappings and named data sources.

Two registries exist:

* the *port-mapping* registry (``{"mappings": [{local_port, remote_host,
  remote_port, description}]}``) that links a local port with a remote
  service; it is loaded from JSON, refreshed by whole replacement, and
  validated as a DataFrame (rows missing a required key are rejected, the
  first row per port wins);
* the *source catalog* used by readers: a name (or ``host:port``) resolves to
  a reader kind (``jdbc``, ``parquet``, ``table``, ``session``) plus options.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPPING = T.StructType([
    T.StructField("local_port", T.IntegerType()),
    T.StructField("remote_host", T.StringType()),
    T.StructField("remote_port", T.IntegerType()),
    T.StructField("description", T.StringType()),
])
MAPPING_FILE = T.StructType([T.StructField("mappings", T.ArrayType(MAPPING))])

# The mapping used when no registry file exists.
DEFAULT_MAPPING = (5432, "localhost", 5432, "PostgreSQL (default)")
REQUIRED = ("local_port", "remote_host", "remote_port")


def default_mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([DEFAULT_MAPPING], MAPPING).withColumn("pos", F.lit(0))


def load_port_mappings(spark: SparkSession, path: str | None) -> DataFrame:
    """Registry rows ``(pos, local_port, remote_host, remote_port, description)``.

    Missing file -> the single default row; a file without ``mappings`` ->
    no rows; a missing ``description`` becomes ``''``.
    """
    if not path:
        return default_mappings(spark)
    try:
        raw = spark.read.schema(MAPPING_FILE).option("multiLine", True).json(path)
        raw.schema  # noqa: B018 - forces path resolution
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return default_mappings(spark)
    rows = raw.select(F.posexplode("mappings").alias("pos", "m")).select("pos", "m.*")
    return rows.withColumn("description", F.coalesce("description", F.lit("")))


def mappings_from_json_column(df: DataFrame, column: str) -> DataFrame:
    """Explode registry pushes carried as JSON text (one push per row)."""
    parsed = df.withColumn("_push", F.from_json(F.col(column), MAPPING_FILE))
    rows = parsed.select("*", F.posexplode("_push.mappings").alias("pos", "m")).drop("_push")
    rows = rows.select(*[c for c in rows.columns if c not in ("m",)], "m.*")
    return rows.withColumn("description", F.coalesce("description", F.lit("")))


def refresh_registry(rows: DataFrame, partition_cols=()) -> tuple[DataFrame, DataFrame]:
    """Split a pushed registry into (active, rejected).

    Rows lacking a required key are rejected; of several rows for one local
    port the first (lowest ``pos``) is kept and the others are rejected.
    ``partition_cols`` scopes the rule (e.g. per push id when many pushes
    are processed at once).  Per-port grouping is a partial aggregation, so
    a port pushed millions of times does not gather in one task.
    """
    keys = [*partition_cols, "local_port"]
    valid_cond = F.lit(True)
    for c in REQUIRED:
        valid_cond = valid_cond & F.col(c).isNotNull()
    flagged = rows.withColumn("_valid", valid_cond)
    valid = flagged.filter("_valid").drop("_valid")
    first = valid.groupBy(*keys).agg(F.min("pos").alias("pos"))
    active = valid.join(first, [*keys, "pos"], "left_semi")
    dup = valid.join(first, [*keys, "pos"], "left_anti").withColumn("reason", F.lit("duplicate local_port"))
    missing = flagged.filter(~F.col("_valid")).drop("_valid").withColumn("reason", F.lit("missing required key"))
    return active, missing.unionByName(dup)


def write_registry(active: DataFrame, path: str) -> None:
    """Each push replaces the whole registry."""
    active.write.mode("overwrite").parquet(path)


@dataclass
class Source:
    kind: str                      # jdbc | parquet | table | session
    location: str = ""             # url / path / table name
    options: dict = field(default_factory=dict)


class SourceCatalog:
    """Name -> Source; ``host:port`` names resolve through port mappings."""

    def __init__(self, default: Source | None = None):
        self._by_name: dict[str, Source] = {}
        self.default = default or Source("session")

    def register(self, name: str, source: Source) -> SourceCatalog:
        self._by_name[name] = source
        return self

    def names(self):
        return sorted(self._by_name)

    def resolve(self, host: str | None = None, port: int | None = None) -> Source | None:
        if host is None:
            return self.default
        for key in (f"{host}:{port}" if port is not None else None, host):
            if key and key in self._by_name:
                return self._by_name[key]
        return None

    def read(self, spark: SparkSession, name: str, table: str | None = None) -> DataFrame:
        src = self._by_name[name]
        return read_source(spark, src, table)


def read_source(spark: SparkSession, src: Source, table: str | None = None) -> DataFrame:
    if src.kind == "parquet":
        path = src.location if table is None else f"{src.location.rstrip('/')}/{table}.parquet"
        return spark.read.options(**src.options).parquet(path)
    if src.kind == "table":
        return spark.table(table or src.location)
    if src.kind == "session":
        return spark.table(table)
    if src.kind == "jdbc":
        reader = spark.read.format("jdbc").option("url", src.location).options(**src.options)
        return reader.option("dbtable", table).load()
    raise ValueError(f"unknown source kind {src.kind!r}")

