"""Helpers shared by the text operators: folds, bounded samples, Arrow maps, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelink.session import shared_dir


def fold_of(id_col: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """True where the id falls in the fold; a null id is in no fold (false)."""
    return F.coalesce(fold_of(id_col, modulus) == F.lit(remainder), F.lit(False))


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("string").cast("binary"), F.lit(b""))


#: Bytes of an Arrow batch; Spark's default of 64 MB is held, and copied as it grows, by every task.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most ``BATCH_BYTES`` (or one row), where the cluster sets no bound itself.

    The size of batches never changes a result.
    """
    if not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage: later jobs, and tasks rerun after a lost executor, read
    the same rows from storage that every executor sees.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_dir(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: the least by the other columns, in their order."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_least")
    return df.groupBy(*keys).agg(least).select(*keys, *(f"_least.`{c}`" for c in rest))


def bounded_sample(df: DataFrame, group: str, max_rows: int, id_col: str) -> DataFrame:
    """About ``max_rows`` ids of each ``group`` value (all, where it has fewer), one row each.

    One counting pass gives each group's number of different ids, to some per
    cent, and so its fraction; an id stays if its 64-bit hash lies below it, so
    the choice depends on the ids alone, not on partitioning, and is as small
    at any size of the table.  Of an id's rows in a group the least is taken
    (before the shuffle, so that an id with most rows is a few there).  The
    groups' counts go through a join that Spark broadcasts where they are
    small, as with labels and languages.
    """
    # Written, so that the planner knows its size before it plans the join: a small table
    # is broadcast and the rows are filtered where they lie, not shuffled by group first.
    counts = materialise(df.groupBy(group).agg(F.approx_count_distinct(id_col, 0.02).alias("_group_ids")),
                         "sample-counts")
    unit = F.xxhash64(F.lit("sample"), F.col(id_col)).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    keep = unit * F.col("_group_ids") < F.lit(float(max_rows))
    return one_row(df.join(counts, group).filter(keep).drop("_group_ids"), group, id_col)


#: Rows of a batch that a task turns into Python objects at a time.
PART_ROWS = 256


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``PART_ROWS`` rows, so that a task holds a batch's
    texts once, in Arrow, and only one slice's Python objects and results beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)
        del batch
        pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, batch_fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of rows in slices (no state between them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield batch_fn(batch)

    return df.mapInArrow(run, schema)


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
