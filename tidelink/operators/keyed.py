"""Keyed, repeatable writes and constraint checks as DataFrame jobs.

* ``insert_ignore``            - ``INSERT .. ON CONFLICT (key) DO NOTHING``: the
  first row per key inside the batch wins, keys already in the target are
  skipped, so a re-run adds nothing.
* ``insert_where_not_exists``  - ``INSERT .. SELECT .. WHERE NOT EXISTS``: every
  source row whose key is absent from the target *before* the statement.
* ``dense_index`` / ``surrogate_keys`` - SERIAL-style numbering after the
  current maximum without a single-partition window.
* ``apply_defaults``           - column defaults for omitted/null values.
* ``constraint_report``        - one row per rule with its violation count.

Keys are deduplicated with partial aggregations before any join, so a key
that holds a third of the rows is reduced map-side and never reaches one
task as a third of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelink.session import ensure_checkpoint_dir



def first_per_key(batch: DataFrame, keys, order_col: str) -> DataFrame:
    """Row with the smallest ``order_col`` per key (``order_col`` unique per key).

    ``min(order_col)`` per key is a hash aggregation with map-side partial
    results; the winning rows are then picked with a semi join on the
    (key, order) pair, which is unique - no key holds more than one row there.
    """
    keys = list(keys)
    best = batch.groupBy(*keys).agg(F.min(order_col).alias(order_col))
    return batch.join(best, [*keys, order_col], "left_semi")


def insert_ignore(target: DataFrame, batch: DataFrame, keys, order_col: str) -> DataFrame:
    """Rows of ``batch`` to append: first per key, key not yet in ``target``."""
    winners = first_per_key(batch, keys, order_col)
    existing = target.select(*keys).dropDuplicates()
    return winners.join(existing, list(keys), "left_anti")


def insert_where_not_exists(target: DataFrame, source: DataFrame, keys) -> DataFrame:
    """Rows of ``source`` whose key is absent from ``target`` (state before)."""
    existing = target.select(*keys).dropDuplicates()
    return source.join(existing, list(keys), "left_anti")


def append_rows(rows: DataFrame, path: str, partition_by=None) -> None:
    w = rows.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def dense_index(df: DataFrame, order_cols, out: str = "idx", start: Column | int = 0) -> DataFrame:
    """Number rows 1..n (plus ``start``) in ``order_cols`` order, in parallel.

    Rows are range-partitioned and sorted within partitions; per partition
    the row position comes from ``monotonically_increasing_id`` and the
    offset from a running count over the partition counts (one row per
    partition, a bounded table).  The numbered frame is checkpointed to the
    shared checkpoint folder first, so recomputation after executor loss
    cannot renumber rows.
    """
    order_cols = list(order_cols)
    ensure_checkpoint_dir(df.sparkSession)
    d = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    d = d.checkpoint(eager=True)
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    start_col = start if isinstance(start, Column) else F.lit(start)
    out_df = d.join(F.broadcast(offsets), "_pid")
    return out_df.withColumn(out, (start_col + F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
                             .cast("long")).drop("_pid", "_mid", "_m0", "_off")


def surrogate_keys(target: DataFrame, batch: DataFrame, key_col: str, order_cols,
                   out: str = "new_key") -> DataFrame:
    """New keys for ``batch`` numbered after ``max(target.key_col)``."""
    mx = target.agg(F.coalesce(F.max(key_col), F.lit(0)).alias("_max"))
    base = mx.first()["_max"]  # one scalar, computed by a distributed aggregate
    return dense_index(batch, order_cols, out=out, start=int(base))


def apply_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill omitted or null columns with their default expressions."""
    out = df
    for name, expr in defaults.items():
        value = expr if isinstance(expr, Column) else F.lit(expr)
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), value))
        else:
            out = out.withColumn(name, value)
    return out


@dataclass
class Rule:
    name: str
    violations: DataFrame          # one row, one column ``violations``


def rule_unique(name: str, df: DataFrame, keys) -> Rule:
    """Number of key values that occur more than once (nulls ignored)."""
    nonnull = df
    for k in keys:
        nonnull = nonnull.filter(F.col(k).isNotNull())
    dup = nonnull.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return Rule(name, dup.agg(F.count(F.lit(1)).cast("long").alias("violations")))


def rule_not_null(name: str, df: DataFrame, column: str) -> Rule:
    v = df.agg(F.sum(F.when(F.col(column).isNull(), 1).otherwise(0)).cast("long").alias("violations"))
    return Rule(name, v.fillna(0))


def rule_max_length(name: str, df: DataFrame, column: str, n: int) -> Rule:
    v = df.agg(F.sum(F.when(F.length(column) > n, 1).otherwise(0)).cast("long").alias("violations"))
    return Rule(name, v.fillna(0))


def rule_foreign_key(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> Rule:
    """Child rows whose non-null key has no parent row.

    Distinct child keys are anti-joined (partial aggregation first), then
    the orphan key counts are summed back.
    """
    keys = (child.filter(F.col(fk).isNotNull()).groupBy(fk)
            .agg(F.count(F.lit(1)).alias("_n")))
    parents = parent.select(F.col(pk).alias(fk)).dropDuplicates()
    orphans = keys.join(parents, fk, "left_anti")
    v = orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations"))
    return Rule(name, v)


def rule_row_checks(df: DataFrame, checks: dict) -> DataFrame:
    """Several per-row rules (NOT NULL, length bound, ...) in one scan.

    ``checks`` maps a rule name to the condition a violating row meets; the
    result has one ``(rule, violations)`` row per rule.
    """
    sums = [F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"_v{i}")
            for i, cond in enumerate(checks.values())]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_v{i}").alias("violations"))
                     for i, name in enumerate(checks)])
    return df.agg(*sums).select(F.inline(rows))


def constraint_report(rules) -> DataFrame:
    """Union of rule results: ``Rule`` objects or ``(rule, violations)`` frames."""
    frames = [r if isinstance(r, DataFrame) else r.violations.select(F.lit(r.name).alias("rule"), "violations")
              for r in rules]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

