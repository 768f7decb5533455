"""Ordered scans per key that stay parallel when one key is huge.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task; if one user/source holds a third of all rows, that task holds a
third of the data - also if they all fall into one hour.  These helpers cut
by rows, not by time, and work in two levels:

1. the rows are range-partitioned by (key, ts, tiebreak) into slices of equal
   size, numbered in that order, and written once to the shared folder (which
   fixes the slice numbers, whatever tasks are run again);
2. inside ``(key, slice)`` a window does the local part (lag, running sum,
   next value) - at most one slice of rows;
3. per ``(key, slice)`` one summary row is computed with a partial
   aggregation; a window over those summary rows (at most one per slice and
   key) carries the value across slice borders;
4. the carry joins back on ``(key, slice)`` - the same keys the local window
   was partitioned by, so the large side is not shuffled again.

The input is read once, by the range partitioning; later steps read the
written slices.  Results are exact and independent of the number of slices.

Rows with a null key or time have no place in an order: callers take them out
with ``split_valid`` first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelink.functions.temporal import ntz_micros
from tidelink.session import shared_dir

SLICE = "_slice"


def split_valid(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows without a null in ``columns``, the rejected others)."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull()
    return df.filter(good), df.filter(~good)


def slice_rows(df: DataFrame, keys, ts: str, tiebreak=None, slices: int | None = None) -> DataFrame:
    """Add ``_slice``: the number of the row's range partition by (keys, ts, tiebreak)."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, ts, *(tiebreak or [])).withColumn(SLICE, F.spark_partition_id())
    path = shared_dir(spark, "slices")
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def _order(ts: str, tiebreak):
    return [F.col(ts), *[F.col(c) for c in (tiebreak or [])]]


def with_prev(df: DataFrame, keys, ts: str, out: str = "prev_ts", tiebreak=None, slices: int | None = None) -> DataFrame:
    """Add the previous ``ts`` of the same key (null for the first row)."""
    keys = list(keys)
    base = slice_rows(df, keys, ts, tiebreak, slices)
    local = F.lag(ts).over(Window.partitionBy(*keys, SLICE).orderBy(*_order(ts, tiebreak)))
    d = base.withColumn("_lp", local)
    summary = d.groupBy(*keys, SLICE).agg(F.max(ts).alias("_bmax"))
    carry = summary.withColumn(
        "_carry", F.lag("_bmax").over(Window.partitionBy(*keys).orderBy(SLICE))).drop("_bmax")
    d = d.join(carry, [*keys, SLICE], "left")
    return d.withColumn(out, F.coalesce("_lp", "_carry")).drop("_lp", "_carry", SLICE)


def with_running_sum(df: DataFrame, keys, ts: str, value, out: str, inclusive: bool = True,
                     tiebreak=None, slices: int | None = None) -> DataFrame:
    """Add the running sum of ``value`` per key in ``ts`` order.

    ``inclusive=False`` sums strictly earlier rows only.
    """
    keys = list(keys)
    val = F.col(value) if isinstance(value, str) else value
    base = slice_rows(df.withColumn("_v", F.coalesce(val.cast("long"), F.lit(0))), keys, ts, tiebreak, slices)
    frame = (Window.partitionBy(*keys, SLICE).orderBy(*_order(ts, tiebreak))
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    d = base.withColumn("_ls", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    summary = d.groupBy(*keys, SLICE).agg(F.sum("_v").alias("_bs"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_carry", F.coalesce(F.sum("_bs").over(before), F.lit(0))).drop("_bs")
    d = d.join(carry, [*keys, SLICE], "left")
    return d.withColumn(out, (F.col("_ls") + F.col("_carry")).cast("long")).drop("_ls", "_carry", "_v", SLICE)


def _order_key(ts_col, id_col):
    """Exact, fixed-width sort key for (ts, id): decimal(38,0) of
    ``micros * 10^20 + (id + 2^63)`` - hash-aggregable, unlike a struct."""
    micros = ntz_micros(ts_col).cast("decimal(38,0)")
    shifted = id_col.cast("decimal(38,0)") + F.lit(str(2 ** 63)).cast("decimal(38,0)")
    return (micros * F.lit(str(10 ** 20)).cast("decimal(38,0)") + shifted).cast("decimal(38,0)")


def with_next(df: DataFrame, keys, ts: str, when, value_ts: str, value_id: str, out: str,
              tiebreak=None, slices: int | None = None) -> DataFrame:
    """Add ``out = struct(ts, id)`` of the first later row of the key where
    ``when`` holds (ordered by ``ts`` then ``tiebreak``; earliest first).

    Per slice the earliest candidate is found with hash aggregations over an
    exact decimal order key; the carry to earlier slices is a window over
    one summary row per slice.
    """
    keys = list(keys)
    cond = F.col(when) if isinstance(when, str) else when
    base = slice_rows(df.withColumn("_c", cond), keys, ts, tiebreak, slices)
    base = base.withColumn("_v", F.when(F.col("_c"), F.struct(F.col(value_ts).alias("ts"), F.col(value_id).alias("id"))))
    after = (Window.partitionBy(*keys, SLICE).orderBy(*_order(ts, tiebreak))
             .rowsBetween(1, Window.unboundedFollowing))
    d = base.withColumn("_ln", F.first("_v", ignorenulls=True).over(after))
    # Every slice keeps a summary row (its carry is needed even without
    # candidates); non-candidates have a null order key and are skipped.
    ranked = d.withColumn("_ok", F.when(F.col("_c"), _order_key(F.col(value_ts), F.col(value_id))))
    summary = ranked.groupBy(*keys, SLICE).agg(F.min("_ok").alias("_bok"),
                                               F.min_by(value_ts, "_ok").alias("_bts"),
                                               F.min_by(value_id, "_ok").alias("_bid"))
    summary = summary.withColumn("_bmin", F.when(F.col("_bok").isNotNull(), F.struct(
        F.col("_bts").alias("ts"), F.col("_bid").alias("id"))))
    later = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    carry = summary.withColumn("_carry", F.first("_bmin", ignorenulls=True).over(later)).select(
        *keys, SLICE, "_carry")
    d = d.join(carry, [*keys, SLICE], "left")
    return d.withColumn(out, F.coalesce("_ln", "_carry")).drop("_ln", "_carry", "_v", "_c", SLICE)


def marker_segments(df: DataFrame, keys, ts: str, code, tiebreak=None, slices: int | None = None) -> DataFrame:
    """Cut every key's log at its markers (rows where ``code`` is not null).

    A row belongs to the segment numbered by the markers strictly before it.
    One row per segment: ``*keys, segment, n_data, end_code, end_ts,
    open_code, open_ts`` - rows that are no markers, the marker that ends it,
    and the marker that opened it.  A marker counts for the segment it ends
    and for the next one, so one aggregation finishes; no self-join.
    """
    keys = list(keys)
    when = df.schema[ts].dataType.simpleString()
    d = with_running_sum(df.withColumn("_code", code.cast("int")), keys, ts, F.col("_code").isNotNull(),
                         out="segment", inclusive=False, tiebreak=tiebreak, slices=slices)
    nothing, never = F.lit(None).cast("int"), F.lit(None).cast(when)
    marked = F.col("_code").isNotNull()
    here = F.struct(F.col("segment").alias("segment"), F.when(marked, 0).otherwise(1).alias("n"),
                    F.col("_code").alias("ec"), F.when(marked, F.col(ts)).alias("et"), nothing.alias("oc"), never.alias("ot"))
    there = F.struct((F.col("segment") + 1).alias("segment"), F.lit(0).alias("n"), nothing.alias("ec"), never.alias("et"),
                     F.col("_code").alias("oc"), F.col(ts).alias("ot"))
    rows = d.select(*keys, F.explode(F.when(marked, F.array(here, there)).otherwise(F.array(here))).alias("_r"))
    return rows.groupBy(*keys, F.col("_r.segment").alias("segment")).agg(
        F.sum("_r.n").cast("long").alias("n_data"), F.max("_r.ec").alias("end_code"), F.max("_r.et").alias("end_ts"),
        F.max("_r.oc").alias("open_code"), F.max("_r.ot").alias("open_ts"))
