"""Points inside intervals as an equi-join on bins.

A join on ``low <= point <= high`` alone has no key, so Spark would compare
every two rows.  Intervals are put on levels by their length: at level n a
bin is 2^n wide and at least as long as the interval, which therefore meets
at most two bins and is listed in each; a point stands in one bin of every
level that occurs.  The join is on (level, bin), each pair meets once, and
the interval's borders are checked.

A bin that very many rows fall in is split: its points are dealt to rows and
its intervals to columns of a grid, each point meets every column and each
interval every row, so a cell holds a bounded number of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelink.functions.temporal import ntz_micros
from tidelink.session import shared_dir

SPLIT_ROWS = 100_000  # rows of one side in a cell of a split bin, about
LEVEL_STEP = 2        # only every second level is used


def _coordinate(df: DataFrame, name: str) -> Column:
    """The column as a whole number that orders alike."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return ntz_micros(name)
    if kind == "timestamp":
        return F.unix_micros(name)
    if kind == "date":
        return F.unix_date(name).cast("long")
    if kind in ("byte", "short", "integer", "long"):
        return F.col(name).cast("long")
    raise TypeError(f"{name}: {kind} has no whole-number coordinate")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a row number ``_row``, which stays whatever tasks are run again."""
    path = shared_dir(df.sparkSession, "range-join", name)
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def range_join(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, keys: tuple[str, ...] = (),
               split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Every pair of a point and an interval that holds it (borders included), once.

    ``keys`` name columns that must be equal besides, and stand once in the
    result; all other column names must differ.  Nulls match nothing, nor does
    an interval whose end lies before its start; repeated rows pair each.
    """
    keys = list(keys)
    right = intervals.withColumn("_low", _coordinate(intervals, low)).withColumn("_high", _coordinate(intervals, high))
    right = right.filter(F.col("_low") <= F.col("_high"))
    bits = F.length(F.bin(F.col("_high") - F.col("_low")))
    right = right.withColumn("_level", (F.ceil(bits / LEVEL_STEP) * LEVEL_STEP).cast("int"))
    left = points.withColumn("_at", _coordinate(points, point)).filter("_at is not null")
    levels = sorted(r["_level"] for r in right.select("_level").distinct().collect())  # 32 at most
    if not levels:
        levels = [LEVEL_STEP]

    def binned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        left = left.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
        right = right.withColumn("_bin", F.explode(F.array_distinct(F.array(
            F.expr("shiftright(_low, _level)"), F.expr("shiftright(_high, _level)")))))
        return left.withColumn("_bin", F.expr("shiftright(_at, _level)")), right

    on = [*keys, "_level", "_bin"]
    p, i = binned(left, right)
    sides = p.select(*on, F.lit(1).alias("_p"), F.lit(0).alias("_i")).unionByName(i.select(*on, F.lit(0).alias("_p"), F.lit(1).alias("_i")))
    full = sides.groupBy(*on).agg(F.sum("_p").alias("_p"), F.sum("_i").alias("_i")).filter(
        (F.col("_p") > 0) & (F.col("_i") > 0) & (F.greatest("_p", "_i") > split_rows))
    path = shared_dir(points.sparkSession, "range-join", "split")
    full = full.select(*on, F.ceil(F.col("_p") / split_rows).cast("int").alias("_rows"), F.ceil(F.col("_i") / split_rows).cast("int").alias("_columns"))
    full.write.parquet(path)
    full = points.sparkSession.read.schema(full.schema).parquet(path)
    if not full.isEmpty():
        p, i = binned(_numbered(left, "points"), _numbered(right, "intervals"))

        def dealt(side: DataFrame, own: str, other: str, mine: str, every: str) -> DataFrame:
            side = side.join(full, on, "left")
            n_own, n_other = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
            return (side.withColumn(mine, F.pmod(F.xxhash64("_row"), n_own).cast("int"))
                    .withColumn(every, F.explode(F.sequence(F.lit(0), n_other - 1))).drop("_row", "_rows", "_columns"))

        p, i = dealt(p, "_rows", "_columns", "_r", "_c"), dealt(i, "_columns", "_rows", "_c", "_r")
        on = [*on, "_r", "_c"]
    pairs = p.join(i, on).filter((F.col("_at") >= F.col("_low")) & (F.col("_at") <= F.col("_high")))
    return pairs.select(*points.columns, *[c for c in intervals.columns if c not in keys])
