"""Moving counts and sums over the time before each row, for keys of any size.

``RANGE BETWEEN x PRECEDING AND CURRENT ROW`` of a plain window sends all rows
of a key to one task.  Here the key's instants (rows of one instant are one,
by a partial aggregation) are cut into slices of equal size, and a slice gets

* a halo: the instants of those earlier slices in which a frame of the slice
  begins, from the first such beginning on;
* one number for the slices between, which lie in all its frames.

A slice is in the halo of the slices whose frames begin in it: the beginnings
move on with the slices, so all halos together have about twice the instants
of the table, however many of them fall into one frame.  The sums are exact
and independent of the number of slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelink.functions.temporal import ntz_micros
from tidelink.operators.sequence import SLICE, slice_rows, split_valid


def _halos(cut: DataFrame, keys: list[str], before_us: int) -> DataFrame:
    """Per key and slice: the slices of its halo (``_first`` to ``_last``), where it starts, and the sums between."""
    whole = (Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1))
    own = (cut.groupBy(*keys, SLICE).agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
           .withColumn("_n_before", F.coalesce(F.sum("_n").over(whole), F.lit(0)))
           .withColumn("_v_before", F.coalesce(F.sum("_v").over(whole), F.lit(0))))
    none = F.lit(None)
    # The last slice that starts at or before the latest beginning of a frame, and all sums up to it.
    marks = own.select(*keys, F.col("_a").alias("_at"), F.lit(0).alias("_kind"), F.col(SLICE).alias("_mark"), "_n", "_v", none.cast("int").alias(SLICE))
    asks = own.select(*keys, (F.col("_b") - before_us).alias("_at"), F.lit(1).alias("_kind"), none.cast("int").alias("_mark"),
                      none.cast("long").alias("_n"), none.cast(own.schema["_v"].dataType).alias("_v"), SLICE)
    upto = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = (marks.unionByName(asks).select(*keys, SLICE, F.max("_mark").over(upto).alias("_last"),
                                             F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n_upto"),
                                             F.coalesce(F.sum("_v").over(upto), F.lit(0)).alias("_v_upto")).filter(F.col(SLICE).isNotNull()))
    # The first slice that ends at or after the earliest beginning.
    marks = own.select(*keys, F.col("_b").alias("_at"), F.lit(1).alias("_kind"), F.col(SLICE).alias("_mark"), none.cast("int").alias(SLICE))
    asks = own.select(*keys, (F.col("_a") - before_us).alias("_at"), F.lit(0).alias("_kind"), none.cast("int").alias("_mark"), SLICE)
    onward = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earliest = marks.unionByName(asks).select(*keys, SLICE, F.min("_mark").over(onward).alias("_first")).filter(F.col(SLICE).isNotNull())
    found = own.join(latest, [*keys, SLICE]).join(earliest, [*keys, SLICE])
    between = F.coalesce("_last", F.lit(-1)) < F.col(SLICE) - 1
    return found.select(*keys, SLICE, (F.col("_a") - before_us).alias("_start"), "_first",
                        F.least(F.coalesce("_last", F.lit(-1)), F.col(SLICE) - 1).alias("_last"),
                        F.when(between, F.col("_n_before") - F.col("_n_upto")).otherwise(0).alias("_n_between"),
                        F.when(between, F.col("_v_before") - F.col("_v_upto")).otherwise(0).alias("_v_between"))


def moving_sums(df: DataFrame, keys: list[str], ts: str, before_us: int, value: str, count_as: str = "n_moving",
                sum_as: str = "sum_moving", slices: int | None = None) -> DataFrame:
    """Rows of ``df`` with the count and sum of ``value`` over their key's rows of the last ``before_us`` microseconds.

    The frame holds both ends and all rows of the same instant.  ``value`` is a
    whole number or a decimal (sums of doubles would depend on the order); a
    null value counts as a row and adds nothing.  Rows with a null key or time
    have no frame (``split_valid`` gives them).
    """
    kind = df.schema[value].dataType.typeName()
    if kind in ("float", "double"):
        raise TypeError(f"{value}: cast it to a decimal or whole type, sums of {kind} depend on the order")
    rows = split_valid(df, *keys, ts)[0].withColumn("_us", ntz_micros(ts))
    exact = F.coalesce(F.col(value), F.lit(0)).cast("decimal(38,0)" if kind != "decimal" else df.schema[value].dataType)
    instants = rows.groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_n"), F.sum(exact).alias("_v"))
    cut = slice_rows(instants, keys, "_us", slices=slices)
    halos = _halos(cut, keys, before_us)
    feeds = halos.filter("_first <= _last").select(*keys, F.explode(F.sequence("_first", "_last")).alias(SLICE),
                                                   F.col(SLICE).alias("_to"), "_start")
    halo = cut.join(feeds, [*keys, SLICE]).filter("_us >= _start").select(*keys, F.col("_to").alias(SLICE), "_us", "_n", "_v", F.lit(False).alias("_own"))
    frame = Window.partitionBy(*keys, SLICE).orderBy("_us").rangeBetween(-before_us, 0)
    summed = (cut.withColumn("_own", F.lit(True)).unionByName(halo)
              .select(*keys, SLICE, "_us", "_own", F.sum("_n").over(frame).alias("_n"), F.sum("_v").over(frame).alias("_v"))
              .filter("_own").join(halos.select(*keys, SLICE, "_n_between", "_v_between"), [*keys, SLICE])
              .select(*keys, "_us", (F.col("_n") + F.col("_n_between")).alias(count_as), (F.col("_v") + F.col("_v_between")).alias(sum_as)))
    return rows.join(summed, [*keys, "_us"]).drop("_us")
