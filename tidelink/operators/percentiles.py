"""Exact percentiles per group without a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here the values are counted first (a partial
aggregation, so that copies of one value are one row), range-partitioned by
(group, value) into slices, and ranked by one count per slice: only slices
that hold a wanted rank are read again, and each of them is one task's work
however large its group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelink.operators.joins import join_null_safe
from tidelink.operators.sequence import SLICE, slice_rows


def _ranks(total: Column, fraction: float) -> tuple[Column, Column, Column]:
    """Ranks below and above the fraction of ``total`` values (from 0), and the share of the upper one."""
    at = (total - 1) * F.lit(float(fraction))
    low, high = F.floor(at), F.ceil(at)
    return low.cast("long"), high.cast("long"), at - low


def group_percentiles(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float],
                      slices: int | None = None) -> DataFrame:
    """``*groups, n_rows`` and one interpolated percentile (double) per entry of ``fractions`` (name to 0..1).

    Null values are in ``n_rows`` but have no rank; a group without other
    values has null percentiles.  A null group is a group.  NaN sorts last.
    """
    counts = df.groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_n", F.when(F.col("_v").isNull(), F.lit(0)).otherwise(F.col("_rows")).cast("long"))
    cut = slice_rows(counts, groups, "_v", slices=slices)
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice and group from here on.
    summary = (cut.groupBy(*groups, SLICE).agg(F.sum("_n").alias("_in"), F.sum("_rows").alias("_rows_in"))
               .withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
               .withColumn("_total", F.sum("_in").over(of_group)))
    wanted = F.array_distinct(F.array(*[r for q in fractions.values() for r in _ranks(F.col("_total"), q)[:2]]))
    here = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    holding = summary.select(*groups, SLICE, "_before", here.alias("_wanted")).filter(F.size("_wanted") > 0)
    in_slice = Window.partitionBy(*groups, SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_null_safe(cut, holding, [*groups, SLICE]).withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_n").over(in_slice), F.lit(0)))
    mine = F.filter("_wanted", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    # At most two rows per group and fraction.
    picked = ranked.select(*groups, F.col("_v"), F.explode(mine).alias("_rank"))
    totals = summary.groupBy(*groups).agg(F.sum("_rows_in").alias("n_rows"), F.max("_total").alias("_total"))
    both = join_null_safe(totals, picked, groups, "left")
    found = []
    for name, q in fractions.items():
        low, high, share = _ranks(F.col("_total"), q)
        a = F.max(F.when(F.col("_rank") == low, F.col("_v")))
        b = F.max(F.when(F.col("_rank") == high, F.col("_v")))
        share = F.max(share)
        found.append(F.when(share == 0, a).otherwise(a + (b - a) * share).alias(name))
    return both.groupBy(*groups, "n_rows").agg(*found)
