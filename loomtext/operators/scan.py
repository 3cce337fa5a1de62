"""Running values over a long order, without one task for all of it.

A table is cut into ranges of its order. Each range is summed up to one row, the
rows of the ranges are scanned (they are few), and every range then runs by
itself from what the ones before it carry in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, by: str, part: str, order: list[str], own: Column, total: Column):
    ranges = df.withColumn("_own", own).groupBy(by, part).agg(total.alias("_total"))
    return ranges, Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by, part).orderBy(*order)


def running_sum(df: DataFrame, by: str, part: str, order: list[str], own: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``: the sum of ``own`` over the rows of ``by`` up to this one (without it if not ``inclusive``), in the order of ``part`` and ``order``."""
    ranges, before, within = _ranges(df, by, part, order, own, F.sum("_own"))
    carry = ranges.select(by, part, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    frame = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.withColumn("_own", own).withColumn("_here", F.coalesce(F.sum("_own").over(frame), F.lit(0)))
    return out.join(carry, [by, part]).withColumn(name, F.col("_carry") + F.col("_here")).drop("_own", "_here", "_carry")


def last_before(df: DataFrame, by: str, part: str, order: list[str], own: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value of ``own`` that is not null among the rows of ``by`` before this one, or null."""
    ranges, before, within = _ranges(df, by, part, order, own, F.max_by("_own", F.when(F.col("_own").isNotNull(), F.struct(*order))))
    carry = ranges.select(by, part, F.last("_total", True).over(before).alias("_carry"))
    out = df.withColumn("_own", own).withColumn("_here", F.last("_own", True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    return out.join(carry, [by, part]).withColumn(name, F.coalesce("_here", "_carry")).drop("_own", "_here", "_carry")
