"""Prefix scans over ordered groups of any length.

A plain window would put one whole group into one task.  Here a group is cut
into blocks of consecutive order values; each block is scanned on its own and
only one summary row per block goes through the per-group window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))


def _upto(keys, order):
    return Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fill_forward(df: DataFrame, keys, order: str, value: Column, out: str, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before (or strictly before) each row of its group."""
    d = _blocked(df, order, block).withColumn("_v", value)
    span = _upto(keys, order)
    if not inclusive:
        span = span.rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("_local", F.last("_v", ignorenulls=True).over(span))
    heads = d.groupBy(*keys, "_block").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_head")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*keys, "_block", F.last("_head", ignorenulls=True).over(before).alias("_carry"))
    return (
        local.join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_block", "_v", "_local", "_carry")
    )


def running_sum(df: DataFrame, keys, order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` from the start of the group up to and including each row."""
    d = _blocked(df, order, block).withColumn("_v", value)
    local = d.withColumn("_local", F.sum("_v").over(_upto(keys, order)))
    sums = d.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    return (
        local.join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_block", "_v", "_local", "_carry")
    )
