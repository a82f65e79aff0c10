"""Places of rows inside ordered runs of any length, without a window over a whole run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.llm.small import beside
from codegraph_spark.plans.lineage import cut


def ordered(rows: DataFrame, run: list[str], order: list[Column | str]) -> DataFrame:
    """``rows``, written in the order of ``run`` and ``order``, with ``_part`` (the range) and ``_at`` (ascending inside it).

    Rows are dealt by ranges, so a long run lies in many parts; equal rows are told apart by where they were read and may be split too.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*run, *order, "_read"]
    sorted_rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return cut(sorted_rows.drop("_read").withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))


def starts(sorted_rows: DataFrame, run: list[str]) -> DataFrame:
    """One row per part and run: ``_first`` (least ``_at``), ``_ahead`` (rows of the run in earlier parts) and ``size`` of the run."""
    met = sorted_rows.groupBy("_part", *run).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_run = Window.partitionBy(*run)
    before = by_run.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return met.select("_part", *run, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"), F.sum("_n").over(by_run).alias("size"))


def place(sorted_rows: DataFrame, begins: DataFrame, run: list[str]) -> DataFrame:
    """Columns of both sides and ``pos``, the place in the run from 0. ``begins`` is written and has the columns of ``starts`` and maybe more."""
    met = sorted_rows.join(beside(begins), ["_part", *run])
    return met.withColumn("pos", F.col("_ahead") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_ahead")


def placed(rows: DataFrame, run: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``size`` of their run; the columns of ``run`` hold no null."""
    sorted_rows = ordered(rows, run, order)
    return place(sorted_rows, cut(starts(sorted_rows, run)), run)
