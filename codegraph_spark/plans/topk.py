"""Ranking within request groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cols(order):
    return [F.col(o) if isinstance(o, str) else o for o in order]


def rank_within(df: DataFrame, keys, order, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))))


def top_k(df: DataFrame, keys, order, k: int | None, limit: Column | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group by a total order.

    The literal bound lets Spark keep only ``k`` rows per group and map task
    before the shuffle, so one hot request never ships all its candidates.
    ``limit`` narrows the bound per row; ``k`` None keeps every row.
    """
    if k is None:
        ranked = rank_within(df, keys, order, rank)
        return ranked if limit is None else ranked.filter(F.col(rank) <= limit)
    keep = F.col(rank) <= F.lit(k)
    if limit is not None:
        keep = keep & (F.col(rank) <= limit)
    return rank_within(df, keys, order, rank).filter(keep)


def best_one(df: DataFrame, keys, order) -> DataFrame:
    return top_k(df, keys, order, 1, rank="_rank").drop("_rank")
