"""Point-in-interval joins without pairing every point with every interval.

Positions are cut into blocks of 16, 16^2, 16^3 ... An interval is covered by
the few largest aligned blocks inside it; a point lies in exactly one block
per level.  A block is one equi-join key, and per key only the best interval is
kept before the join, so the work is linear in points plus intervals however
deeply intervals nest and however many points one file holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.plans import sizing

LEVELS = 8
BITS = 4
LEVEL_SHIFT = 40


def _runs(level: int, lo: Column, hi: Column) -> Column:
    base = F.lit(level << LEVEL_SHIFT)
    empty = F.array().cast("array<bigint>")
    return F.when(lo < hi, F.sequence(base + lo, base + hi - 1)).otherwise(empty)


def covering_blocks(start: Column, end: Column) -> Column:
    """Block ids whose disjoint union is exactly the positions start..end."""
    start, end = start.cast("long"), end.cast("long")
    bounds = [
        (F.shiftright(start + F.lit((1 << (BITS * l)) - 1), BITS * l), F.shiftright(end + 1, BITS * l))
        for l in range(LEVELS)
    ]
    parts = []
    for level, (lo, hi) in enumerate(bounds):
        if level == LEVELS - 1:
            parts.append(_runs(level, lo, hi))
            continue
        up_lo, up_hi = bounds[level + 1]
        split = up_lo < up_hi
        parts.append(_runs(level, lo, F.when(split, up_lo * 16).otherwise(hi)))
        parts.append(_runs(level, F.when(split, up_hi * 16).otherwise(hi), hi))
    return F.concat(*parts)


def containing_blocks(position: Column, levels=range(LEVELS)) -> Column:
    """The block of every level, or of the asked ones, that holds the position."""
    p = position.cast("long")
    return F.array(*[F.lit(l << LEVEL_SHIFT) + F.shiftright(p, BITS * l) for l in levels]).cast("array<bigint>")


def levels_of(blocks: DataFrame, block: str) -> list[int]:
    """The levels of stored blocks: at most ``LEVELS``, and few where intervals are alike in length."""
    return sorted(r[0] for r in blocks.select(F.shiftright(block, LEVEL_SHIFT).cast("int")).distinct().collect())


def _dealt(items: DataFrame, keys, rank: Column, blocks: Column) -> DataFrame:
    """Items dealt out so that a task makes about ``sizing.ROWS`` blocks: the best of a block is found by sorting what a task holds."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    n = items.agg(F.sum(F.size(blocks))).first()[0] or 0
    return items.repartition(max(cores, math.ceil(n / sizing.ROWS)), *keys, rank)


def _match(points: DataFrame, keys, point_blocks: Column, items: DataFrame, item_blocks: Column, rank: Column, at: str, out: str, deal: bool):
    probes = points.select(*keys, at).distinct().select(*keys, at, F.explode(point_blocks).alias("_node"))
    best = (
        (_dealt(items, keys, rank, item_blocks) if deal else items)
        .select(*keys, rank.alias("_rank"), F.explode(item_blocks).alias("_node"))
        .groupBy(*keys, "_node")
        .agg(F.min("_rank").alias("_rank"))
    )
    return probes.join(best, [*keys, "_node"]).groupBy(*keys, at).agg(F.min("_rank").alias(out))


def best_containing(points: DataFrame, intervals: DataFrame, keys, at: str, start: Column, end: Column, rank: Column, out: str = "hit", deal: bool = False) -> DataFrame:
    """Per distinct (keys, at): the smallest ``rank`` among intervals containing it. ``deal`` counts the blocks of stored intervals and deals them out."""
    return _match(points, keys, containing_blocks(F.col(at)), intervals, covering_blocks(start, end), rank, at, out, deal)


def best_at_or_before(points: DataFrame, items: DataFrame, keys, at: str, position: Column, rank: Column, out: str = "hit", deal: bool = False) -> DataFrame:
    """Per distinct (keys, at): the smallest ``rank`` among items positioned at or before it. ``deal`` as above."""
    return _match(points, keys, covering_blocks(F.lit(0), F.col(at)), items, containing_blocks(position), rank, at, out, deal)


def first_at_or_after(points: DataFrame, items: DataFrame, keys, at: str, position: str, out: str) -> DataFrame:
    """Per distinct (keys, at): the least item position that is not before it.

    Points and items of a key stand in one descending order, in which the last item seen is the answer. A key is a part of one file
    (its braces of a depth, its references to a symbol).
    """
    asked = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast(items.schema[position].dataType).alias(out)).distinct()
    given = items.select(*keys, F.col(position).cast("long").alias("_at"), F.lit(0).alias("_point"), F.col(position).alias(out))
    upto = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(given).withColumn(out, F.last(out, ignorenulls=True).over(upto))
    return met.filter((F.col("_point") == 1) & F.col(out).isNotNull()).select(*keys, F.col("_at").cast("int").alias(at), out)
