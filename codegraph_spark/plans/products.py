"""Equi-joins in which a key repeats on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.plans.lineage import cut

PAIRS_IN_PART = 1_000_000  # pairs of a key that one task makes at least
PARTS = 2_000  # shares of all pairs; a key with more than one is cut


def product_join(left: DataFrame, right: DataFrame, by: list[str], spread: list[str], keys: DataFrame | None = None, weight: int = 1) -> DataFrame:
    """``left`` joined with ``right`` on ``by``, by the cells of ``grid``."""
    cells, copies = grid(left, right, by, spread, keys, weight)
    return cells.join(copies, [*by, "_part"]).drop("_part")


def grid(left: DataFrame, right: DataFrame, by: list[str], spread: list[str], keys: DataFrame | None = None, weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``, in which a row of ``left`` and one of ``right`` with the same ``by`` meet exactly once.

    Keys of many pairs are cut into a grid of counted parts of both sides' rows.

    The pairs of every key are counted first; ``keys`` may give the rows of ``left`` without their wide columns for that. At most
    ``PARTS`` keys can hold more than that share of all pairs, so the list of them is small whatever the input. A row travels to a line of the
    grid, so n pairs cost about the root of n; ``weight`` says how many times wider a row of ``left`` is, and the grid has as many more cuts of
    it. ``spread`` tells the rows of ``left`` apart.
    """
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    pairs = cut(count(left if keys is None else keys, "_l").join(count(right, "_r"), by).select(*by, "_l", "_r", (F.col("_l") * F.col("_r")).alias("_n")))
    limit = max(PAIRS_IN_PART, (pairs.agg(F.sum("_n")).first()[0] or 0) // PARTS)
    parts = F.ceil(F.col("_n") / limit)
    across = F.least(F.greatest(F.ceil(F.sqrt(parts * weight * F.col("_l") / F.col("_r"))), F.lit(1)), parts, F.col("_l"))
    many = pairs.filter(F.col("_n") > limit).withColumn("_across", across.cast("long")).withColumn("_down", F.least(F.ceil(parts / F.col("_across")), F.col("_r")).cast("long"))
    split = F.broadcast(many.select(*by, "_across", "_down"))
    across, down = F.coalesce("_across", F.lit(1).cast("long")), F.coalesce("_down", F.lit(1).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    of_left = F.pmod(F.xxhash64(*spread), across) * down
    of_right = F.pmod(F.xxhash64(*[c for c in right.columns if c not in by]), down)
    cells = left.join(split, by, "left").select(*left.columns, of_left.alias("_part"), every(down).alias("_cell")).withColumn("_part", F.col("_part") + F.col("_cell"))
    copies = right.join(split, by, "left").select(*right.columns, of_right.alias("_part"), down.alias("_down"), every(across).alias("_cell"))
    copies = copies.withColumn("_part", F.col("_part") + F.col("_cell") * F.col("_down"))
    return cells.drop("_cell"), copies.drop("_cell", "_down")
