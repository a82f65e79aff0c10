"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the (domain, language, source) triples of the documents. The token budget runs down the tree: at every node it is shared among
the children by weight, no child gets more than its leaves can supply in the allowed epochs, and what a child leaves over goes to its
siblings by weight before anything returns to the level above. Each leaf then repeats its documents for whole epochs and takes, of the
last epoch, the longest run of documents from the start whose tokens fit; the order of an epoch is drawn from a seed.

A leaf's order is cut into buckets by the drawn key; bucket sums come first, so only documents of one bucket are ever sorted together.

Defined results: null domains, languages and sources are values like any other (weight default); null texts have no tokens and are taken
with whatever stands before them; a budget beyond the supply takes all epochs; negative and zero weights get nothing before siblings
with weight are exhausted, and nothing then either; repeated rows are drawn each by itself, next to each other; extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.llm.small import beside
from codegraph_spark.plans.lineage import cut

LEVELS = ("domain", "language", "source")
BUCKET_DIGITS = 3  # hexadecimal digits of the drawn key: 4,096 buckets of a leaf
SEED = 7


def token_count(text: Column) -> Column:
    """Words between ASCII white space, the unit of the budget where no other is given."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def leaves(docs: DataFrame, domain: Column, tokens: Column | None = None) -> DataFrame:
    """doc_id, text_hash, domain, language, source and n_tokens of every row."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), domain.alias("domain"), F.col("lang").alias("language"), "source", tokens.alias("n_tokens"))


def _weight(level: str, weights: dict[str, dict], default: float) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(default)
    table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(table[F.coalesce(F.col(level), F.lit(""))], F.lit(default))


def share_out(children: DataFrame, parents: list[str]) -> DataFrame:
    """``budget`` of every child: the least of its ``supply`` and a level common to its siblings times its ``weight``.

    Siblings in order of supply per weight are filled one after the other; the level is reached where the rest of the budget, spread over
    the weights not yet filled, no longer fills the next one. Rows: ``parents``, ``parent_budget``, ``weight``, ``supply``.
    """
    usable = F.greatest(F.col("weight"), F.lit(0.0))
    ratio = F.when(usable > 0, F.col("supply") / usable).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parents).orderBy("ratio", *[c for c in LEVELS if c in children.columns])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = children.withColumn("usable", usable).withColumn("ratio", ratio)
    left = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("usable") > 0, F.col("supply"))).over(before), F.lit(0))
    d = d.withColumn("level", F.when(F.col("usable") > 0, left / F.sum("usable").over(onward)))
    # the level stands still from the first child on that it does not fill
    d = d.withColumn("first", F.min(F.when(F.col("level") < F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))).over(Window.partitionBy(*parents)))
    budget = F.when(F.col("usable") <= 0, 0.0).when(F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")), F.col("supply")).otherwise(F.least(F.col("supply"), F.greatest(F.col("first.level"), F.lit(0.0)) * F.col("usable")))
    return d.withColumn("budget", budget).drop("usable", "ratio", "level", "first")


def plan(rows: DataFrame, budget_tokens: float | None, share: float, max_epochs: int, weights: dict[str, dict] | None = None, default_weight: float = 1.0) -> DataFrame:
    """Per leaf: n_docs, leaf_tokens, allotted tokens (whole), full epochs and the tokens of the last, partial one.

    ``budget_tokens``, or else ``share`` of all tokens, is handed down; ``weights`` by level and name, relative to siblings.
    """
    weights = weights or {}
    # zero-token leaves stay: their documents cost nothing
    base = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("leaf_tokens"))
    base = cut(base.withColumn("supply", (F.col("leaf_tokens") * max_epochs).cast("double")))
    if budget_tokens is None:
        budget_tokens = math.floor((base.agg(F.sum("leaf_tokens")).first()[0] or 0) * share)
    top = base.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumns({"root": F.lit(0), "parent_budget": F.lit(float(budget_tokens))})
    top = share_out(top.withColumn("weight", _weight("domain", weights, default_weight)), ["root"])
    mid = base.groupBy("domain", "language").agg(F.sum("supply").alias("supply"))
    mid = _under(mid, top, ["domain"]).withColumn("weight", _weight("language", weights, default_weight))
    mid = share_out(mid, ["domain"])
    low = _under(base, mid, ["domain", "language"]).withColumn("weight", _weight("source", weights, default_weight))
    low = share_out(low, ["domain", "language"])
    allotted = F.floor(F.round("budget", 6)).cast("long")
    full = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("allotted") / F.col("leaf_tokens"))).otherwise(F.lit(max_epochs)).cast("int")
    out = low.select(*LEVELS, "n_docs", "leaf_tokens", allotted.alias("allotted")).withColumn("full_epochs", full)
    return out.withColumn("rest_tokens", F.col("allotted") - F.col("full_epochs") * F.col("leaf_tokens"))


def _under(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    p = parents.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("budget").alias("parent_budget"))
    same = F.lit(True)
    for k in keys:
        same = same & children[k].eqNullSafe(p[f"_{k}"])
    return children.join(p, same).drop(*[f"_{k}" for k in keys])


def drawn_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def select(rows: DataFrame, leaf_plan: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, epoch, the leaf and n_tokens of every chosen document, one row per epoch that it is in."""
    p = beside(cut(leaf_plan))
    at = p.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "full_epochs", "rest_tokens", "leaf_tokens")
    same = F.lit(True)
    for c in LEVELS:
        same = same & rows[c].eqNullSafe(at[f"_{c}"])
    met = rows.join(at, same)
    whole = met.where(F.col("full_epochs") > 0).select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("full_epochs") - 1)).alias("epoch"))
    part = met.where(F.col("rest_tokens") > 0).select(*rows.columns, F.col("full_epochs").alias("epoch"), "rest_tokens")
    part = part.withColumn("key", drawn_key(seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = part.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*LEVELS).orderBy("bucket")
    ahead = cut(sums.withColumn("ahead", F.sum("n").over(w) - F.col("n")).select(*[F.col(c).alias(f"_{c}") for c in (*LEVELS, "bucket")], "ahead"))
    same = F.lit(True)
    for c in (*LEVELS, "bucket"):
        same = same & part[c].eqNullSafe(ahead[f"_{c}"])
    placed = part.join(ahead, same)
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = placed.withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(inside)).where(F.col("upto") <= F.col("rest_tokens"))
    return whole.unionByName(taken.select(*whole.columns))


def mix(docs: DataFrame, domain: Column, share: float, max_epochs: int, weights: dict[str, dict] | None = None, budget_tokens: float | None = None, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    rows = cut(leaves(docs, domain, tokens))
    return select(rows, plan(rows, budget_tokens, share, max_epochs, weights), seed)


def take(docs: DataFrame, selection: DataFrame) -> DataFrame:
    """The rows of ``docs`` once per epoch of ``selection``, with their own columns; equal rows are counted once each."""
    times = selection.groupBy("doc_id", "text_hash").agg(F.max("epoch").alias("_upto"), F.countDistinct("epoch").alias("_times")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_times")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_h"))
    met = rows.join(times, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("row.*")
