"""Gram postings of files: which files can hold a match.

``build`` lists the files of every run of three characters, ASCII letters lower-cased; ``write`` keeps the list sorted by gram, so a
look-up reads few row groups. Patterns meet it through the rarest grams of the texts that each of their matches must hold; only files with
all of those are read, and only the patterns that may match there are tried on their lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.functions.required import FOLD
from codegraph_spark.plans.lineage import cut

GRAM = 3
MEETING = 3  # grams of a pattern that a file must hold
PIECE = 4096  # characters of a long text that are cut into grams at once
WHOLE = 1 << 18  # characters of a text whose grams are held at once
KEY = ["repo_name", "file_path"]


def _fold(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=([^\\r\\n]{{{GRAM}}}))"), 1))


def build(files: DataFrame) -> DataFrame:
    """(gram, repo_name, file_path), once each for files given once.

    The grams of a file are made distinct where it stands, without an exchange. Files longer than ``WHOLE`` are cut into overlapping
    pieces, so no row grows with a text; only their grams are made distinct by an exchange.
    """
    short = F.length("content") <= WHOLE
    whole = files.filter(short).select(F.explode(_grams(_fold(F.col("content")))).alias("gram"), *KEY)
    pieces = F.regexp_extract_all(_fold(F.col("content")), F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), 1)
    rows = files.filter(~short).select(*KEY, F.explode(pieces).alias("piece"))
    return whole.unionByName(rows.select(F.explode(_grams(F.col("piece"))).alias("gram"), *KEY).distinct())


def write(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings sorted by gram; a gram that all files hold is spread over several tasks. Ranges are sampled from the written rows."""
    cut(postings).repartitionByRange("gram", *KEY).sortWithinPartitions("gram").write.mode(mode).parquet(path)


def grams_of(texts: list[str]) -> set[str]:
    folded = [t.translate(FOLD) for t in texts]
    grams = {t[i : i + GRAM] for t in folded for i in range(len(t) - GRAM + 1)}
    return {g for g in grams if not set(g) & {"\r", "\n"}}


def candidates(postings: DataFrame, needs: dict[int, list[str]]) -> DataFrame:
    """(repo_name, file_path, may): the files that hold the rarest grams of ``needs``, with the numbers of those they may match.

    Grams of the patterns come to the driver with their counts, as many as the patterns have; files never do.
    """
    grams = {i: grams_of(texts) for i, texts in needs.items()}
    asked = sorted(set().union(*grams.values()))
    found = postings.filter(F.col("gram").isin(asked)).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["gram"]: r["n"] for r in found}
    spark = postings.sparkSession
    meet = [(i, g, min(len(gs), MEETING)) for i, gs in grams.items() for g in sorted(gs, key=lambda g: (counts.get(g, 0), g))[:MEETING]]
    sought = F.broadcast(spark.createDataFrame(meet, "number int, gram string, need int"))  # a few rows per pattern
    rows = postings.filter(F.col("gram").isin(sorted({g for _, g, _ in meet}))).join(sought, "gram")
    full = rows.groupBy(*KEY, "number", "need").agg(F.count_distinct("gram").alias("n")).filter("n = need")
    return full.groupBy(*KEY).agg(F.collect_set("number").alias("may"))


def candidate_lines(files: DataFrame, postings: DataFrame, needs: dict[int, list[str]]) -> DataFrame:
    """Lines of the candidate files with ``_may``. The written candidates have a size: few are broadcast, many prune by a runtime filter."""
    met = files.join(cut(candidates(postings, needs)).withColumnRenamed("may", "_may"), KEY)
    return met.select(*KEY, "_may", F.posexplode(tx.lines_of(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)
