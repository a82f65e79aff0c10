"""History facts per file, kept up to date from batches of commits.

A batch adds one partial row per file it touches. Partial rows merge (least first commit, greatest last one, sum of touches), so reading
is one aggregation over as many rows as files were touched since the last compaction, and no commit is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph_spark.plans import sizing
from codegraph_spark.streaming.deltas import COMPACT_AT, Deltas

_AT = "author_date_utc: timestamp, commit_id: string"
PARTIAL = f"repo_name string, path string, first struct<{_AT}>, last struct<{_AT}, author_name: string, subject: string>, touch_count long"


def partial_facts(touches: DataFrame) -> DataFrame:
    """Partial rows of ``touches(repo_name, commit_id, path, author_name, author_date_utc, subject)``, dealt out by their number first."""
    once = touches.repartition(sizing.parts(touches), "repo_name", "commit_id", "path").dropDuplicates(["repo_name", "commit_id", "path"])
    return once.groupBy("repo_name", "path").agg(
        F.min(F.struct("author_date_utc", "commit_id")).alias("first"),
        F.max(F.struct("author_date_utc", "commit_id", "author_name", "subject")).alias("last"),
        F.count(F.lit(1)).alias("touch_count"),
    )


def merged(partial: DataFrame) -> DataFrame:
    dealt = partial.repartition(sizing.parts(partial), "repo_name", "path")
    return dealt.groupBy("repo_name", "path").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("touch_count").alias("touch_count"))


class FactStore:
    """Partial facts below one folder; a commit comes in one batch."""

    def __init__(self, spark: SparkSession, path: str, compact_at: int = COMPACT_AT):
        self.tables, self.compact_at = Deltas(spark, path, {"facts": PARTIAL}), compact_at

    def add(self, touches: DataFrame, token: str | None = None) -> None:
        """Fold in a batch; one with a ``token`` that is known changes nothing."""
        self.tables.write({"facts": partial_facts(touches)}, token=token)
        if len(self.tables.live()) > self.compact_at:
            self.tables.compact({"facts": merged(self.tables.read("facts"))})

    def facts(self) -> DataFrame:
        """The columns of ``operators.history.file_facts``."""
        return merged(self.tables.read("facts")).select(
            "repo_name", "path", F.col("first.commit_id").alias("first_commit"), F.col("last.commit_id").alias("latest_commit"), "touch_count",
            F.col("last.author_name").alias("last_author"), F.col("last.subject").alias("last_subject"), F.col("last.author_date_utc").alias("last_date"),
        )


def stream_facts(touches: DataFrame, store: FactStore, checkpoint: str, once: bool = True):
    """Start the stream that folds ``touches`` into the store."""
    def each(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, f"{checkpoint}#{batch_id}")

    writer = touches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
