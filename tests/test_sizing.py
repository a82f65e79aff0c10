"""Steps are dealt out by their rows, not by the session's number of partitions."""

import pytest
from pyspark.sql import functions as F

from codegraph_spark.operators import history, linking
from codegraph_spark.plans import sizing
from codegraph_spark.streaming import history_stream


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """A session of two shuffle partitions, and tasks of 200 rows."""
    monkeypatch.setattr(sizing, "ROWS", 200)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", keep)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_neighbors_in_small_tasks(spark, small_tasks):
    n = 8_000
    edges = spark.range(1, n).select(F.format_string("c%d", F.col("id") - 1).alias("parent_commit_id"), F.format_string("c%d", "id").alias("child_commit_id"))
    req = spark.range(n).select(F.col("id").alias("query_id"), F.format_string("c%d", "id").alias("commit_id"))
    # rows and requests that come twice count once
    got = history.commit_neighbors(edges.union(edges.limit(5)), req.union(req.limit(5)))
    assert largest(got) <= 400
    want = {(i, f"c{i}", "parent", f"c{i - 1}") for i in range(1, n)} | {(i, f"c{i}", "child", f"c{i + 1}") for i in range(n - 1)}
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


@pytest.mark.parametrize("paths", [10, 700])
def test_touches_are_dealt_out_before_they_are_counted(spark, small_tasks, capsys, paths):
    """Few asked paths, and more than a task takes; rows that come twice count once."""
    files = spark.range(6_000).select(F.lit("r").alias("repo_name"), F.format_string("c%d", F.col("id") % 5_000).alias("commit_id"), F.format_string("p%d", F.col("id") % 500).alias("path"))
    req = spark.range(paths).select(F.col("id").alias("query_id"), F.format_string("p%d", "id").alias("path"))
    got = history.touch_count(files, req)
    assert {tuple(r) for r in got.collect()} == {(i, f"p{i}", 10 if i < 500 else 0) for i in range(paths)}
    got.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_facts_of_a_batch_are_dealt_out(spark, small_tasks, capsys):
    at = F.timestamp_seconds(F.col("id") % 3_000)
    touches = spark.range(6_000).select(
        F.lit("r").alias("repo_name"), F.format_string("c%04d", F.col("id") % 3_000).alias("commit_id"), F.format_string("p%d", F.col("id") % 300).alias("path"),
        F.lit("a").alias("author_name"), at.alias("author_date_utc"), F.lit("s").alias("subject"),
    )
    got = history_stream.partial_facts(touches)
    got.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    # every row comes twice
    want = {(f"p{i}", 10, f"c{i:04}", f"c{2_700 + i:04}") for i in range(300)}
    assert {(r["path"], r["touch_count"], r["first"]["commit_id"], r["last"]["commit_id"]) for r in got.collect()} == want
    twice = history_stream.merged(got.union(got))
    assert twice.rdd.getNumPartitions() >= 3
    assert {(r["path"], r["touch_count"], r["first"]["commit_id"], r["last"]["commit_id"]) for r in twice.collect()} == {(p, 2 * n, a, z) for p, n, a, z in want}


def test_symbols_of_many_files_are_dealt_out(spark, small_tasks, capsys):
    """The blocks of all symbols of a scan were sorted in one task."""
    symbols = spark.range(2_000).coalesce(1).select(
        F.format_string("s%04d", "id").alias("id"), F.lit("r").alias("repo_name"), F.format_string("/f%d", F.col("id") % 5).alias("file_path"),
        (F.col("id") % 40 + 1).cast("int").alias("line_start"), (F.col("id") % 40 + 10).cast("int").alias("line_end"),
    )
    points = spark.range(300).select(F.lit("r").alias("repo_name"), F.format_string("/f%d", F.col("id") % 5).alias("file_path"), F.floor(F.col("id") / 5).cast("int").alias("line"))
    got = linking.enclosing_symbol(points, symbols)
    want = {}
    for i in reversed(range(2_000)):
        for line in range(i % 40 + 1, 60):
            inside = line <= i % 40 + 10
            known = want.get((i % 5, line))
            if known is None or (inside, i % 40) >= (known[0], known[1]):
                want[i % 5, line] = (inside, i % 40, f"s{i:04}")
    assert {(int(r.file_path[2:]), r.line): r.symbol_id for r in got.collect()} == {k: v[2] for k, v in want.items()}
    got.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") >= 2
