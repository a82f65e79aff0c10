"""Adapters from the shared test tables to the model tables (projections and equi-joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph_spark.sources.scan import explode_lines



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; it may be one file or a folder of parts. A plain path must be a folder there, a pattern may name either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def spread(df: DataFrame) -> DataFrame:
    """Scans of fewer splits than half the cores are dealt out; large inputs stay as they are.

    A small table can be one Parquet row group and so one task, while the text
    work behind it is worth all cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return d.select(
        F.lit("docs").alias("repo_name"),
        F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(document_files(spark, sf_dir))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit("chat").alias("repo_name"),
        F.format_string("/chat/%d/%d", "conv_id", "turn").alias("file_path"),
        F.col("role").alias("language"),
        F.col("text").alias("content"),
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.lit("parts").alias("repo_name"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("file_path"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("line_start"),
        (F.col("p_size") + 9).alias("line_end"),
        F.col("p_brand").alias("signature"),
    )


def part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between parts: the referring part is the order's, taken modulo the part count."""
    part = table(spark, sf_dir, "part")
    size = part.agg(F.count(F.lit(1)).alias("n"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    n = size.first()["n"]
    at = part.select(
        F.col("p_partkey").alias("_k"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("in_file"),
        "p_size",
    )
    # distinct as numbers and by the key of the join too, which the order tells: rows are not dealt out again for it
    line = (F.col("p_size") + F.col("l_linenumber")).cast("int").alias("line")
    met = li.withColumn("_k", F.col("l_orderkey") % F.lit(n)).join(at, "_k").select("_k", "l_partkey", "in_file", line, "l_orderkey").distinct()
    return met.select(
        F.col("l_partkey").cast("string").alias("symbol_id"),
        "in_file",
        F.lit("parts").alias("repo_name"),
        "line",
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("context"),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per (brand, type) of the parts."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("symbol_count")).select(
        F.lit("parts").alias("repo_name"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("file_path"),
        F.col("p_type").alias("language"),
        F.col("symbol_count").cast("int").alias("symbol_count"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages"))
    return p.select(
        F.lit("web").alias("repo_name"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("file_path"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"),
        F.col("html").alias("content"),
        "page_id",
    )


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links of pages as import edges between paths."""
    return (
        page_files(spark, sf_dir)
        .select("repo_name", F.col("file_path").alias("from_file"), F.explode(F.regexp_extract_all("content", F.lit('href="(/[^"]*)"'), 1)).alias("to_file"))
        .distinct()
    )


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit("orders").alias("repo_name"),
        F.col("o_orderkey").cast("string").alias("commit_id"),
        F.col("o_custkey").cast("string").alias("author_name"),
        F.col("o_orderdate").alias("author_date_utc"),
        F.col("o_orderpriority").alias("subject"),
    )


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit parents: order k follows orders k div 2 and k div 3."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).filter("k > 0")
    parents = F.array_distinct(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3)))
    return o.select("k", F.explode(parents).alias("p")).select(
        F.lit("orders").alias("repo_name"), F.col("p").cast("string").alias("parent_commit_id"), F.col("k").cast("string").alias("child_commit_id")
    )


def part_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges between part files: the referring file imports the symbol's file."""
    owner = part_symbols(spark, sf_dir).select(F.col("id").alias("symbol_id"), F.col("file_path").alias("to_file"))
    pairs = part_refs(spark, sf_dir).join(owner, "symbol_id").select("repo_name", F.col("in_file").alias("from_file"), "to_file")
    return pairs.filter("from_file <> to_file").distinct()


def trade_graph(spark: SparkSession, sf_dir: str):
    """(nodes, edges): regions contain nations contain customers, who reference orders, which import parts."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    node = lambda df, kind, k, label: df.select(key(kind, k).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("label"))
    nodes = node(t("region"), "region", "r_regionkey", "r_name")
    for name, kind, k, label in (
        ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"),
        ("orders", "order", "o_orderkey", "o_orderpriority"), ("part", "part", "p_partkey", "p_name"),
    ):
        nodes = nodes.unionByName(node(t(name), kind, k, label))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    edges = edge(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "contains")
    edges = edges.unionByName(edge(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "contains"))
    edges = edges.unionByName(edge(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), "references"))
    edges = edges.unionByName(edge(t("lineitem"), key("order", "l_orderkey"), key("part", "l_partkey"), "imports"))
    return nodes, edges.distinct()


def order_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("orders").alias("repo_name"),
        F.col("l_orderkey").cast("string").alias("commit_id"),
        F.col("l_partkey").cast("string").alias("path"),
        F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_partkey") / 2).cast("string")).alias("prev_path"),
        F.when(F.col("l_returnflag") == "N", F.lit("M")).otherwise(F.col("l_returnflag")).alias("status"),
        F.col("l_quantity").cast("int").alias("inserted"),
        F.col("l_linenumber").cast("int").alias("deleted"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("ts"),
        F.col("event_type").alias("endpoint"),
        (F.col("user_id") % 4).cast("string").alias("mode"),
        F.lit("events").alias("project"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("result_count"),
        (F.col("event_type") == "error").alias("is_empty"),
        (F.col("event_type") == "signup").alias("used_fallback"),
    )


def bench_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from events: a run per day, token counts from value and props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.floor(F.col("value")).cast("int")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("scenario"),
        F.concat(F.lit("src/"), (F.col("user_id") % 7).cast("string"), F.when(F.col("user_id") % 2 == 0, F.lit(".cs")).otherwise(F.lit(".rs"))).alias("fixture"),
        F.when(F.col("event_id") % 2 == 0, F.lit("warm")).otherwise(F.lit("cold")).alias("temperature"),
        (F.col("event_type") != "view").alias("is_workflow"),
        k.alias("baseline_count"),
        (k + F.col("event_id") % 3 - 1).cast("int").alias("our_count"),
        F.when(F.col("event_id") % 5 == 0, F.lit(90.0)).otherwise(F.lit(100.0)).alias("coverage_percent"),
        (F.col("event_id") % 3 - 1).cast("int").alias("extra"),
        v.cast("long").alias("baseline_ms"),
        k.cast("long").alias("our_ms"),
        (v + 40).alias("baseline_tokens"),
        k.alias("our_tokens"),
        F.when(F.col("event_id") % 4 == 0, (k + 5).cast("int")).alias("hybrid_tokens"),
        F.lit(2).alias("baseline_calls"),
        F.lit(1).alias("our_calls"),
        F.when(F.col("event_id") % 4 == 0, F.lit(2)).alias("hybrid_calls"),
        F.when(F.col("event_type") != "view", F.col("event_id") % 11 != 0).alias("success"),
        F.when(F.col("event_type") == "click", F.lit("history_latest_touch|hybrid:fallback"))
        .when(F.col("event_type") == "purchase", F.lit("resolve symbol"))
        .otherwise(F.lit("")).alias("notes"),
        F.lit(None).cast("string").alias("trace_json"),
        "event_id",
    )


def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols from text: the first ASCII word of a line, kind by its length, up to the next one."""
    from codegraph_spark.operators.extract import extract_symbols

    return extract_symbols(document_lines(spark, sf_dir), TEXT_RULES, repo_separator="::", ends="next")


# One rule per kind; the kind of a text symbol is the length class of its word.
TEXT_RULES = [
    (lang, kind, pattern, 1)
    for lang in ("en", "de", "fr", "es")
    for kind, pattern in (
        ("Class", r"^([A-Z][A-Za-z0-9_]{6,})"),
        ("Method", r"^([A-Z][A-Za-z0-9_]{3,5})(?:[^A-Za-z0-9_]|$)"),
        ("Field", r"^([A-Z][A-Za-z0-9_]{1,2})(?:[^A-Za-z0-9_]|$)"),
    )
]


def benchmark_queries(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    """One query per benchmark item: the first words of its text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.array_join(F.slice(F.split("text", " "), 1, words), " ").alias("q"),
    )


