"""Results that stay whole where a bound or a file layout once cut them."""

from conftest import rows
from pyspark.sql import functions as F

from codegraph_spark.operators import graph
from codegraph_spark.plans.traverse import induced_edges, joined_edges


def test_pack_of_a_file_with_many_namesakes(spark):
    files = spark.createDataFrame([("r", "/f.txt")], "repo_name string, file_path string")
    symbols = spark.range(1, 301).select(
        F.concat(F.lit("s"), "id").alias("id"), F.lit("r").alias("repo_name"), F.lit("/f.txt").alias("file_path"),
        F.when(F.col("id") > 298, F.concat(F.lit("Zed"), "id")).otherwise(F.lit("Again")).alias("name"), F.col("id").cast("int").alias("line_start"),
    )
    edges = symbols.select(F.lit("file:/f.txt").alias("src"), F.concat(F.lit("symbol:"), "id").alias("dst"), F.lit("contains").alias("type"))
    seeds = spark.createDataFrame([(1, "file:/f.txt")], "query_id long, node string")
    got, kept = graph.graph_query(graph.build_nodes(files, symbols), edges, seeds, 1, None)
    assert got.count() == 301 and kept.count() == 300
    lines = spark.createDataFrame([("r", "/f.txt", 1, "x")], "repo_name string, file_path string, line int, text string")
    labels = graph.graph_context_pack(got, lines).filter("part = 'symbol'")
    assert rows(labels, "rank", "value") == [(1, "Again"), (2, "Zed299"), (3, "Zed300")]


def test_joined_edges_are_the_induced_ones(spark):
    edges = spark.range(400).select((F.col("id") * 7 % 31).cast("string").alias("src"), (F.col("id") * 11 % 37).cast("string").alias("dst"), F.lit("t").alias("type")).distinct()
    nodes = spark.range(90).select((F.col("id") % 4).alias("query_id"), (F.col("id") * 5 % 41).cast("string").alias("node"), (F.col("id") % 3).cast("int").alias("distance")).dropDuplicates(["query_id", "node"]).cache()
    for direction in ("in", "out", "both"):
        assert rows(joined_edges(nodes, edges, 2, direction)) == rows(induced_edges(nodes, edges, 2, direction))


def test_streams_read_tables_of_one_file_and_of_parts(spark, tmp_path):
    from codegraph_spark.sources import corpus
    from codegraph_spark.workloads import QUERIES

    turns = spark.range(40).select((F.col("id") % 8).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turns.repartition(3).write.parquet(str(tmp_path / "parts" / "conversations.parquet"))
    whole = tmp_path / "whole"
    whole.mkdir()
    turns.toPandas().to_parquet(whole / "conversations.parquet")
    for d in ("parts", "whole"):
        assert corpus.table_stream(spark, str(tmp_path / d), "conversations").isStreaming
        got = rows(QUERIES["stream_session_plans"](spark, str(tmp_path / d)))
        assert len(got) == 8 and got == rows(QUERIES["session_plan_state"](spark, str(tmp_path / d)))


def test_the_store_keeps_no_pairs_of_a_name(spark, tmp_path):
    from codegraph_spark.streaming import index_stream
    from codegraph_spark.operators import registry
    from codegraph_spark.workloads.indexing import TEXT_LANGUAGE

    texts = {f"/t/{i}.txt": "Common word\nCommon(x) and Common(y)\nRarely Common(z)\n" for i in range(12)} | {"/t/own.txt": "Single(a)\nlonely\n", "/T/OWN2.txt": "Single(b)\n"}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo_name string, file_path string, content string")
    store = index_stream.IndexStore(spark, str(tmp_path / "store"), registry.Registry().register(TEXT_LANGUAGE))
    store.build(files)

    def check(now):
        fresh = registry.index_corpus(now, store.registry)
        key = ("symbol_id", "in_file", "line", "context")
        assert rows(store.read("refs"), *key) == rows(fresh.refs, *key)
        told = fresh.refs.groupBy("repo_name", "in_file").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("line").alias("n_lines"), F.count_distinct("symbol_id").alias("symbols"))
        assert rows(store.links().per_file()) == rows(told)

    check(files)
    assert store.read("refs").count() > 300 and spark.read.parquet(str(tmp_path / "store" / "refs")).count() == 0
    changes = spark.createDataFrame([("r", "/t/3.txt", None, True, 1), ("r", "/t/4.txt", "new\nCommon(q)\nSingle(r)\n", False, 1)], "repo_name string, file_path string, content string, deleted boolean, version int")
    store.apply(changes)
    check(files.filter("file_path not in ('/t/3.txt', '/t/4.txt')").unionByName(changes.filter("not deleted").select(files.columns)))
    assert spark.read.parquet(str(tmp_path / "store" / "named")).filter("batch = 1").count() == 1  # users of a name are not written again


def test_substrings_are_met_where_the_texts_stand(spark, monkeypatch):
    from codegraph_spark.plans import substring

    t = spark.range(600).select("id", F.concat(F.repeat(F.lit("é🎉 Zeile "), (F.col("id") % 40).cast("int")), F.lit("END"), F.col("id").cast("string")).alias("t"))
    t = t.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "z" * 40_000 + "needle")], t.schema))
    n = spark.createDataFrame([(1, "🎉 z"), (2, "end59"), (3, "NEEDLE"), (4, "é"), (5, "d1"), (6, ""), (7, None), (8, "absent"), (9, "é🎉 zeile é🎉")], "q int, n string")
    want = rows(t.join(n, F.lower("t").contains(F.lower("n")) & (F.length("n") > 0)), "id", "q")
    monkeypatch.setattr(substring, "SLICE", 1000)
    for held in (substring.MOST_HELD, 0):
        monkeypatch.setattr(substring, "MOST_HELD", held)
        for sizes in (substring.LINE_GRAMS, substring.NAME_GRAMS):
            for repeated in (True, False):
                assert rows(substring.contains_join(t, "t", n, "n", ["id"], sizes, repeated=repeated), "id", "q") == want
    monkeypatch.undo()
    plan = substring.contains_join(t, "t", n, "n", ["id"], substring.LINE_GRAMS, repeated=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_callees_are_found_once_per_body(spark, monkeypatch):
    """300 symbols share one body and one name: calls meet references inside the body, not symbols times namesakes."""
    met = []
    real = graph.product_join
    monkeypatch.setattr(graph, "product_join", lambda left, *a: met.append(left.count()) or real(left, *a))
    n = 300
    symbols = spark.range(n).select(
        F.format_string("s%d", "id").alias("id"), F.lit("r").alias("repo_name"), F.lit("/F").alias("file_path"), F.lit("run").alias("name"), F.lit("Method").alias("kind"),
        F.lit(2).alias("line_start"), F.when(F.col("id") > 0, 5).alias("line_end"),
    )
    lines = spark.createDataFrame([("r", "/F", 3, "run(); run()"), ("r", "/F", 9, "stop()")], "repo_name string, file_path string, line int, text string")
    refs = spark.createDataFrame([("s1", "/f", 3), ("s1", "/f", 4), ("s2", "/F", 8), ("s3", "/F", 1), ("s4", "/g", 3)], "symbol_id string, in_file string, line int")
    seeds = symbols.select(F.substr("id", F.lit(2)).cast("long").alias("query_id"), F.col("id").alias("symbol_id"))
    got = {(r.symbol_id, r.target) for r in graph.callees_of(symbols, lines, refs.withColumn("repo_name", F.lit("r")), seeds.union(seeds)).collect()}
    # s0 has no end: its body runs to the end of the file
    assert got == {(f"s{i}", "s1") for i in range(n) if i != 1} | {("s0", "s2")}
    assert met == [3]


def test_seeds_and_edges_of_hubs(spark):
    """Nodes are not broadcast by the size of their files; edges found from near nodes are those of the joins row by row."""
    nodes = spark.range(9).select(F.concat(F.lit("n"), "id").alias("id"))
    seeds = spark.range(3).select(F.col("id").alias("query_id"), F.concat(F.lit("n"), "id").alias("node"))
    known = graph.known_seeds(seeds, nodes)
    assert known.count() == 3 and "Broadcast" not in known._jdf.queryExecution().executedPlan().toString()
    pairs = [("n0", "n1"), ("n1", "n0"), ("n1", "n1"), ("n2", "n0"), ("n2", "n3"), ("n3", "n0"), ("n3", "n4")]
    edges = spark.createDataFrame([(a, b, "t") for a, b in pairs], "src string, dst string, type string")
    held = spark.createDataFrame([(q, f"n{i}", d) for q in (1, 2) for i, d in ((0, 0), (1, 1), (2, 1 + q % 2), (3, 2))], "query_id long, node string, distance int")
    for direction in ("out", "in", "both"):
        for depth in (1, 2):
            got = rows(induced_edges(held, edges, depth, direction))
            assert got == rows(joined_edges(held, edges, depth, direction).distinct()) and len(set(got)) == len(got)
