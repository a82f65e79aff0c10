from conftest import rows
from pyspark.sql import functions as F
from samples import CALLS_CS, COUNTER_CS, SHAPES_CS

from codegraph_spark.operators import edits, history, registry, runs
from codegraph_spark.sources import scan
from codegraph_spark.streaming import index_stream, sessions, telemetry

OP = "seq int, path string, type string, start_line int, end_line int, content string, find string, occurrence int"


def test_line_edits(spark):
    files = spark.createDataFrame([("/a", "one\ntwo\nthree\n"), ("/b", "x y x y\n"), ("/e", "")], "file_path string, content string")
    ops = spark.createDataFrame([
        (1, "/a", "replace_range", 2, 2, "TWO\r\nTWO2", None, None), (2, "/a", "insert_after", 0, None, "top", None, None), (3, "/a", "delete_range", 9, 9, None, None, None),
        (4, "/a", "insert_before", 0, None, "z", None, None), (5, "/a", " Delete_Range ", 4, 9, None, None, None), (6, "/b", "replace_snippet", None, None, "Q", "x", 2),
        (7, "/b", "replace_snippet", None, None, "Q", "nope", 0), (8, "/b", "replace_snippet", None, None, "Q", "x", 5), (9, "/b", "wipe", None, None, None, None, None),
        (10, "/none", "delete_range", 1, 1, None, None, None), (11, "", None, None, None, None, None, None), (12, "/a", "replace_range", 9, 9, "x", None, None),
        (13, "/e", "insert_before", 1, None, "first", None, None), (14, "/b", "replace_snippet", None, None, "Q", "", 1), (15, "/a", "replace_range", 3, 1, "x", None, None),
    ], OP)
    touched, results = edits.edit_lines(files, ops)
    text = {r.file_path: r.content for r in touched.collect()}
    assert text["/a"] == "top\none\nTWO\n" and text["/b"] == "x y Q y\n" and text["/e"] == "first\n"
    got = {r.seq: (r.ok, r.status, r.changed, r.from_line, r.to_line) for r in results.collect()}
    assert got[1] == (True, "applied", 2, 2, 3) and got[2] == (True, "applied", 1, 1, 1) and got[3] == (False, "startLine is outside file", 0, 0, 0)
    assert got[4][1] == "startLine is required" and got[5] == (True, "applied", 2, 4, 5) and got[6] == (True, "applied", 1, 0, 0)
    assert got[7][1] == "snippet not found" and got[8][1] == "snippet occurrence not found" and got[9][1] == "unsupported op type 'wipe'"
    assert got[10][1] == "file not found or outside project root" and got[11][1] == "invalid op: path is required" and got[12][1] == "line range is outside file"
    assert got[14][1] == "find is required" and got[15][1] == "startLine/endLine are required and must be valid" and len(got) == 15
    same, dry = edits.edit_lines(files, ops, dry_run=True)
    assert {r.file_path: r.content for r in same.collect()}["/a"] == "one\ntwo\nthree\n"
    assert {r.seq: r.changed for r in dry.collect()}[5] == 0


def test_patches(spark):
    files = spark.createDataFrame([("/a", "Foo foo FOO $1")], "file_path string, content string")
    cols = "seq int, path string, mode string, find string, replace string, replace_all boolean, ignore_case boolean"
    ops = spark.createDataFrame([
        (1, "/a", "literal", "foo", "a$b", False, False), (2, "/a", "literal", "FOO", "x\\", True, True), (3, "/a", "regex", "x.", "y", False, False),
        (4, "/a", "regex", "[a-z]", "-", True, False), (5, "/zz", "literal", "q", "", True, False), (6, "/a", "literal", "", "", True, False),
    ], cols)
    touched, results = edits.patch_files(files, ops, dry_run=False)
    assert touched.first().content == "- -$- -\\ $1".replace("- -$- -\\", "- -$- -\\")
    got = {r.seq: (r.ok, r.status, r.changes) for r in results.collect()}
    assert got[1] == (True, "applied", 1) and got[2] == (True, "applied", 2) and got[3] == (True, "applied", 1)
    assert got[5] == (False, "file not found or outside project root", 0) and got[6] == (False, "invalid op: path/find required", 0)
    _, dry = edits.patch_files(files, ops, dry_run=True)
    assert {r.seq: (r.status, r.changes) for r in dry.filter("ok").collect()}[2] == ("planned", 3)


def test_reads_and_tree(spark):
    files = spark.createDataFrame([("r", "/p/a/x.cs", "cs", "\n".join(f"l{i}" for i in range(1, 2001))), ("r", "/p/bin/y.cs", "cs", "one\n")], "repo_name string, file_path string, language string, content string")
    lines = scan.explode_lines(files)
    req = spark.createDataFrame([(1, "/p/a/x.cs", 0, 0), (2, "/p/a/x.cs", 5, 5000), (3, "/p/bin/y.cs", 9, 0)], "query_id long, path string, from_line int, to_line int")
    n = {r.query_id: r["count"] for r in edits.read_range(lines, req).groupBy("query_id").count().collect()}
    assert n == {1: 51, 2: 1996}
    spans = spark.createDataFrame([(1, 1, "/p/a/x.cs", 1999, 0), (1, 2, "/p/a/x.cs", 3000, 0), (1, 3, "/p/a/x.cs", 1, 900)], "query_id long, pos int, path string, from_line int, to_line int")
    assert rows(edits.read_spans(lines, spans, 10), "pos", "span_from", "span_to") == [(1, 1999, 2000), (3, 1, 10)]
    assert rows(edits.dir_tree(files, "/p", 1, excludes=("bin",))) == [("d", "/p/a", 0), ("f", "/p/a/x.cs", 1)]
    assert edits.dir_tree(files, "/p", 1, 2).count() == 2
    w = spark.createDataFrame([("/p/a/x.cs", "r", "cs", "new", False, True), ("/p/n.cs", "r", "cs", "é", False, True)], "path string, repo_name string, language string, content string, overwrite boolean, trailing_newline boolean")
    after, out = edits.upsert_files(files, w)
    assert after.count() == 3 and rows(out, "file_path", "ok", "chars", "bytes") == [("/p/a/x.cs", False, None, None), ("/p/n.cs", True, 2, 3)]


def test_replace_plan_keeps_the_line_that_reaches_the_cap(spark):
    lines = spark.createDataFrame([("r", "/a", "x", i, "aa aa") for i in range(1, 10)], "repo_name string, file_path string, language string, line int, text string")
    plan = edits.replace_plan(lines, [(1, "literal", "aa", False)], max_matches=5)
    assert plan.count() == 3 and plan.agg(F.max("running")).first()[0] == 6


def test_history_walks(spark):
    commits = spark.createDataFrame([("r", f"c{i}", "me", f"2024-01-0{i}", f"s{i}") for i in range(1, 7)], "repo_name string, commit_id string, author_name string, d string, subject string").withColumn("author_date_utc", F.to_timestamp("d")).drop("d")
    edges = spark.createDataFrame([("c1", "c2"), ("c2", "c3"), ("c2", "c4"), ("c3", "c5"), ("c4", "c6"), ("c5", "c6")], "parent_commit_id string, child_commit_id string")
    pairs = spark.createDataFrame([(1, "c5", "c4"), (2, "c1", "c6")], "query_id long, left_commit string, right_commit string")
    assert rows(history.merge_base(edges, pairs), "query_id", "base_commit") == [(1, "c2"), (2, "c1")]
    assert rows(history.divergence(edges, pairs).filter("query_id = 1")) == [(1, "left", "c3"), (1, "left", "c5"), (1, "right", "c4")]
    cf = spark.createDataFrame([
        ("r", "c1", "src/old.cs", None, "A", 5, 0), ("r", "c2", "src/mid.cs", "src/old.cs", "R", 1, 1), ("r", "c5", "src/new.cs", "src/mid.cs", "R", 2, 2),
        ("r", "c6", "src/new.cs", None, "M", 3, 1), ("r", "c3", "lib/z.cs", None, "A", 1, 0),
    ], "repo_name string, commit_id string, path string, prev_path string, status string, inserted int, deleted int")
    req = spark.createDataFrame([(1, "src/new.cs")], "query_id long, path string")
    assert [r.path for r in history.rename_chain(commits, cf, req).orderBy("hop").collect()] == ["src/new.cs", "src/mid.cs", "src/old.cs"]
    scope = spark.createDataFrame([(1, "src/", 2), (2, "lib/z.cs", 0)], "query_id long, path string, limit int")
    assert rows(history.history(commits, cf, scope), "query_id", "commit_id", "inserted") == [(1, "c5", 2), (1, "c6", 3), (2, "c3", 1)]
    between = spark.createDataFrame([(1, "c2", "c6", "src"), (2, "c2", "c6", "")], "query_id long, from_commit string, to_commit string, path string")
    assert rows(history.commits_between(commits, cf, edges, between), "query_id", "commit_id") == [(1, "c5"), (1, "c6"), (2, "c3"), (2, "c4"), (2, "c5"), (2, "c6")]


RESULT = "run_id string, scenario string, fixture string, is_workflow boolean, temperature string, coverage_percent double, success boolean, baseline_tokens int, our_tokens int, hybrid_tokens int"


def test_run_analytics(spark, tmp_path):
    data = [
        ("r1", "Flaky", "a.cs", True, "warm", 100.0, True, 100, 50, 60), ("r2", "flaky", "a.cs", True, "warm", 100.0, False, 100, 50, 60),
        ("r1", "steady", "b.rs", True, "warm", 100.0, True, 100, 50, 60), ("r2", "steady", "b.rs", True, "warm", 100.0, True, 100, 51, 60),
        ("r1", "turn", "c", True, "warm", 100.0, True, 100, 50, None), ("r2", "turn", "c", True, "warm", 100.0, None, 100, 150, 160),
    ]
    d = spark.createDataFrame(data, RESULT)
    for c in ("baseline_count", "our_count", "extra", "our_ms", "baseline_ms", "baseline_calls", "our_calls", "hybrid_calls"):
        d = d.withColumn(c, F.lit(1))
    d = d.withColumn("notes", F.lit('say "hi", you')).withColumn("trace_json", F.lit('{"modes":[{"tokens":3},{"mode":"hybrid","usedFallback":true}]}'))
    assert rows(runs.flaky_scenarios(d), "scenario") == [("Flaky",), ("turn",)]
    avg = {r.scenario: r for r in runs.average_repeats(d).collect()}
    assert avg["steady"].our_tokens == 50 and avg["turn"].hybrid_tokens == 80 and avg["turn"].success is False
    assert rows(runs.explode_trace(d.limit(1)), "step_no", "mode", "tokens", "notes") == [(1, "unknown", 3, ""), (2, "hybrid", None, "fallback")]
    assert {r.outcome for r in runs.scenario_flags(d).collect()} == {"PASS", "FAIL", "REG"}
    scan.export_results(d, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert text[0].split(",") == list(scan.EXPORT_COLUMNS) and text[1].endswith('"say ""hi"", you"') and ",100.00," in text[1]
    meta = spark.createDataFrame([("r1", "2024"), ("r2", "2025")], "run_id string, created_at string")
    for _ in range(2):
        scan.append_run(d, meta, str(tmp_path / "runs"))
    assert scan.read_runs(spark, str(tmp_path / "runs"), "bench_results").count() == 6 and scan.read_runs(spark, str(tmp_path / "runs"), "bench_modes").count() == 18
    base = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b")], "fixture string, token string")
    ours = spark.createDataFrame([("f", "a"), ("f", "c"), ("g", "x")], "fixture string, token string")
    assert rows(runs.coverage(base, ours)) == [("f", 2, 2, 1, 50.0, 0), ("g", 0, 1, 0, 100.0, 1)]
    h = spark.createDataFrame([(1, "history_latest_touch", ["abcdef1", "b"]), (2, "history_touch_count", ["a", "b"]), (3, "history_first_touch", ["xyz"])], "task_id int, kind string, lines array<string>")
    c = spark.createDataFrame([(1, "ABCDEF1"), (2, "3"), (3, "xyz")], "task_id int, answer string")
    assert rows(runs.evaluate_history(h, c), "task_id", "success", "hybrid_answer", "hybrid_calls") == [(1, True, "ABCDEF1", 1), (2, False, "2", 2), (3, False, "xyz", 2)]
    assert runs.telemetry_totals(spark.createDataFrame([], "is_empty boolean, used_fallback boolean")).first().empty_rate == 0.0


def test_index_store_equals_a_full_build(spark, tmp_path):
    reg = registry.Registry().register(registry.default_registry().languages["CSharp"])
    files = spark.createDataFrame([("r", "/r/Counter.cs", COUNTER_CS), ("r", "/r/Shapes.cs", SHAPES_CS), ("r", "/r/Calls.cs", CALLS_CS)], "repo_name string, file_path string, content string")
    store = index_stream.IndexStore(spark, str(tmp_path / "store"), reg, compact_at=2)
    store.build(files)
    moved = "// a new first line\n" + COUNTER_CS
    events = spark.createDataFrame(
        [("r", "changed", "/r/Counter.cs", None, "stale", 1), ("r", "changed", "/r/Counter.cs", None, moved, 2), ("r", "renamed", "/r/Forms.cs", "/r/Shapes.cs", SHAPES_CS, 2)],
        "repo_name string, event string, file_path string, old_path string, content string, version long",
    )
    before = rows(store.read("symbols"), "id")
    real = store.tables._commit
    store.tables._commit = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    try:
        store.apply(index_stream.expand_events(events), "batch 1")
    except KeyboardInterrupt:  # a batch that is killed before its commit leaves everything as it was
        assert rows(store.read("symbols"), "id") == before
    store.tables._commit = real
    for _ in range(2):
        store.apply(index_stream.expand_events(events), "batch 1")
    assert len(store.tables.commits()) == 2  # a replayed batch changes nothing
    written = spark.read.parquet(str(tmp_path / "store" / "sources")).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in written} == {0: 3, 1: 2}  # a batch writes its own files only
    final = spark.createDataFrame([("r", "/r/Counter.cs", moved), ("r", "/r/Forms.cs", SHAPES_CS), ("r", "/r/Calls.cs", CALLS_CS)], "repo_name string, file_path string, content string")
    fresh = registry.index_corpus(final, reg)
    assert rows(store.read("symbols"), "id", "line_end") == rows(fresh.symbols, "id", "line_end")
    assert rows(store.read("refs"), "symbol_id", "in_file", "line") == rows(fresh.refs, "symbol_id", "in_file", "line")
    assert rows(store.read("sources"), "file_path") == rows(final, "file_path")
    assert rows(store.read("usages"), "file_path", "token", "line") == rows(fresh.usages, "file_path", "token", "line")
    store.apply(index_stream.expand_events(events))  # again without a token: the third batch, after which they are merged
    assert store.tables.live() == [3] and rows(store.read("refs"), "symbol_id", "in_file", "line") == rows(fresh.refs, "symbol_id", "in_file", "line")
    store.tables.vacuum()
    assert rows(store.read("symbols"), "id", "line_end") == rows(fresh.symbols, "id", "line_end")


def test_two_repos_with_the_same_path(spark, tmp_path):
    from codegraph_spark.sources import scan

    files = spark.createDataFrame([("a", "/src/x.rs", "rust", "a1\na2\na3\n"), ("b", "/src/x.rs", "rust", "b1\nb2\n")], "repo_name string, file_path string, language string, content string")
    lines = scan.explode_lines(files)
    req = spark.createDataFrame([(1, "/src/x.rs", 1, 2, "A"), (2, "/src/x.rs", 2, 9, None)], "query_id long, path string, from_line int, to_line int, repo string")
    want = [(1, "a", 1, "a1"), (1, "a", 2, "a2"), (2, "a", 2, "a2"), (2, "a", 3, "a3"), (2, "b", 2, "b2")]
    for source in (files, lines):
        assert rows(edits.read_range(source, req), "query_id", "repo_name", "line", "text") == want
        spans = req.withColumn("pos", F.lit(0))
        assert rows(edits.read_spans(source, spans), "query_id", "repo_name", "text") == [(1, "a", "a1\na2"), (2, "a", "a2\na3"), (2, "b", "b2")]
    assert rows(edits.read_many(files, req.withColumn("pos", F.lit(1))), "query_id", "repo_name", "total_lines") == [(1, "a", 3), (2, "a", 3), (2, "b", 2)]
    ops = spark.createDataFrame([(1, "/src/x.rs", "b", "1", "one"), (2, "/src/x.rs", None, "2", "two"), (3, "/src/x.rs", "c", "1", "x")], "seq int, path string, repo string, find string, replace string")
    ops = ops.selectExpr("*", "'literal' AS mode", "false AS replace_all", "false AS ignore_case")
    touched, results = edits.patch_files(files, ops, dry_run=False)
    assert rows(results, "seq", "repo_name", "ok", "changes") == [(1, "b", True, 1), (2, "a", True, 1), (2, "b", True, 1), (3, None, False, 0)]
    line_ops = ops.selectExpr("seq", "path", "repo", "'delete_range' AS type", "1 AS start_line", "1 AS end_line", "'' AS content", "'' AS find", "1 AS occurrence").filter("seq = 1")
    after, outcome = edits.edit_lines(files, line_ops)
    assert rows(after, "repo_name", "content") == [("b", "b2\n")] and rows(outcome, "repo_name", "ok") == [("b", True)]
    w = spark.createDataFrame([("/src/x.rs", "a", "rust", "new", True, True)], "path string, repo_name string, language string, content string, overwrite boolean, trailing_newline boolean")
    left, out = edits.upsert_files(files, w)
    assert rows(left, "repo_name", "content") == [("a", "new\n"), ("b", "b1\nb2\n")] and rows(out, "repo_name", "ok") == [("a", True)]
    named = req.select("query_id", F.lit(0).alias("pos"), "path", "repo")
    assert rows(scan.content_manifest(files, named), "query_id", "repo_name", "byte_length") == [(1, "a", 9), (2, "a", 9), (2, "b", 6)]


def test_facts_from_batches_equal_the_full_build(spark, tmp_path):
    from codegraph_spark.streaming import history_stream

    commits = spark.range(60).select(F.lit("r").alias("repo_name"), F.format_string("c%02d", "id").alias("commit_id"), F.concat(F.lit("me"), F.col("id") % 3).alias("author_name"), F.timestamp_seconds(F.col("id") % 17 * 60).alias("author_date_utc"), F.lit("s").alias("subject"))
    files = commits.select("repo_name", "commit_id", F.explode(F.array(F.lit("hot"), F.concat(F.lit("f"), F.hash("commit_id") % 5), F.lit("hot"))).alias("path"))
    touches = files.join(commits, ["repo_name", "commit_id"])
    store = history_stream.FactStore(spark, str(tmp_path / "facts"), compact_at=3)
    for k in range(6):
        part = touches.filter(F.pmod(F.xxhash64("commit_id"), F.lit(6)) == k)
        for _ in range(2):
            store.add(part, f"t{k}")
    assert rows(store.facts()) == rows(history.file_facts(commits, files).select(*store.facts().columns)) and len(store.tables.live()) <= 4


def test_session_plans_agree_with_the_stream(spark, tmp_path):
    data = [("S1", 1, "goal", "g1"), ("s1", 2, "step", "a"), ("s1", 3, "step", "b"), ("s1", 4, "state", "on"), ("s1", 5, "goal", "g2"), ("s2", 1, "step", "z")]
    df = spark.createDataFrame(data, "session_id string, seq long, field string, value string")
    batch = sessions.session_plans(df)
    assert rows(batch) == [("s1", "g2", "on", 2, "b"), ("s2", "", "", 1, "z")]
    asked = spark.createDataFrame([("S2",), ("new",)], "session_id string")
    assert rows(sessions.read_plans(batch, asked)) == [("new", "", "", 0, ""), ("s2", "", "", 1, "z")]
    for part, cond in (("a", "seq <= 2"), ("b", "seq > 2")):
        df.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        q = sessions.stream_session_plans(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").trigger(
            availableNow=True
        ).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, i: got.extend(rows(b))).start()
        q.awaitTermination()
    assert got == [("s1", "g2", "on", 2, "b")]


def test_telemetry_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "q", True, False), ("2024-01-01 00:50:00", "q", False, True), ("2024-01-01 01:00:00", "q", False, False)], "t string, endpoint string, is_empty boolean, used_fallback boolean").withColumn("ts", F.to_timestamp("t"))
    got = rows(telemetry.windowed(e, delay=None), "total_queries", "empty_rate", "fallback_rate")
    assert got == [(1, 0.0, 0.0), (2, 0.5, 0.5)]


def test_requests_keep_their_edits_apart(spark):
    files = spark.createDataFrame([("/a.txt", "one two")], "file_path string, content string")
    ops = spark.createDataFrame(
        [(1, 1, "/a.txt", "one", "x"), (2, 1, "/a.txt", "two", "y"), (2, 400, "/a.txt", "one", "z"), (2, 401, "/a.txt", "  ", "z")],
        "query_id long, seq int, path string, find string, replace string",
    ).selectExpr("*", "'literal' AS mode", "false AS replace_all", "false AS ignore_case")
    touched, results = edits.patch_files(files, ops, dry_run=False)
    assert {(r["query_id"], r["content"]) for r in touched.collect()} == {(1, "x two"), (2, "z y")}
    assert sorted((r["query_id"], r["seq"], r["ok"]) for r in results.collect()) == [(1, 1, True), (2, 1, True), (2, 400, True), (2, 401, False)]


def test_requests_without_repo_meet_all_repos(spark):
    from codegraph_spark.operators import lookup, ranked

    files = spark.createDataFrame([("r1", "/r1/test_a.py"), ("r2", "/r2/spec_b.py"), ("r2", "/r2/c.py")], "repo_name string, file_path string")
    req = spark.createDataFrame([(1, "test", None), (2, "zzz", "r2"), (3, "zzz", None)], "query_id long, q string, repo string")
    got = {}
    for r in ranked.test_map(files, req).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["file_path"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, "/r1/test_a.py", 1), (2, "/r2/spec_b.py", 0)], 2: [(1, "/r2/spec_b.py", 0)], 3: [(1, "/r1/test_a.py", 0), (2, "/r2/spec_b.py", 0)],
    }
    symbols = spark.createDataFrame([("s1", "r1", "/f", "A", "Class", 1, 2, None), ("s2", "r2", "/g", "B", "Class", 1, 2, None)],
                                    "id string, repo_name string, file_path string, name string, kind string, line_start int, line_end int, signature string")
    asked = spark.createDataFrame([(1, None, ["Class"], None), (2, "r2", None, None)], "query_id long, repo string, kinds array<string>, path_prefix string")
    assert sorted((r["query_id"], r["id"]) for r in lookup.kind_and_path_filter(symbols, asked).collect()) == [(1, "s1"), (1, "s2"), (2, "s2")]


def test_tables_share_their_dictionaries(spark):
    nodes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (3, None)], "query_id long, node string")
    edges = spark.createDataFrame([(1, "a", "b", "call"), (1, "c", "a", "use"), (2, "z", "z", "call"), (2, "z", None, "call")], "query_id long, src string, dst string, type string")
    columns = {"src": "id", "dst": "id", "type": "type"}
    dictionary, got = runs.dict_encode_tables({"nodes": (nodes, {"node": "id"}), "edges": (edges, columns)})
    assert rows(got["nodes"], "query_id", "node") == sorted([(1, 1), (1, 0), (2, 0), (3, None)], key=str)
    assert (1, 2, 0, 1) in rows(got["edges"], "query_id", "src", "dst", "type") and dictionary.filter("dict = 'id' and query_id = 1").count() == 3
    assert rows(runs.dict_decode(got["edges"], dictionary, columns), "query_id", "src", "dst", "type") == rows(edges)
    assert rows(runs.dict_decode(got["nodes"], dictionary, {"node": "id"}), "query_id", "node") == rows(nodes)
