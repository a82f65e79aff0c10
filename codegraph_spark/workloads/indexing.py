"""Sources, extraction and linking over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.operators import extract, linking, registry
from codegraph_spark.plans.lineage import cut, scratch_path
from codegraph_spark.sources import corpus, scan
from codegraph_spark.workloads.base import query


@query("scan_files", "SELECT 'docs' AS repo_name, lang, source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents WHERE source <> 'src3' GROUP BY lang, source")
def _(spark, d):
    """The documents as text files, one folder per language and source, found and read again."""
    root = scratch_path(spark, "files")
    corpus.table(spark, d, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(root)
    found = scan.scan_files(spark, root, [".txt"], excludes=("source=src3",), repo_name="docs")
    at = lambda k: F.regexp_extract("file_path", rf"/{k}=([^/]+)/", 1).alias(k)
    return found.groupBy("repo_name", at("lang"), at("source")).agg(F.sum(F.length("content")).alias("chars"))


@query("should_index", "SELECT file_path FROM files WHERE NOT regexp_matches(file_path, '/src1[0-9]*/')")
def _(spark, d):
    return scan.should_index(corpus.document_files(spark, d), [".txt"], [r"/src1[0-9]*/"]).select("file_path")


@query("exclude_paths", """
SELECT file_path FROM files WHERE NOT (contains(lower(file_path), '/src3/') OR contains(lower(file_path), '/de/') OR ends_with(lower(file_path), '/src3') OR ends_with(lower(file_path), '/de'))""")
def _(spark, d):
    files = corpus.document_files(spark, d)
    projects = files.select(F.col("repo_name").alias("name")).distinct().withColumn("exclude_paths", F.array(F.lit("src3"), F.lit("de")))
    return scan.exclude_paths(files, projects).select("file_path")


@query("explode_lines", "SELECT file_path, line, text FROM lines")
def _(spark, d):
    return corpus.document_lines(spark, d).select("file_path", "line", "text")


@query("assign_language", "SELECT file_path, 'Text' AS language FROM files")
def _(spark, d):
    return scan.assign_language(corpus.document_files(spark, d), scan.language_table(spark, {"Text": [".TXT"], "Other": [".md"]})).select("file_path", "language")


@query("content_manifest", """
SELECT doc_id % 10 AS query_id, doc_id AS pos, file_path AS path, octet_length(encode(file_path)) AS path_bytes, octet_length(encode(content)) AS byte_length, sha256(content) AS sha256
FROM files""")
def _(spark, d):
    docs = corpus.table(spark, d, "documents")
    req = docs.select(
        (F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("pos"),
        F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
    )
    return scan.content_manifest(corpus.document_files(spark, d), req.withColumn("repo", F.lit("Docs"))).drop("repo_name")


@query("read_git_log", "SELECT commit_id, author_name, author_date_utc, subject FROM commits")
def _(spark, d):
    c = corpus.order_commits(spark, d)
    iso = F.date_format("author_date_utc", "yyyy-MM-dd HH:mm:ss +0000")
    text = c.select(F.concat_ws("\u001f", "commit_id", iso, "author_name", "subject").alias("line_text"))
    return scan.read_git_log(text).select("commit_id", "author_name", "author_date_utc", "subject")


@query("export_results", """
SELECT scenario, fixture, temperature, is_workflow, coalesce(success, coverage_percent >= 100.0) AS passed, baseline_count, our_count,
       printf('%.2f', coverage_percent) AS coverage_percent, extra, baseline_ms, our_ms, baseline_tokens, our_tokens, hybrid_tokens, baseline_calls, our_calls, hybrid_calls, notes
FROM bench""")
def _(spark, d):
    return scan.export_rows(corpus.bench_results(spark, d))


@query("append_run", """
SELECT run_id, 'results' AS part, count(*) AS rows, CAST(sum(our_tokens) AS BIGINT) AS tokens FROM bench GROUP BY run_id
UNION ALL SELECT run_id, 'modes', 3 * count(*), CAST(sum(baseline_tokens + our_tokens + coalesce(hybrid_tokens, our_tokens)) AS BIGINT) FROM bench GROUP BY run_id
UNION ALL SELECT run_id, 'runs', 1, 0 FROM bench GROUP BY run_id""")
def _(spark, d):
    path = scratch_path(spark, "runs")
    results = corpus.bench_results(spark, d)
    meta = results.select("run_id").distinct().withColumn("created_at", F.col("run_id")).withColumn("repeats", F.lit(1))
    scan.append_run(results, meta, path)
    total = lambda t, part, c: scan.read_runs(spark, path, t).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(c).cast("long").alias("tokens")
    ).select("run_id", F.lit(part).alias("part"), "rows", "tokens")
    return total("bench_results", "results", F.col("our_tokens")).unionByName(total("bench_modes", "modes", F.col("tokens"))).unionByName(
        total("bench_runs", "runs", F.lit(0))
    )


def _change_lines(spark, d):
    c = corpus.order_commit_files(spark, d)
    counts = c.select("commit_id", F.format_string("%d\t%d\t%s", "inserted", "deleted", "path").alias("text"))
    named = c.select(
        "commit_id",
        F.when(F.col("status") == "R", F.concat_ws("\t", F.lit("R100"), "prev_path", "path")).otherwise(F.concat_ws("\t", "status", "path")).alias("text"),
    )
    return counts.unionByName(named)


@query("parse_numstat", """
SELECT commit_id, path, max(prev_path) AS prev_path, max(status) AS status, max(inserted) AS inserted, max(deleted) AS deleted, false AS is_binary
FROM cfiles GROUP BY commit_id, path""")
def _(spark, d):
    return extract.parse_numstat(_change_lines(spark, d))


@query("change_totals", """
SELECT commit_id, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS files
FROM (SELECT commit_id, path, max(inserted) AS inserted, max(deleted) AS deleted FROM cfiles GROUP BY commit_id, path) GROUP BY commit_id""")
def _(spark, d):
    return extract.change_totals(extract.parse_numstat(_change_lines(spark, d)))


@query("parse_hunks", """
SELECT CAST(user_id AS VARCHAR) AS commit_id, event_type || '/' || user_id % 3 AS path,
       CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS ordinal,
       k AS old_start, CASE WHEN event_id % 2 = 0 THEN 1 ELSE v END AS old_count, k + 1 AS new_start, CASE WHEN event_id % 3 = 0 THEN 1 ELSE v END AS new_count
FROM bench0""")
def _(spark, d):
    e = corpus.table(spark, d, "events")
    k, v = F.get_json_object("props", "$.k"), F.floor("value").cast("string")
    k1 = (k.cast("int") + 1).cast("string")
    head = F.concat(F.lit("+++ b/"), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string"))
    old = F.when(F.col("event_id") % 2 == 0, k).otherwise(F.concat(k, F.lit(","), v))
    new = F.when(F.col("event_id") % 3 == 0, k1).otherwise(F.concat(k1, F.lit(","), v))
    hunk = F.concat(F.lit("@@ -"), old, F.lit(" +"), new, F.lit(" @@ fn"))
    lines = e.select(F.col("user_id").cast("string").alias("commit_id"), (F.col("event_id") * 3).alias("_at"), F.posexplode(F.array(head, F.lit("+added"), hunk)).alias("_i", "text"))
    return extract.parse_hunks(lines.select("commit_id", (F.col("_at") + F.col("_i")).alias("line"), "text"))


@query("parse_status", """
SELECT snapshot_id, CAST(rn AS INTEGER) AS pos, path, xy, xy IN ('M ', 'R ') AS staged, xy = ' M' AS unstaged, xy = '??' AS untracked, renamed_from,
       xy || ' ' || CASE WHEN renamed_from IS NOT NULL THEN renamed_from || ' -> ' ELSE '' END || path AS compact
FROM (SELECT user_id AS snapshot_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 'src/' || event_type || '/' || event_id || '.cs' AS path,
             CASE event_type WHEN 'click' THEN 'M ' WHEN 'view' THEN ' M' WHEN 'purchase' THEN 'R ' ELSE '??' END AS xy,
             CASE WHEN event_type = 'purchase' THEN 'old/' || event_id || '.cs' END AS renamed_from FROM events)""")
def _(spark, d):
    e = corpus.table(spark, d, "events")
    path = F.concat(F.lit("src/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".cs"))
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("M  "), path))
        .when(F.col("event_type") == "view", F.concat(F.lit(" M "), path))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("R  old/"), F.col("event_id").cast("string"), F.lit(".cs -> "), path))
        .otherwise(F.concat(F.lit("?? "), path))
    )
    return extract.parse_status(e.select(F.col("user_id").alias("snapshot_id"), F.col("event_id").alias("line"), text.alias("text")))


def _build_log(spark, d):
    e = corpus.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    v = F.floor("value").cast("string")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("src/a.cs("), k, F.lit(","), v, F.lit("): error CS"), k, F.lit(": bad thing "), v))
        .when(F.col("event_type") == "view", F.concat(F.lit("  src/b.ts:"), k, F.lit(":"), v, F.lit(" - warning TS"), k, F.lit(": odd thing")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("error[E"), k, F.lit("]: wrong "), v))
        .when(F.col("event_type") == "signup", F.concat(F.lit("  --> src/c.rs:"), k, F.lit(":"), v))
        .otherwise(F.lit("   Compiling"))
    )
    return e.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line"), text.alias("text"))


@query("parse_diagnostics", """
, marks AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS head FROM bench0),
places AS (SELECT m.*, row_number() OVER (PARTITION BY m.user_id, m.head ORDER BY m.event_id) AS nth FROM marks m WHERE event_type = 'signup' AND head IS NOT NULL),
every AS (
  SELECT user_id AS log_id, event_id AS log_line, 'src/a.cs' AS path, k AS line, v AS col, 'error' AS severity, 'CS' || k AS code, 'bad thing ' || v AS message FROM bench0 WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, 'src/b.ts', k, v, 'warning', 'TS' || k, 'odd thing' FROM bench0 WHERE event_type = 'view'
  UNION ALL SELECT p.user_id, p.event_id, 'src/c.rs', p.k, p.v, 'error', 'E' || h.k, 'wrong ' || h.v FROM places p JOIN bench0 h ON h.event_id = p.head WHERE nth = 1)
SELECT log_id, log_line, path, line, col, severity, code, message FROM every""".replace(", marks AS", "WITH marks AS", 1))
def _(spark, d):
    return extract.parse_diagnostics(_build_log(spark, d))


@query("sanitize_log", """
WITH kept AS (SELECT user_id % 5 AS log_id, event_id AS line, CASE WHEN event_type IN ('click', 'view') THEN '| ' || CASE WHEN event_id % 2 = 0 THEN 'run' ELSE event_type END ELSE 'done' END AS text
              FROM events WHERE event_type <> 'error'),
marked AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY log_id ORDER BY line) IS NOT DISTINCT FROM text THEN 0 ELSE 1 END AS opens FROM kept),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY log_id ORDER BY line) AS seq FROM marked)
SELECT log_id, CAST(seq AS BIGINT) AS seq, CASE WHEN count(*) > 1 THEN any_value(text) || ' (x' || count(*) || ')' ELSE any_value(text) END AS text, count(*) AS repeats
FROM isl GROUP BY log_id, seq""")
def _(spark, d):
    e = corpus.table(spark, d, "events")
    word = F.when(F.col("event_id") % 2 == 0, F.lit("run")).otherwise(F.col("event_type"))
    text = (
        F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("\x1b[31m│ "), word, F.lit("\x1b[0m  ")))
        .when(F.col("event_type") == "error", F.lit("--- ── |").substr(1, 3))
        .otherwise(F.lit("done "))
    )
    return extract.sanitize_log(e.select((F.col("user_id") % 5).alias("log_id"), F.col("event_id").alias("line"), text.alias("text")))


@query("explode_trace", """
SELECT run_id, scenario, fixture, event_id, CAST(s AS INTEGER) AS step_no, CASE s WHEN 1 THEN 'classic' ELSE 'compact' END AS mode, 'git' AS operation,
       CASE s WHEN 1 THEN baseline_tokens ELSE our_tokens END AS tokens, CASE WHEN s = 2 THEN our_ms END AS elapsed_ms, 'ok' AS status, CASE WHEN s = 2 AND event_id % 4 = 0 THEN 'fallback' ELSE '' END AS notes
FROM bench, (SELECT unnest([1, 2]) AS s) WHERE event_id % 7 <> 0""")
def _(spark, d):
    from codegraph_spark.operators import runs

    b = corpus.bench_results(spark, d)
    trace = F.format_string(
        '{"modes":[{"mode":"classic","tokens":%d},{"mode":"compact","tokens":%d,"elapsedMs":%d,"usedFallback":%s}]}',
        "baseline_tokens", "our_tokens", "our_ms", (F.col("event_id") % 4 == 0).cast("string"),
    )
    traced = b.withColumn("trace_json", F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(trace))
    # the fixture carries the row key through, so that rows stay apart
    keyed = traced.withColumn("fixture", F.concat_ws("#", "fixture", F.col("event_id").cast("string")))
    steps = runs.explode_trace(keyed)
    return steps.select(
        "run_id", "scenario", F.substring_index("fixture", "#", 1).alias("fixture"), F.substring_index("fixture", "#", -1).cast("long").alias("event_id"),
        "step_no", "mode", "operation", "tokens", "elapsed_ms", "status", "notes",
    )


_CODE_LINES = """
o AS (SELECT o_custkey AS c, o_orderkey AS k, o_custkey % 2 = 0 AS cs FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
raw AS (SELECT c, cs, k, 0 AS n, 0 AS sub FROM o UNION ALL SELECT c, cs, k, l_linenumber, unnest([1, 2, 3]) FROM o JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = k UNION ALL SELECT c, cs, k, 1000, 0 FROM o),
code AS (SELECT *, '/code/' || c || CASE WHEN cs THEN '.cs' ELSE '.rs' END AS file_path, CAST(row_number() OVER (PARTITION BY c ORDER BY k, n, sub) AS INTEGER) AS line FROM raw)"""


@query("extract_symbols_braces", f"""
WITH {_CODE_LINES},
fin AS (SELECT file_path, k, max(line) AS last FROM code GROUP BY file_path, k)
SELECT c.file_path, CASE WHEN cs AND n = 0 THEN 'Class' WHEN cs THEN 'Method' WHEN n = 0 THEN 'Module' ELSE 'Function' END AS kind,
       CASE WHEN cs THEN CASE WHEN n = 0 THEN 'C' ELSE 'M' END ELSE CASE WHEN n = 0 THEN 'm' ELSE 'f' END END || CASE WHEN n = 0 THEN c.k ELSE n END AS name,
       line AS line_start, CAST(CASE WHEN n = 0 THEN last ELSE line + 2 END AS INTEGER) AS line_end
FROM code c JOIN fin f ON f.file_path = c.file_path AND f.k = c.k WHERE (n = 0 OR sub = 1) AND n < 1000""")
def _(spark, d):
    """One class or module per order, one function per line number, nested braces, braces in strings and comments."""
    from pyspark.sql.window import Window

    o = corpus.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 2 == 0).alias("cs"))
    items = corpus.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    items = items.groupBy("k", "n").agg(F.max("q").alias("q"))
    o = o.join(items.select("k").distinct(), "k", "left_semi")
    edge = lambda n: o.select("*", F.lit(n).alias("n"), F.lit(0).alias("q"), F.lit(0).alias("sub"))
    body = o.join(items, "k").withColumn("sub", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    raw = edge(0).unionByName(body.select(*edge(0).columns)).unionByName(edge(1000))
    k, n, q, cs = F.col("k").cast("string"), F.col("n").cast("string"), F.col("q").cast("string"), F.col("cs")
    text = (
        F.when(F.col("n") == 1000, F.lit("}"))
        .when(F.col("n") == 0, F.when(cs, F.concat(F.lit("public class C"), k, F.lit(" {"))).otherwise(F.concat(F.lit("pub mod m"), k, F.lit(" {"))))
        .when(F.col("sub") == 1, F.when(cs, F.concat(F.lit("    public void M"), n, F.lit("(int a) { // }"))).otherwise(F.concat(F.lit("    fn f"), n, F.lit("(a: i32) { // }"))))
        .when(F.col("sub") == 2, F.concat(F.lit("        if (a > "), q, F.lit(') { say("}"); if (a < 2) { stop(); } }')))
        .otherwise(F.lit("    }"))
    )
    lines = raw.select(
        F.lit("code").alias("repo_name"), F.concat(F.lit("/code/"), F.col("c").cast("string"), F.when(cs, F.lit(".cs")).otherwise(F.lit(".rs"))).alias("file_path"),
        F.when(cs, F.lit("CSharp")).otherwise(F.lit("Rust")).alias("language"),
        F.row_number().over(Window.partitionBy("c").orderBy("k", "n", "sub")).alias("line"), text.alias("text"),
    )
    found = extract.extract_symbols(cut(lines), [*extract.CSHARP_RULES, *extract.RUST_RULES])
    return found.select("file_path", "kind", "name", "line_start", "line_end")


@query("extract_symbols", "SELECT id, repo_name, file_path, name, kind, line_start, line_end, signature FROM tsym")
def _(spark, d):
    return corpus.document_symbols(spark, d)


def _page_import_rules():
    return [(lang, r'href="(/[^"]*)"', 1) for lang in ("en", "de", "fr", "es")]


@query("extract_imports", r"""
WITH wl AS (SELECT repo_name, file_path, language, CAST(i AS INTEGER) AS line, p[i] AS text FROM (SELECT *, unnest(generate_series(1, len(p))) AS i
            FROM (SELECT repo_name, file_path, language, string_split_regex(content, '\r\n|\n|\r') AS p FROM wfiles))),
imp AS (SELECT file_path, language, line, regexp_extract(text, 'href="(/[^"]*)"', 1) AS i FROM wl WHERE language IN ('en', 'de', 'fr', 'es') AND regexp_matches(text, 'href="(/[^"]*)"'))
SELECT file_path, language, lower(i) AS import_key, min(line) AS line FROM imp GROUP BY ALL""")
def _(spark, d):
    lines = scan.explode_lines(corpus.page_files(spark, d))
    return extract.extract_imports(lines, _page_import_rules()).select("file_path", "language", F.lower("import").alias("import_key"), "line")


@query("dedupe_imports", r"""
WITH imp AS (SELECT file_path, language, unnest(regexp_extract_all(content, 'href="(/[^"]*)"', 1)) AS i, generate_subscripts(regexp_extract_all(content, 'href="(/[^"]*)"', 1), 1) AS line FROM wfiles)
SELECT file_path, language, lower(i) AS import_key, CAST(min(line) AS INTEGER) AS line FROM imp GROUP BY ALL""")
def _(spark, d):
    raw = corpus.page_files(spark, d).select(
        "repo_name", "file_path", "language", F.posexplode(F.regexp_extract_all("content", F.lit('href="(/[^"]*)"'), 1)).alias("_p", "import")
    ).withColumn("line", F.col("_p") + 1)
    return extract.dedupe_imports(raw).select("file_path", "language", F.lower("import").alias("import_key"), "line")


_LEXICAL = r"""
runs AS (SELECT repo_name, file_path, line, text, list_distinct(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS ids0, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') AS runs FROM lines),
ids AS (SELECT repo_name, file_path, line, text, t, min(pos) AS pos FROM (SELECT repo_name, file_path, line, text, unnest(runs) AS t, generate_subscripts(runs, 1) AS pos FROM runs)
        WHERE regexp_full_match(t, '[_A-Za-z][_A-Za-z0-9]*') AND length(t) >= 3 AND t NOT IN (%s) GROUP BY ALL),
usages AS (SELECT repo_name, file_path, t AS token, line, trim(text, ' ' || chr(9)) AS context FROM ids WHERE (%s))
""" % (
    ", ".join(f"'{w}'" for w in extract.LEXICAL_STOP_WORDS),
    " OR ".join(f"contains(text, '{a}' || t || '{b}')" for a, b in tx.USAGE_SHAPES),
)


@query("lexical_usages", f"WITH {_LEXICAL} SELECT file_path, token, line, context FROM usages")
def _(spark, d):
    return extract.lexical_usages(corpus.document_lines(spark, d)).select("file_path", "token", "line", "context")


@query("rust_usages")
def _(spark, d):
    return extract.rust_usages(corpus.document_lines(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


@query("csharp_usages")
def _(spark, d):
    return extract.csharp_usages(corpus.document_lines(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


@query("expand_imports", """
WITH p AS (SELECT DISTINCT '/m/' || p_partkey AS file_path, replace(p_brand, '#', '') AS b, p_type AS t, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS c FROM part)
SELECT file_path, b || '::' || t || '::' || a AS path FROM p UNION ALL SELECT file_path, b || '::' || c FROM p UNION ALL SELECT file_path, b FROM p""")
def _(spark, d):
    p = corpus.table(spark, d, "part")
    w = F.split("p_name", " ")
    text = F.concat(
        F.lit("pub use "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("::{"), "p_type", F.lit("::{"), w[0], F.lit(" as x}, "), w[1], F.lit("::*, self};")
    )
    imports = p.select(
        F.lit("parts").alias("repo_name"), F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("file_path"), F.lit("Rust").alias("language"),
        F.lit(1).alias("line"), text.alias("import"),
    )
    return extract.expand_imports(imports).select("file_path", "path")


def _supplier_files(spark, d):
    s = corpus.table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    return s.select(
        F.lit("crates").alias("repo_name"),
        F.concat(F.lit("/w/n-"), F.col("s_nationkey").cast("string"), F.lit("/src/g"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/s"), key, F.lit(".rs")).alias("file_path"),
        "s_suppkey",
    )


def _nation_manifests(spark, d):
    n = corpus.table(spark, d, "nation")
    name = F.concat(F.lit("n-"), F.col("n_nationkey").cast("string"))
    body = F.concat(
        F.lit('[package]\nname = "'), name, F.lit('"\nversion = "0.1.0"\n\n[dependencies]\nserde = "1"\nnext = { version = "1", path = "../n-'),
        ((F.col("n_nationkey") + 1) % 25).cast("string"), F.lit('" }\n'),
    )
    return n.select(F.lit("crates").alias("repo_name"), F.concat(F.lit("/w/"), name, F.lit("/Cargo.toml")).alias("file_path"), body.alias("content"))


@query("parse_manifests", """
SELECT '/w/n-' || n_nationkey AS crate_root, 'n-' || n_nationkey AS crate_name, 'n_' || n_nationkey AS crate_key, false AS is_workspace, 'next' AS dep, '/w/n-' || (n_nationkey + 1) % 25 AS dep_root FROM nation""")
def _(spark, d):
    m = extract.parse_manifests(_nation_manifests(spark, d))
    return m.select("crate_root", "crate_name", "crate_key", "is_workspace", F.explode("path_deps").alias("p")).select(
        "crate_root", "crate_name", "crate_key", "is_workspace", F.col("p.key").alias("dep"), F.col("p.root").alias("dep_root")
    )


@query("resolve_modules", """
WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n, '/w/n-' || s_nationkey || '/src/g' || s_suppkey % 3 || '/s' || s_suppkey || '.rs' AS file_path FROM supplier),
asked AS (SELECT f.*, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step FROM f)
SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM asked a JOIN f b ON b.k = a.k + a.step AND b.n = CASE WHEN a.step % 2 = 0 THEN a.n ELSE (a.n + 1) % 25 END
WHERE a.file_path <> b.file_path""")
def _(spark, d):
    files = _supplier_files(spark, d)
    crates = linking.crate_table(files, extract.parse_manifests(_nation_manifests(spark, d)))
    target = F.col("s_suppkey") + F.col("step")
    head = F.when(F.col("step") % 2 == 0, F.lit("crate")).otherwise(F.lit("next"))
    path = F.concat(head, F.lit("::g"), (target % 3).cast("string"), F.lit("::s"), target.cast("string"), F.lit("::Item"))
    imports = files.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("repo_name", "file_path", path.alias("path"))
    return linking.resolve_modules(imports, files.select("repo_name", "file_path"), crates).select("from_file", "to_file")


@query("link_lexical", f"""
WITH {_LEXICAL},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, line_start, id) AS rn FROM tsym) WHERE rn <= 32)
SELECT c.id AS symbol_id, u.file_path AS in_file, u.line, min(u.context) AS context FROM usages u JOIN c ON c.name = u.token
WHERE NOT (c.file_path = u.file_path AND c.line_start = u.line) GROUP BY ALL""")
def _(spark, d):
    lines = corpus.document_lines(spark, d)
    return linking.link_lexical(cut(extract.lexical_usages(lines).drop("context")), corpus.document_symbols(spark, d), 32, lines=lines).select("symbol_id", "in_file", "line", "context")


@query("link_lexical_all", f"""
WITH {_LEXICAL}
SELECT c.id AS symbol_id, u.file_path AS in_file, u.line, min(u.context) AS context FROM usages u JOIN tsym c ON c.name = u.token
WHERE NOT (c.file_path = u.file_path AND c.line_start = u.line) GROUP BY ALL""")
def _(spark, d):
    lines = corpus.document_lines(spark, d)
    return linking.link_lexical(cut(extract.lexical_usages(lines).drop("context")), corpus.document_symbols(spark, d), lines=lines).select("symbol_id", "in_file", "line", "context")


@query("link_ranked", f"""
WITH {_LEXICAL},
imp AS (SELECT a.file_path AS from_file, b.file_path AS to_file FROM files a JOIN files b ON b.doc_id = a.doc_id + 1),
s AS (SELECT u.*, y.id, y.file_path AS sf, y.line_start, y.kind, i.to_file IS NOT NULL AS imported, contains(context, token || '(') AS callish,
             contains(context, ': ' || token) OR contains(context, '-> ' || token) OR contains(context, '<' || token || '>') OR contains(context, ' ' || token || ' {{') AS typish
      FROM (SELECT DISTINCT * FROM usages) u JOIN tsym y ON y.name = u.token LEFT JOIN imp i ON i.from_file = u.file_path AND i.to_file = y.file_path),
p AS (SELECT *, CASE WHEN sf = file_path THEN 18 + greatest(0, 16 - least(16, abs(line_start - line))) ELSE 0 END + CASE WHEN imported THEN 30 ELSE 0 END
             + CASE WHEN callish AND kind = 'Method' THEN 24 ELSE 0 END + CASE WHEN typish AND kind = 'Class' THEN 22 ELSE 0 END
             + CASE WHEN NOT callish AND NOT typish THEN CASE kind WHEN 'Method' THEN 9 WHEN 'Class' THEN 8 ELSE 3 END ELSE 0 END AS score FROM s),
r AS (SELECT *, row_number() OVER w AS rn, max(score) OVER (PARTITION BY file_path, token, line) AS best FROM p WINDOW w AS (PARTITION BY file_path, token, line ORDER BY score DESC, lower(sf), line_start, id))
SELECT id AS symbol_id, file_path AS in_file, line, min(context) AS context FROM r
WHERE rn <= 2 AND score >= 12 AND (rn = 1 OR best - score <= 2) AND NOT (sf = file_path AND line_start = line) GROUP BY ALL""")
def _(spark, d):
    lines = corpus.document_lines(spark, d)
    docs = corpus.table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("f"))
    imports = docs.select("doc_id", F.col("f").alias("from_file")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("f").alias("to_file")), "doc_id")
    refs = linking.link_ranked(cut(extract.lexical_usages(lines).drop("context")), corpus.document_symbols(spark, d), imports.withColumn("repo_name", F.lit("docs")), lines=lines)
    return refs.select("symbol_id", "in_file", "line", "context")


@query("link_decl_site", """
WITH sites AS (SELECT DISTINCT r.in_file AS file_path, r.line, y.name, y.file_path AS decl_file, y.line_start + r.line % 5 AS decl_line FROM prefs r JOIN psym y ON y.id = r.symbol_id),
c AS (SELECT t.*, y.id, row_number() OVER (PARTITION BY t.file_path, t.line, t.name, t.decl_file, t.decl_line ORDER BY abs(y.line_start - t.decl_line), y.id) AS rn, y.line_start
      FROM sites t JOIN psym y ON y.name = t.name AND y.file_path = t.decl_file AND t.decl_line BETWEEN y.line_start AND y.line_end)
SELECT DISTINCT id AS symbol_id, file_path AS in_file, line FROM c WHERE rn = 1 AND NOT (decl_file = file_path AND line_start = line)""")
def _(spark, d):
    s = corpus.part_symbols(spark, d)
    r = corpus.part_refs(spark, d)
    decl = s.select(F.col("id").alias("symbol_id"), "name", F.col("file_path").alias("decl_file"), "line_start")
    sites = r.join(decl, "symbol_id").select(
        "repo_name", F.col("in_file").alias("file_path"), "line", F.lit("").alias("context"), "name", "decl_file", (F.col("line_start") + F.col("line") % 5).alias("decl_line")
    ).distinct()
    return linking.link_decl_site(sites, s).select("symbol_id", "in_file", "line")


@query("build_file_nodes", """
SELECT f.repo_name, f.file_path, f.language, CAST(coalesce(s.n, 0) AS INTEGER) AS symbol_count, CASE WHEN b.file_path IS NULL THEN 0 ELSE 1 END AS import_count
FROM files f LEFT JOIN (SELECT file_path, count(*) AS n FROM tsym GROUP BY file_path) s ON s.file_path = f.file_path LEFT JOIN files b ON b.doc_id = f.doc_id + 1""")
def _(spark, d):
    files = corpus.document_files(spark, d)
    docs = corpus.table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("f"))
    imports = docs.select("doc_id", F.col("f").alias("from_file")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("f").alias("to_file")), "doc_id").withColumn("repo_name", F.lit("docs"))
    nodes = linking.build_file_nodes(files, corpus.document_symbols(spark, d), imports)
    return nodes.select("repo_name", "file_path", "language", "symbol_count", F.size("imports").alias("import_count"))


@query("enclosing_symbol", """
WITH p AS (SELECT DISTINCT in_file AS file_path, line FROM prefs),
c AS (SELECT p.*, y.id, CASE WHEN p.line <= y.line_end THEN 0 ELSE 1 END AS outside, y.line_start, y.line_end - y.line_start AS span FROM p JOIN psym y ON y.file_path = p.file_path AND y.line_start <= p.line)
SELECT file_path, line, id AS symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY outside, CASE WHEN outside = 0 THEN span ELSE 0 END, line_start DESC, id) AS rn FROM c) WHERE rn = 1""")
def _(spark, d):
    points = corpus.part_refs(spark, d).select("repo_name", F.col("in_file").alias("file_path"), "line").distinct()
    return linking.enclosing_symbol(points, corpus.part_symbols(spark, d)).select("file_path", "line", "symbol_id")


TEXT_LANGUAGE = registry.Language(
    "Text", (".txt",), tuple(extract.SymbolRule("Text", kind, pattern) for lang, kind, pattern, _ in corpus.TEXT_RULES if lang == "en"), ends="next"
)


@query("index_corpus", """
SELECT 'files' AS part, count(*) AS rows FROM files UNION ALL SELECT 'imports', 0 UNION ALL
SELECT 'symbols', count(*) FROM (SELECT 1 FROM lines WHERE regexp_matches(text, '^[A-Z][A-Za-z0-9_]{6,}|^[A-Z][A-Za-z0-9_]{1,5}([^A-Za-z0-9_]|$)'))""")
def _(spark, d):
    ix = registry.index_corpus(corpus.document_files(spark, d), registry.Registry().register(TEXT_LANGUAGE))
    n = lambda df, part: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), "rows")
    return n(ix.files, "files").unionByName(n(ix.symbols, "symbols")).unionByName(n(ix.file_imports, "imports"))


@query("register_language")
def _(spark, d):
    r = registry.register_language(registry.Registry(), "Text", [".txt"], TEXT_LANGUAGE.symbol_rules, ends="next", usage_fn=extract.rust_usages)
    return registry.index_corpus(corpus.document_files(spark, d), r).refs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("refs"))
