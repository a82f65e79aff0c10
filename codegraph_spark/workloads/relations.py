"""Graph, edit and history queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegraph_spark.operators import edits, graph, history
from codegraph_spark.plans.lineage import cut
from codegraph_spark.sources import corpus
from codegraph_spark.workloads.base import query
from codegraph_spark.workloads.retrieval import part_queries, text_symbols

_CONTAINS = "SELECT 'file:' || file_path AS src, 'symbol:' || id AS dst, 'contains' AS type FROM psym"
_IMPORTS = "SELECT 'file:' || from_file AS src, 'file:' || to_file AS dst, 'imports' AS type FROM pimports"
_REFS = "SELECT DISTINCT 'symbol:' || symbol_id AS src, 'file:' || in_file AS dst, 'references' AS type FROM prefs"
_CALLS = "SELECT DISTINCT 'symbol:' || caller AS src, 'symbol:' || callee AS dst, 'callers' AS type FROM calls"


def _part_tables(spark, d):
    return corpus.part_files(spark, d), corpus.part_symbols(spark, d), corpus.part_refs(spark, d), corpus.part_imports(spark, d)


@query("build_nodes", """
SELECT 'file:' || file_path AS id, 'file' AS type, regexp_extract(file_path, '[^/]*$') AS label, file_path, 0 AS line_start FROM pfiles
UNION ALL SELECT 'symbol:' || id, 'symbol', name, file_path, line_start FROM psym""")
def _(spark, d):
    files, symbols, _, imports = _part_tables(spark, d)
    return graph.build_nodes(files, symbols, imports).select("id", "type", "label", "file_path", "line_start")


@query("build_edges", f"{_CONTAINS} UNION ALL {_IMPORTS} UNION ALL {_REFS} UNION ALL {_CALLS}")
def _(spark, d):
    return graph.build_edges(*_part_tables(spark, d), types=["contains", "imports", "References", "callers", "unknown"])


@query("implements_edges", """
WITH n AS (SELECT DISTINCT lower(name) AS n FROM tsym), h AS (SELECT n, id FROM tsym JOIN n ON contains(lower(name), n) WHERE kind = 'Class')
SELECT 'symbol:' || h.id AS src, 'symbol:' || t.id AS dst, 'implements' AS type FROM h JOIN tsym t ON lower(t.name) = h.n AND t.id <> h.id""")
def _(spark, d):
    return graph.implements_edges(text_symbols(spark, d))


@query("implements_names", """
SELECT i.id AS impl_id, n.name FROM tsym i JOIN (SELECT DISTINCT lower(name) AS name FROM tsym) n ON contains(lower(i.name), n.name) WHERE i.kind = 'Class'""")
def _(spark, d):
    return graph.implements_names(text_symbols(spark, d)).select("impl_id", "name")


def _nation_seeds(spark, d):
    n = corpus.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))


def _bfs(step: str, near: str, depth: int = 2, cap: int = 60) -> str:
    """Level-by-level SQL of the bounded expansion from the nations."""
    levels = [f"v0 AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'nation:' || n_nationkey AS node, 0 AS distance FROM nation)", f"st AS ({step})"]
    for i in range(1, depth + 1):
        levels.append(
            f"f{i} AS (SELECT DISTINCT v.query_id, s.nx AS node FROM v{i - 1} v JOIN st s ON s.cur = v.node WHERE v.distance = {i - 1} AND NOT EXISTS (SELECT 1 FROM v{i - 1} w WHERE w.query_id = v.query_id AND w.node = s.nx)),\n"
            f"k{i} AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY lower(n.label), f.node) AS rn FROM f{i} f JOIN gnodes n ON n.id = f.node),\n"
            f"v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT k.query_id, k.node, {i} FROM k{i} k JOIN (SELECT query_id, count(*) AS held FROM v{i - 1} GROUP BY query_id) h ON h.query_id = k.query_id WHERE k.rn + h.held <= {cap})"
        )
    levels.append(f"kept AS (SELECT * FROM v{depth})")
    levels.append(f"ke AS (SELECT a.query_id, e.src, e.dst, e.type FROM gedges e JOIN kept a ON a.node = e.src JOIN kept b ON b.node = e.dst AND b.query_id = a.query_id WHERE {near})")
    return "WITH " + ",\n".join(levels)


_BOTH = "SELECT src AS cur, dst AS nx FROM gedges UNION SELECT dst, src FROM gedges"


@query("graph_query", _bfs(_BOTH, "least(a.distance, b.distance) < 2") + """
SELECT query_id, 'node' AS what, node AS id, distance FROM kept UNION ALL SELECT query_id, 'edge', src || '|' || dst || '|' || type, NULL FROM ke""")
def _(spark, d):
    nodes, edges = corpus.trade_graph(spark, d)
    got, kept = graph.graph_query(nodes, edges, _nation_seeds(spark, d), depth=2, max_nodes=60)
    return got.select("query_id", F.lit("node").alias("what"), F.col("node").alias("id"), "distance").unionByName(
        kept.select("query_id", F.lit("edge").alias("what"), F.concat_ws("|", "src", "dst", "type").alias("id"), F.lit(None).cast("int").alias("distance"))
    )


@query("dict_encode_graph", _bfs(_BOTH, "least(a.distance, b.distance) < 2") + """,
ids AS (SELECT query_id, v, dense_rank() OVER (PARTITION BY query_id ORDER BY lower(v)) - 1 AS idx FROM (SELECT query_id, node AS v FROM kept UNION SELECT query_id, src FROM ke UNION SELECT query_id, dst FROM ke)),
tys AS (SELECT query_id, type, dense_rank() OVER (PARTITION BY query_id ORDER BY lower(type)) - 1 AS idx FROM (SELECT DISTINCT query_id, type FROM ke))
SELECT k.query_id, 'node' AS what, CAST(i.idx AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, CAST(NULL AS INTEGER) AS c FROM kept k JOIN ids i ON i.query_id = k.query_id AND i.v = k.node
UNION ALL SELECT e.query_id, 'edge', CAST(s.idx AS INTEGER), CAST(d.idx AS INTEGER), CAST(t.idx AS INTEGER) FROM ke e JOIN ids s ON s.query_id = e.query_id AND s.v = e.src JOIN ids d ON d.query_id = e.query_id AND d.v = e.dst
JOIN tys t ON t.query_id = e.query_id AND t.type = e.type""")
def _(spark, d):
    """Nodes and edges of an answer over one dictionary of ids."""
    from codegraph_spark.operators import runs

    nodes, edges = corpus.trade_graph(spark, d)
    got, kept = graph.graph_query(nodes, edges, _nation_seeds(spark, d), depth=2, max_nodes=60)
    _, rows = runs.dict_encode_tables({"nodes": (cut(got.select("query_id", "node")), {"node": "id"}), "edges": (cut(kept), {"src": "id", "dst": "id", "type": "type"})})
    none = F.lit(None).cast("int")
    return rows["nodes"].select("query_id", F.lit("node").alias("what"), F.col("node").alias("a"), none.alias("b"), none.alias("c")).unionByName(
        rows["edges"].select("query_id", F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"))
    )


@query("graph_query_out", _bfs("SELECT src AS cur, dst AS nx FROM gedges", "a.distance < 3", depth=3, cap=200) + " SELECT query_id, node, distance FROM kept")
def _(spark, d):
    nodes, edges = corpus.trade_graph(spark, d)
    got, _ = graph.graph_query(nodes, edges, _nation_seeds(spark, d), depth=3, max_nodes=200, direction="out")
    return got.select("query_id", "node", "distance")


@query("graph_expand", _bfs("SELECT cur, nx FROM (" + _BOTH + ") WHERE cur <> 'customer:1' AND nx <> 'customer:1'", "least(a.distance, b.distance) < 2 AND e.src <> 'customer:1' AND e.dst <> 'customer:1'") + """,
pg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY type, src, dst) AS edge_no, count(*) OVER (PARTITION BY query_id) AS total_edges FROM ke)
SELECT query_id, CAST(edge_no AS INTEGER) AS edge_no, src, dst, type, total_edges, total_edges > 30 AS has_more, CAST(CASE WHEN total_edges > 30 THEN 30 END AS INTEGER) AS next_offset FROM pg WHERE edge_no > 10 AND edge_no <= 30""")
def _(spark, d):
    nodes, edges = corpus.trade_graph(spark, d)
    gone = nodes.filter("id = 'customer:1'").select("id")
    _, page = graph.graph_expand(nodes, edges, _nation_seeds(spark, d), 2, 60, exclude_nodes=gone, offset=10, limit=20)
    return page.select("query_id", "edge_no", "src", "dst", "type", "total_edges", "has_more", "next_offset")


@query("graph_collapse", _bfs(_BOTH, "least(a.distance, b.distance) < 2") + """
SELECT query_id, 'node' AS what, node AS id FROM kept WHERE distance > 0 UNION ALL SELECT query_id, 'edge', src || '|' || dst || '|' || type FROM ke""")
def _(spark, d):
    nodes, edges = corpus.trade_graph(spark, d)
    return graph.graph_collapse(nodes, edges, _nation_seeds(spark, d), depth=2, max_nodes=60)


def _text_graph(spark, d):
    """Files of all documents with all of their symbols, one step around: a pack counts labels, so no node may be left out before."""
    docs = corpus.table(spark, d, "documents")
    path = F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    seeds = docs.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("file:"), path).alias("node"))
    files, symbols = corpus.document_files(spark, d), text_symbols(spark, d)
    nodes = graph.build_nodes(files, symbols)
    edges = graph.build_edges(files, symbols, corpus.part_refs(spark, d).limit(0), corpus.part_imports(spark, d).limit(0), types=["contains"])
    got, _ = graph.graph_query(nodes, edges, seeds, depth=1, max_nodes=None)
    return cut(got)


_TEXT_GRAPH = """
WITH g AS (SELECT f.doc_id AS query_id, t.name AS label, 'symbol:' || t.id AS node, t.file_path, t.line_start FROM labs l JOIN files f ON f.doc_id = l.doc_id JOIN tsym t ON t.file_path = f.file_path),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(label) ORDER BY lower(label), node) AS nth FROM g),
lab AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY lower(label), node) AS rn FROM s WHERE nth = 1),
sn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lower(label), node) AS rn FROM g),
txt AS (SELECT sn.query_id, sn.rn, sn.file_path, sn.line_start, string_agg(l.text, chr(10) ORDER BY l.line) AS context FROM sn JOIN lines l ON l.file_path = sn.file_path AND l.line BETWEEN sn.line_start - 2 AND sn.line_start + 2 WHERE sn.rn <= 12 GROUP BY ALL),
pack AS (SELECT f.doc_id AS query_id, 'file' AS part, 1 AS rank, f.file_path AS value, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS context FROM labs l JOIN files f ON f.doc_id = l.doc_id
UNION ALL SELECT query_id, 'symbol', CAST(rn AS INTEGER), label, NULL, NULL FROM lab WHERE rn <= 30
UNION ALL SELECT query_id, 'snippet', CAST(rn AS INTEGER), file_path, line_start, context FROM txt)
"""


@query("graph_context_pack", _TEXT_GRAPH + "SELECT query_id, part, rank, value, line, context FROM pack")
def _(spark, d):
    return graph.graph_context_pack(_text_graph(spark, d), corpus.document_files(spark, d), 2)


@query("graph_pack_tokens", _TEXT_GRAPH + "SELECT query_id, CAST(sum(length(coalesce(context, value))) // 4 AS BIGINT) AS tokens FROM pack GROUP BY query_id")
def _(spark, d):
    return graph.graph_pack_tokens(graph.graph_context_pack(_text_graph(spark, d), corpus.document_files(spark, d), 2))


def _part_seeds(spark, d):
    return corpus.part_symbols(spark, d).select(F.col("id").cast("long").alias("query_id"), F.col("id").alias("symbol_id"))


@query("callers_of", """
SELECT CAST(callee AS BIGINT) AS query_id, callee AS symbol_id, caller FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY in_file, line, caller) AS rn FROM (
SELECT callee, caller, arg_min(in_file, in_file || printf('%09d', line)) AS in_file, arg_min(line, in_file || printf('%09d', line)) AS line FROM calls GROUP BY callee, caller)) JOIN part ON callee = CAST(p_partkey AS VARCHAR)""")
def _(spark, d):
    return graph.callers_of(corpus.part_refs(spark, d), corpus.part_symbols(spark, d), _part_seeds(spark, d))


@query("callers_by_name", """
WITH around AS MATERIALIZED (SELECT * FROM encl),
direct AS MATERIALIZED (SELECT DISTINCT r.symbol_id AS callee, e.id AS caller FROM prefs r JOIN around e ON e.file_path = r.in_file AND e.line = r.line WHERE e.id <> r.symbol_id),
lonely AS MATERIALIZED (SELECT id, name FROM psym ANTI JOIN direct ON callee = id)
SELECT CAST(callee AS BIGINT) AS query_id, callee AS symbol_id, caller, false AS by_name FROM direct
UNION ALL SELECT DISTINCT CAST(y.id AS BIGINT), y.id, e.id, true FROM lonely y JOIN psym n ON n.name = y.name JOIN prefs r ON r.symbol_id = n.id
JOIN around e ON e.file_path = r.in_file AND e.line = r.line WHERE e.id <> y.id""")
def _(spark, d):
    return graph.callers_by_name(corpus.part_refs(spark, d), corpus.part_symbols(spark, d), _part_seeds(spark, d))


def _call_text(spark, d):
    """Body lines of the parts' files: line n of a file calls the names of the parts that start there."""
    s = corpus.part_symbols(spark, d)
    return s.groupBy("repo_name", "file_path", F.col("line_start").alias("line")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("name")), lambda n: F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit("()"))), "; ").alias("text")
    )


@query("callees_of", """
WITH names AS (SELECT id, replace(name, ' ', '_') AS fn, kind, file_path, line_start, line_end FROM psym),
called AS (SELECT s.id, n.fn, min(n.line_start) AS line FROM names s JOIN names n ON n.file_path = s.file_path AND n.line_start BETWEEN s.line_start AND s.line_end GROUP BY s.id, n.fn),
firsts AS (SELECT id, fn, row_number() OVER (PARTITION BY id ORDER BY line, fn) AS rn FROM called),
cand AS (SELECT id AS target, fn, row_number() OVER (PARTITION BY fn ORDER BY file_path, line_start, id) AS rn FROM names WHERE kind IN ('LARGE', 'SMALL', 'MEDIUM'))
SELECT DISTINCT CAST(s.id AS BIGINT) AS query_id, s.id AS symbol_id, c.target FROM firsts f JOIN names s ON s.id = f.id JOIN cand c ON c.fn = f.fn AND c.target <> s.id
JOIN prefs r ON r.symbol_id = c.target AND r.in_file = s.file_path AND r.line BETWEEN s.line_start AND s.line_end""")
def _(spark, d):
    s = corpus.part_symbols(spark, d).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))
    return graph.callees_of(s, _call_text(spark, d), corpus.part_refs(spark, d), _part_seeds(spark, d), kinds=("LARGE", "SMALL", "MEDIUM"))


_CALL_EDGES = """
ce AS (SELECT DISTINCT 'symbol:' || c.caller AS src, 'symbol:' || c.callee AS dst FROM calls c JOIN (
       SELECT symbol_id, in_file, line, row_number() OVER (PARTITION BY symbol_id ORDER BY in_file, line) AS rn FROM prefs) r ON r.symbol_id = c.callee AND r.in_file = c.in_file AND r.line = c.line),
v0 AS (SELECT CAST(id AS BIGINT) AS query_id, 'symbol:' || id AS node, 0 AS distance FROM psym),
f1 AS (SELECT DISTINCT v.query_id, e.src AS node FROM v0 v JOIN ce e ON e.dst = v.node WHERE e.src <> v.node),
k1 AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY lower(y.name), f.node) AS rn FROM f1 f JOIN psym y ON 'symbol:' || y.id = f.node),
v1 AS (SELECT * FROM v0 UNION ALL SELECT query_id, node, 1 FROM k1 WHERE rn + 1 <= 40),
f2 AS (SELECT DISTINCT v.query_id, e.src AS node FROM v1 v JOIN ce e ON e.dst = v.node WHERE v.distance = 1 AND NOT EXISTS (SELECT 1 FROM v1 w WHERE w.query_id = v.query_id AND w.node = e.src)),
k2 AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY lower(y.name), f.node) AS rn FROM f2 f JOIN psym y ON 'symbol:' || y.id = f.node),
v2 AS (SELECT * FROM v1 UNION ALL SELECT k.query_id, k.node, 2 FROM k2 k JOIN (SELECT query_id, count(*) AS held FROM v1 GROUP BY query_id) h ON h.query_id = k.query_id WHERE k.rn + h.held <= 40)"""


@query("references_tree", "WITH " + _CALL_EDGES + """
SELECT query_id, 'node' AS what, node AS id, distance FROM v2
UNION ALL SELECT b.query_id, 'edge', e.src || '|' || e.dst, NULL FROM ce e JOIN v2 a ON a.node = e.src JOIN v2 b ON b.node = e.dst AND b.query_id = a.query_id WHERE b.distance < 2""")
def _(spark, d):
    nodes, edges = graph.references_tree(corpus.part_refs(spark, d), corpus.part_symbols(spark, d), _part_seeds(spark, d), depth=2, max_nodes=40)
    return nodes.select("query_id", F.lit("node").alias("what"), F.col("node").alias("id"), "distance").unionByName(
        edges.select("query_id", F.lit("edge").alias("what"), F.concat_ws("|", "src", "dst").alias("id"), F.lit(None).cast("int").alias("distance"))
    )


@query("compact_graph", """
WITH c AS (SELECT 'file:' || file_path AS src, 'symbol:' || id AS dst, 'c' AS type FROM psym),
i AS (SELECT DISTINCT 'file:' || from_file AS src, 'file:' || to_file AS dst, 'i' AS type FROM (SELECT *, row_number() OVER (PARTITION BY from_file ORDER BY to_file) AS a, row_number() OVER (PARTITION BY to_file ORDER BY from_file) AS b FROM pimports)),
r AS (SELECT DISTINCT 'symbol:' || symbol_id AS src, 'file:' || in_file AS dst, 'r' AS type FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY in_file, line) AS rn FROM prefs)),
e AS (SELECT * FROM c UNION ALL SELECT * FROM i UNION ALL SELECT * FROM r), st AS (SELECT src AS cur, dst AS nx FROM e UNION SELECT dst, src FROM e WHERE type <> 'r'),
nd AS (SELECT 'file:' || file_path AS node, regexp_extract(file_path, '[^/]*$') AS label FROM pfiles UNION ALL SELECT 'symbol:' || id, name FROM psym),
v0 AS (SELECT CAST(id AS BIGINT) AS query_id, 'symbol:' || id AS node, 0 AS distance FROM psym),
f1 AS (SELECT DISTINCT v.query_id, s.nx AS node FROM v0 v JOIN st s ON s.cur = v.node AND s.nx <> v.node),
k1 AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY lower(label), f.node) AS rn FROM f1 f JOIN nd ON nd.node = f.node),
v1 AS (SELECT * FROM v0 UNION ALL SELECT query_id, node, 1 FROM k1 WHERE rn + 1 <= 50)
SELECT query_id, 'node' AS what, node AS id, distance FROM v1
UNION ALL SELECT a.query_id, 'edge', e.src || '|' || e.dst || '|' || e.type, NULL FROM e JOIN v1 a ON a.node = e.src JOIN v1 b ON b.node = e.dst AND b.query_id = a.query_id
WHERE CASE WHEN e.type = 'r' THEN a.distance < 1 ELSE least(a.distance, b.distance) < 1 END""")
def _(spark, d):
    files, symbols, refs, imports = _part_tables(spark, d)
    edges = cut(graph.compact_edges(files, symbols, refs, imports))
    seeds = _part_seeds(spark, d).select("query_id", F.concat(F.lit("symbol:"), "symbol_id").alias("node"))
    nodes, kept = graph.compact_graph(graph.build_nodes(files, symbols), edges, seeds, depth=1, max_nodes=50)
    return nodes.select("query_id", F.lit("node").alias("what"), F.col("node").alias("id"), "distance").unionByName(
        kept.select("query_id", F.lit("edge").alias("what"), F.concat_ws("|", "src", "dst", "type").alias("id"), F.lit(None).cast("int").alias("distance"))
    )


FINDS = [(1, "literal", "the ", True), (2, "literal", "en", False), (3, "regex", "[aeiou]{2}", False)]
_FIND_SQL = """
h AS (SELECT 1 AS query_id, file_path, line, (length(text) - length(replace(lower(text), 'the ', ''))) // 4 AS count, text FROM lines
      UNION ALL SELECT 2, file_path, line, (length(text) - length(replace(text, 'en', ''))) // 2, text FROM lines
      UNION ALL SELECT 3, file_path, line, len(regexp_extract_all(text, '[aeiou]{2}')), text FROM lines),
p AS (SELECT *, sum(count) OVER (PARTITION BY query_id ORDER BY file_path, line) AS running FROM h WHERE count > 0),
planned AS (SELECT CAST(query_id AS BIGINT) AS query_id, file_path, line, CAST(count AS INTEGER) AS count, substr(trim(text, ' ' || chr(9)), 1, 240) AS preview, CAST(running AS BIGINT) AS running,
            row_number() OVER (PARTITION BY query_id, file_path ORDER BY line) <= 24 AS shown FROM p WHERE running - count < 300)"""


@query("replace_plan", f"WITH {_FIND_SQL} SELECT query_id, file_path, line, count, preview, running, shown FROM planned")
def _(spark, d):
    return edits.replace_plan(corpus.document_lines(spark, d), FINDS, 300).select("query_id", "file_path", "line", "count", "preview", "running", "shown")


@query("replace_plan_files", f"WITH {_FIND_SQL} SELECT query_id, file_path, CAST(sum(count) AS BIGINT) AS total, count(*) AS lines FROM planned GROUP BY query_id, file_path")
def _(spark, d):
    return edits.replace_plan_files(edits.replace_plan(corpus.document_lines(spark, d), FINDS, 300))


@query("replace_plan_all", f"WITH {_FIND_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, file_path, CAST(sum(count) AS BIGINT) AS total, count(*) AS lines FROM p GROUP BY query_id, file_path")
def _(spark, d):
    return edits.replace_plan_files(edits.replace_matches(corpus.document_lines(spark, d), FINDS))


@query("rename_plan", """
WITH df AS (SELECT * FROM (SELECT k.query_id, y.*, row_number() OVER (PARTITION BY k.query_id ORDER BY file_path, line_start, id) AS rn FROM psym y JOIN pq k ON lower(y.name) = lower(k.q)))
SELECT query_id, id AS symbol_id, name AS old_name, 'renamed' AS new_name, file_path, line_start AS line, 'definition' AS kind FROM df
UNION ALL SELECT query_id, id, name, 'renamed', in_file, line, 'reference' FROM (SELECT d.query_id, d.id, d.name, r.in_file, r.line, row_number() OVER (PARTITION BY d.query_id, d.id ORDER BY r.in_file, r.line) AS rk
FROM df d JOIN (SELECT DISTINCT symbol_id, in_file, line FROM prefs) r ON r.symbol_id = d.id)""")
def _(spark, d):
    req = part_queries(spark, d).select("query_id", F.upper("q").alias("symbol_name"), F.lit("renamed").alias("new_name"))
    return edits.rename_plan(corpus.part_symbols(spark, d), corpus.part_refs(spark, d), req)


def _document_paths(spark, d):
    docs = corpus.table(spark, d, "documents").join(corpus.table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
        F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
    )


@query("patch_files", """
WITH f AS (SELECT f.doc_id, f.file_path, content FROM files f JOIN labs l ON l.doc_id = f.doc_id)
SELECT file_path AS path, true AS ok, 'applied' AS status, CAST((length(content) - length(replace(content, 'en', ''))) // 2 AS INTEGER) AS changes, sha256(replace(content, 'en', '<EN>')) AS sha FROM f""")
def _(spark, d):
    ops = _document_paths(spark, d).select(
        F.lit(1).alias("seq"), "path", F.lit("literal").alias("mode"), F.lit("en").alias("find"), F.lit("<EN>").alias("replace"),
        F.lit(True).alias("replace_all"), F.lit(False).alias("ignore_case"),
    )
    touched, results = edits.patch_files(corpus.document_files(spark, d), ops, dry_run=False)
    return results.join(touched.select(F.col("file_path").alias("path"), F.sha2("content", 256).alias("sha")), "path").select("path", "ok", "status", "changes", "sha")


@query("edit_lines", r"""
WITH f AS (SELECT f.file_path, l.quality, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM (SELECT *, string_split_regex(content, '\r\n|\n|\r') AS p FROM files) f JOIN labs l ON l.doc_id = f.doc_id),
e AS (SELECT file_path, quality, p, len(p) AS n, CASE WHEN quality = 1 THEN ['top'] || p ELSE CASE WHEN len(p) >= 2 THEN p[1:1] || p[3:len(p)] ELSE p END END AS q FROM f)
SELECT file_path AS path, CASE WHEN quality = 1 THEN 'insert_before' ELSE 'delete_range' END AS type, quality = 1 OR n >= 2 AS ok,
       CASE WHEN quality = 1 OR n >= 2 THEN 'applied' ELSE 'startLine is outside file' END AS status, CASE WHEN quality = 1 OR n >= 2 THEN 1 ELSE 0 END AS changed, len(q) AS line_count, array_to_string(q, chr(10)) AS text FROM e""")
def _(spark, d):
    top = F.col("quality") == 1
    ops = _document_paths(spark, d).select(
        F.lit(1).alias("seq"), "path", F.when(top, F.lit("insert_before")).otherwise(F.lit("delete_range")).alias("type"),
        F.when(top, 1).otherwise(2).alias("start_line"), F.when(top, 0).otherwise(2).alias("end_line"), F.lit("top").alias("content"),
        F.lit(None).cast("string").alias("find"), F.lit(None).cast("int").alias("occurrence"),
    )
    from codegraph_spark.functions import text as tx

    touched, results = edits.edit_lines(corpus.document_files(spark, d), ops)
    lines = tx.lines_of(F.col("content"))
    after = touched.select(F.col("file_path").alias("path"), F.size(lines).cast("long").alias("line_count"), F.array_join(lines, "\n").alias("text"))
    return results.join(after, "path").select("path", "type", "ok", "status", "changed", "line_count", "text")


@query("read_range", "SELECT f.doc_id AS query_id, n.file_path, n.line, n.text FROM labs l JOIN files f ON f.doc_id = l.doc_id JOIN lines n ON n.file_path = f.file_path AND n.line BETWEEN 2 AND 4")
def _(spark, d):
    req = _document_paths(spark, d).select(F.col("doc_id").alias("query_id"), "path", F.lit(2).alias("from_line"), F.lit(4).alias("to_line"))
    return edits.read_range(corpus.document_files(spark, d), req).drop("repo_name")


@query("read_spans", """
SELECT f.doc_id AS query_id, 1 AS pos, n.file_path, 3 AS span_from, CAST(max(n.line) AS INTEGER) AS span_to, string_agg(n.text, chr(10) ORDER BY n.line) AS text
FROM labs l JOIN files f ON f.doc_id = l.doc_id JOIN lines n ON n.file_path = f.file_path AND n.line BETWEEN 3 AND 22 GROUP BY f.doc_id, n.file_path""")
def _(spark, d):
    spans = _document_paths(spark, d).select(F.col("doc_id").alias("query_id"), F.lit(1).alias("pos"), "path", F.lit(3).alias("from_line"), F.lit(0).alias("to_line"))
    return edits.read_spans(corpus.document_files(spark, d), spans, 20).drop("repo_name")


@query("read_many", """
SELECT f.doc_id % 7 AS query_id, f.doc_id AS pos, f.file_path, count(n.line) AS total_lines, CASE WHEN l.quality = 1 THEN any_value(f.content) ELSE string_agg(CASE WHEN n.line BETWEEN 1 AND 3 THEN n.text END, chr(10) ORDER BY n.line) END AS text
FROM labs l JOIN files f ON f.doc_id = l.doc_id JOIN lines n ON n.file_path = f.file_path GROUP BY f.doc_id, f.file_path, l.quality""")
def _(spark, d):
    req = _document_paths(spark, d).select(
        (F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("pos"), "path", F.lit(0).alias("from_line"), F.when(F.col("quality") == 1, 0).otherwise(3).alias("to_line")
    )
    return edits.read_many(corpus.document_files(spark, d), req).drop("repo_name").withColumn("total_lines", F.col("total_lines").cast("long"))


@query("dir_tree", """
SELECT DISTINCT 'd' AS type, '/docs/' || lang AS path, 0 AS depth FROM documents UNION ALL SELECT DISTINCT 'd', '/docs/' || lang || '/' || source, 1 FROM documents
UNION ALL SELECT 'f', file_path, 2 FROM files WHERE NOT contains(file_path, '/src3/')""".replace("FROM documents UNION ALL SELECT 'f'", "FROM documents WHERE source <> 'src3' UNION ALL SELECT 'f'").replace("1 FROM documents\n", "1 FROM documents WHERE source <> 'src3'\n"))
def _(spark, d):
    return edits.dir_tree(corpus.document_files(spark, d), "/docs", 3, None, excludes=("src3",))


@query("upsert_files", """
WITH w AS (SELECT f.file_path, l.quality = 1 AS may, 'new ' || l.doc_id || chr(10) AS content FROM labs l JOIN files f ON f.doc_id = l.doc_id UNION ALL SELECT '/new/' || doc_id, false, 'new ' || doc_id || chr(10) FROM labs)
SELECT file_path, content FROM files WHERE file_path NOT IN (SELECT file_path FROM w WHERE may) UNION ALL SELECT file_path, content FROM w WHERE may OR starts_with(file_path, '/new/')""")
def _(spark, d):
    lab = _document_paths(spark, d)
    body = F.concat(F.lit("new "), F.col("doc_id").cast("string"))
    w = lab.select("path", (F.col("quality") == 1).alias("overwrite"), body.alias("content")).unionByName(
        lab.select(F.concat(F.lit("/new/"), F.col("doc_id").cast("string")).alias("path"), F.lit(False).alias("overwrite"), body.alias("content"))
    ).withColumn("repo_name", F.lit("docs")).withColumn("language", F.lit("en")).withColumn("trailing_newline", F.lit(True))
    after, _ = edits.upsert_files(corpus.document_files(spark, d), w)
    return after.select("file_path", "content")


def _history_tables(spark, d):
    return corpus.order_commits(spark, d), corpus.order_commit_files(spark, d)


def _part_paths(spark, d):
    return corpus.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").cast("string").alias("path"))


@query("history", """
WITH t AS (SELECT DISTINCT path, commit_id FROM cfiles),
r AS (SELECT t.path, c.*, row_number() OVER (PARTITION BY t.path ORDER BY author_date_utc DESC, c.commit_id DESC) AS rn FROM t JOIN commits c ON c.commit_id = t.commit_id WHERE author_date_utc >= TIMESTAMP '1996-01-01'),
s AS (SELECT commit_id, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT path) AS files FROM cfiles GROUP BY commit_id)
SELECT CAST(path AS BIGINT) AS query_id, CAST(rn AS INTEGER) AS rank, r.commit_id, author_name, author_date_utc, subject, inserted, deleted, files FROM r JOIN s ON s.commit_id = r.commit_id WHERE rn <= 5""")
def _(spark, d):
    req = _part_paths(spark, d).withColumn("limit", F.lit(5)).withColumn("since", F.lit("1996-01-01"))
    return history.history(*_history_tables(spark, d), req).drop("repo_name")


@query("commit_summary", """
WITH t AS (SELECT commit_id, CAST(sum(inserted) AS BIGINT) AS total_inserted, CAST(sum(deleted) AS BIGINT) AS total_deleted FROM cfiles GROUP BY commit_id),
h AS (SELECT commit_id, path, count(*) AS n FROM cfiles GROUP BY commit_id, path)
SELECT CAST(c.commit_id AS BIGINT) AS query_id, c.author_name, t.total_inserted, t.total_deleted, f.path, f.status, CAST(coalesce(h.n, 0) AS INTEGER) AS hunk_count
FROM commits c JOIN cfiles f ON f.commit_id = c.commit_id JOIN t ON t.commit_id = c.commit_id LEFT JOIN h ON h.commit_id = f.commit_id AND h.path = f.path""")
def _(spark, d):
    commits, files = _history_tables(spark, d)
    hunks = files.select("commit_id", "path", F.col("deleted").alias("ordinal"), F.lit(1).alias("old_start"), "inserted", F.lit(1).alias("new_start")).select(
        "commit_id", "path", "ordinal", "old_start", F.col("inserted").alias("old_count"), "new_start", F.col("inserted").alias("new_count")
    )
    req = commits.select(F.col("commit_id").cast("long").alias("query_id"), "commit_id")
    out = history.commit_summary(commits, files, hunks, req)
    return out.select("query_id", "author_name", "total_inserted", "total_deleted", "path", "status", F.greatest(F.size("hunks"), F.lit(0)).alias("hunk_count"))


_TOUCH = "SELECT CAST(path AS BIGINT) AS query_id, path, commit_id, author_date_utc FROM (SELECT f.path, c.commit_id, c.author_date_utc, row_number() OVER (PARTITION BY path ORDER BY author_date_utc {o}, c.commit_id {o}) AS rn FROM cfiles f JOIN commits c ON c.commit_id = f.commit_id {w}) WHERE rn = 1"


@query("latest_touch", _TOUCH.format(o="DESC", w=""))
def _(spark, d):
    return history.latest_touch(*_history_tables(spark, d), _part_paths(spark, d))


@query("first_touch", _TOUCH.format(o="ASC", w="WHERE f.status = 'A'"))
def _(spark, d):
    return history.first_touch(*_history_tables(spark, d), _part_paths(spark, d))


@query("touch_count", "SELECT p_partkey AS query_id, CAST(p_partkey AS VARCHAR) AS path, count(DISTINCT commit_id) AS touches FROM part LEFT JOIN cfiles ON path = CAST(p_partkey AS VARCHAR) GROUP BY p_partkey")
def _(spark, d):
    return history.touch_count(corpus.order_commit_files(spark, d), _part_paths(spark, d))


@query("patch_text", "SELECT d.doc_id AS query_id, CAST(d.doc_id AS VARCHAR) AS commit_id, substr(text, 1, 1000) AS patch FROM documents d JOIN labs l ON l.doc_id = d.doc_id")
def _(spark, d):
    patches = corpus.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("commit_id"), F.col("text").alias("patch"))
    req = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("commit_id"), F.lit(500).alias("max_chars"))
    return history.patch_text(patches, req)


@query("diff_summary", """
WITH j AS (SELECT f.doc_id, f.file_path, CASE WHEN f.doc_id % 2 = 0 THEN substr(f.content, 1, 800) WHEN l.toxic = 1 THEN 'UNTRACKED ' || f.file_path ELSE '' END AS diff FROM labs l JOIN files f ON f.doc_id = l.doc_id)
SELECT doc_id AS query_id, file_path AS path, diff, CAST(CASE WHEN diff = '' THEN 0 ELSE length(diff) - length(replace(diff, chr(10), '')) + 1 END AS INTEGER) AS line_count FROM j""")
def _(spark, d):
    docs = corpus.table(spark, d, "documents")
    path = F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    diffs = docs.filter("doc_id % 2 = 0").select(path.alias("path"), F.lit(True).alias("staged"), F.col("text"))
    lab = _document_paths(spark, d)
    status = lab.select("path", (F.col("toxic") == 1).alias("untracked"))
    req = lab.select(F.col("doc_id").alias("query_id"), "path", F.lit(True).alias("staged"), F.lit(100).alias("max_chars"))
    return history.diff_summary(diffs, status, req).select("query_id", "path", "diff", "line_count")


@query("file_facts", """
WITH t AS (SELECT DISTINCT f.path, c.*, CAST(c.author_date_utc AS VARCHAR) || c.commit_id AS spot FROM cfiles f JOIN commits c ON c.commit_id = f.commit_id)
SELECT path, arg_min(commit_id, spot) AS first_commit, arg_max(commit_id, spot) AS latest_commit, count(*) AS touch_count, arg_max(author_name, spot) AS last_author,
       arg_max(subject, spot) AS last_subject, arg_max(author_date_utc, spot) AS last_date FROM t GROUP BY path""")
def _(spark, d):
    return history.file_facts(*_history_tables(spark, d)).drop("repo_name")


@query("commit_neighbors", """
SELECT o_orderkey AS query_id, child_commit_id AS commit_id, 'parent' AS relation, parent_commit_id AS other FROM orders JOIN cedges ON child_commit_id = CAST(o_orderkey AS VARCHAR)
UNION ALL SELECT o_orderkey, parent_commit_id, 'child', child_commit_id FROM orders JOIN cedges ON parent_commit_id = CAST(o_orderkey AS VARCHAR)""")
def _(spark, d):
    req = corpus.order_commits(spark, d).select(F.col("commit_id").cast("long").alias("query_id"), "commit_id")
    return history.commit_neighbors(corpus.order_edges(spark, d), req)


_REACH = """
RECURSIVE anc AS (SELECT query_id, 'left' AS side, left_commit AS c, 0 AS d FROM pairs UNION SELECT query_id, 'right', right_commit, 0 FROM pairs
     UNION SELECT a.query_id, a.side, e.parent_commit_id, a.d + 1 FROM anc a JOIN cedges e ON e.child_commit_id = a.c),
near AS (SELECT query_id, side, c, min(d) AS d FROM anc GROUP BY query_id, side, c)"""


def _pairs(spark, d):
    o = corpus.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("query_id")).agg(
        F.min("o_orderkey").cast("string").alias("left_commit"), F.max("o_orderkey").cast("string").alias("right_commit")
    )


@query("merge_base", f"""WITH {_REACH}
SELECT query_id, c AS base_commit, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total, far, c) AS rn FROM (
SELECT query_id, c, count(*) AS n, sum(d) AS total, max(d) AS far FROM near GROUP BY query_id, c) WHERE n = 2) WHERE rn = 1""")
def _(spark, d):
    return history.merge_base(corpus.order_edges(spark, d), _pairs(spark, d))


@query("divergence", f"WITH {_REACH} SELECT query_id, min(side) AS side, c AS commit_id FROM near GROUP BY query_id, c HAVING count(*) = 1")
def _(spark, d):
    return history.divergence(corpus.order_edges(spark, d), _pairs(spark, d))


@query("rename_chain", """
WITH RECURSIVE moves AS (SELECT f.path AS pt, f.prev_path AS pf, c.author_date_utc AS ct, c.commit_id AS cc FROM cfiles f JOIN commits c ON c.commit_id = f.commit_id WHERE f.prev_path IS NOT NULL AND f.prev_path <> f.path),
chain AS (SELECT p_partkey AS query_id, CAST(p_partkey AS VARCHAR) AS path, 0 AS hop, CAST(NULL AS VARCHAR) AS commit_id, CAST(NULL AS TIMESTAMP) AS ts FROM part
  UNION ALL SELECT query_id, pf, hop + 1, cc, ct FROM (SELECT h.query_id, h.hop, m.*, row_number() OVER (PARTITION BY h.query_id ORDER BY m.ct DESC, m.cc DESC, m.pf) AS rn FROM chain h JOIN moves m ON m.pt = h.path AND (h.ts IS NULL OR m.ct < h.ts)) WHERE rn = 1)
SELECT query_id, path, hop, commit_id FROM chain""")
def _(spark, d):
    return history.rename_chain(*_history_tables(spark, d), _part_paths(spark, d)).select("query_id", "path", "hop", "commit_id")


@query("changed_by_directory", """
WITH s AS (SELECT lang, source, doc_id % 2 = 0 AS staged, doc_id % 3 = 0 AS unstaged, doc_id % 5 = 0 AS untracked FROM documents),
l AS (SELECT '' AS directory, * FROM s UNION ALL SELECT 'docs', * FROM s UNION ALL SELECT 'docs/' || lang, * FROM s UNION ALL SELECT 'docs/' || lang || '/' || source, * FROM s)
SELECT directory, count(*) AS changed, CAST(sum(staged::INT) AS BIGINT) AS staged, CAST(sum(unstaged::INT) AS BIGINT) AS unstaged, CAST(sum(untracked::INT) AS BIGINT) AS untracked FROM l GROUP BY directory""")
def _(spark, d):
    docs = corpus.table(spark, d, "documents")
    i = F.col("doc_id")
    entries = docs.select(
        F.concat_ws("/", F.lit("docs"), "lang", "source", i.cast("string")).alias("path"), (i % 2 == 0).alias("staged"), (i % 3 == 0).alias("unstaged"), (i % 5 == 0).alias("untracked")
    )
    return history.changed_by_directory(entries)


@query("commits_between", f"""WITH {_REACH},
only_right AS (SELECT query_id, c FROM near GROUP BY query_id, c HAVING count(*) = 1 AND min(side) = 'right')
SELECT o.query_id, o.c AS commit_id, m.author_date_utc, m.subject FROM only_right o JOIN commits m ON m.commit_id = o.c
WHERE o.query_id % 2 = 0 OR EXISTS (SELECT 1 FROM cfiles f WHERE f.commit_id = o.c AND f.path = CAST(o.query_id AS VARCHAR))""")
def _(spark, d):
    req = _pairs(spark, d).select(
        "query_id", F.col("left_commit").alias("from_commit"), F.col("right_commit").alias("to_commit"),
        F.when(F.col("query_id") % 2 == 0, F.lit("")).otherwise(F.col("query_id").cast("string")).alias("path"),
    )
    commits, files = _history_tables(spark, d)
    return history.commits_between(commits, files, corpus.order_edges(spark, d), req)


