"""Lookups, ranked retrieval and context packs over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegraph_spark.operators import lookup, packs, ranked
from codegraph_spark.plans import postings
from codegraph_spark.plans.lineage import cut, scratch_path
from codegraph_spark.sources import corpus
from codegraph_spark.workloads.base import query

SYM = "id, repo_name, file_path, name, kind, line_start, line_end, signature"


def text_symbols(spark, d):
    return corpus.document_symbols(spark, d)


def part_queries(spark, d):
    """One query per distinct part name, numbered by name."""
    from pyspark.sql.window import Window

    names = corpus.table(spark, d, "part").select("p_name").distinct()
    # the distinct names are a small vocabulary, so one ordered numbering is fine
    return names.select(F.row_number().over(Window.orderBy("p_name")).cast("long").alias("query_id"), F.col("p_name").alias("q"))


@query("symbols_by_name", f"SELECT query_id, {SYM} FROM tsym JOIN q1 ON contains(lower(name), lower(q))")
def _(spark, d):
    return lookup.symbols_by_name(text_symbols(spark, d), corpus.benchmark_queries(spark, d, 1))


@query("symbols_by_file", f"SELECT l.doc_id AS query_id, {', '.join('t.' + c for c in SYM.split(', '))} FROM labs l JOIN files f ON f.doc_id = l.doc_id JOIN tsym t ON t.file_path = f.file_path")
def _(spark, d):
    docs = corpus.table(spark, d, "documents")
    req = docs.select(F.col("doc_id").alias("query_id"), F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return lookup.symbols_by_file(text_symbols(spark, d), req)


@query("symbols_by_kind", f"SELECT {SYM} FROM tsym WHERE kind IN ('Class', 'Field') AND contains(lower(name), 'er')")
def _(spark, d):
    return lookup.symbols_by_kind(text_symbols(spark, d), ["class", "FIELD"], q="er")


@query("implementors", f"SELECT query_id, {SYM} FROM tsym JOIN q1 ON contains(lower(name), lower(q)) WHERE kind = 'Class'")
def _(spark, d):
    return lookup.implementors(text_symbols(spark, d), corpus.benchmark_queries(spark, d, 1))


@query("references_of", "SELECT p_partkey AS query_id, symbol_id, in_file, repo_name, line, context FROM prefs JOIN part ON symbol_id = CAST(p_partkey AS VARCHAR)")
def _(spark, d):
    req = corpus.table(spark, d, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat(F.lit("symbol:"), F.col("p_partkey").cast("string")).alias("symbol_id")
    )
    return lookup.references_of(corpus.part_refs(spark, d), req)


def _path_requests(spark, d):
    w = corpus.page_imports(spark, d).select(F.lower("to_file").alias("path")).distinct()
    return w.select(F.xxhash64("path").alias("query_id"), "path")


@query("dependents_of", "SELECT DISTINCT lower(to_file) AS path, from_file AS file_path FROM wimports")
def _(spark, d):
    req = _path_requests(spark, d)
    return lookup.dependents_of(corpus.page_imports(spark, d), req).join(req, "query_id").select("path", "file_path")


@query("file_catalog", "SELECT repo_name, file_path, language FROM files")
def _(spark, d):
    files = corpus.document_files(spark, d).unionByName(corpus.chat_files(spark, d))
    req = files.filter("repo_name = 'docs'").select(F.upper("repo_name").alias("repo")).distinct()
    return lookup.file_catalog(files, req)


@query("file_node", "SELECT DISTINCT p.page_id AS query_id, regexp_extract(p.url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS file_path, i.to_file AS imports FROM pages p LEFT JOIN wimports i ON lower(i.from_file) = lower(regexp_extract(p.url, '^[a-z]+://[^/]+(/[^?#]*)', 1))")
def _(spark, d):
    pages = corpus.page_files(spark, d)
    files = pages.select("repo_name", "file_path").distinct()
    req = pages.select(F.col("page_id").alias("query_id"), F.col("file_path").alias("path"))
    return lookup.file_node(files, corpus.page_imports(spark, d), req).select("query_id", "file_path", "imports").distinct()


@query("source_context", """
SELECT p.doc_id AS query_id, 3 AS line, greatest(1, 3 - 2) AS from_line, string_agg(l.text, chr(10) ORDER BY l.line) AS context
FROM labs p JOIN files f ON f.doc_id = p.doc_id LEFT JOIN lines l ON l.file_path = f.file_path AND l.line BETWEEN 1 AND 5 GROUP BY p.doc_id""")
def _(spark, d):
    docs = corpus.table(spark, d, "documents")
    points = docs.select(
        F.col("doc_id").alias("query_id"), F.lit("docs").alias("repo_name"),
        F.concat_ws("/", F.lit("/docs"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.lit(3).alias("line"),
    )
    return lookup.source_context(corpus.document_files(spark, d), points, 2).select("query_id", "line", "from_line", "context")


def _page_paths(spark, d):
    return corpus.page_files(spark, d).select("repo_name", "file_path").distinct()


@query("resolve_path", """
WITH f AS (SELECT DISTINCT file_path FROM wfiles),
asked AS (SELECT page_id AS query_id, regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS path FROM pages),
hits AS (SELECT a.query_id, count(DISTINCT lower(f.file_path)) AS n, min(f.file_path) AS hit FROM asked a JOIN f ON a.path <> '' AND ends_with(lower(f.file_path), '/' || lower(a.path)) GROUP BY a.query_id)
SELECT a.query_id, CASE WHEN n = 1 THEN hit END AS resolved_path,
       CASE WHEN a.path = '' THEN '''path'' is required.' WHEN n = 1 THEN NULL WHEN n IS NULL THEN 'No indexed file matches path ''' || a.path || '''.'
            ELSE 'Path ''' || a.path || ''' is ambiguous across indexed files. Provide ''project'' or an absolute path.' END AS error
FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id""")
def _(spark, d):
    req = corpus.table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1).alias("path"))
    return lookup.resolve_path(_page_paths(spark, d), req)


@query("resolve_file_seed", """
WITH f AS (SELECT DISTINCT file_path FROM files), asked AS (SELECT doc_id AS query_id, source || '/' || doc_id || '.txt' AS path FROM documents),
c AS (SELECT query_id, file_path, CASE WHEN ends_with(lower(file_path), '/' || lower(path)) THEN 150 ELSE 0 END + 30 AS score FROM asked JOIN f ON regexp_extract(file_path, '[^/]*$') = regexp_extract(path, '[^/]*$'))
SELECT query_id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(file_path), file_path) AS rn FROM c) WHERE rn = 1""")
def _(spark, d):
    req = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("./"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    plain = req.withColumn("path", F.substr("path", F.lit(3)))
    return lookup.resolve_file_seed(corpus.document_files(spark, d), plain).select("query_id", "file_path", "score")


@query("resolve_symbol_seed", """
WITH c AS (SELECT query_id, t.*, CASE WHEN lower(name) = lower(q) THEN 600 WHEN starts_with(lower(name), lower(q)) THEN 300 ELSE 120 END + CASE WHEN kind = 'Class' THEN 120 ELSE 0 END
           + CASE WHEN contains(lower(file_path), 'src1') THEN 90 ELSE 0 END + 12 AS score FROM tsym t JOIN q1 ON contains(lower(name), lower(q)))
SELECT query_id, id, name, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(file_path), line_start, id) AS rn FROM c) WHERE rn = 1""")
def _(spark, d):
    seeds = corpus.benchmark_queries(spark, d, 1).select("query_id", F.col("q").alias("name"), F.lit("class").alias("kind"), F.lit("SRC1").alias("path_hint"))
    return lookup.resolve_symbol_seed(text_symbols(spark, d), seeds).select("query_id", "id", "name", "kind", "score")


@query("resolve_symbol_by_name", """
WITH c AS (SELECT query_id, t.*, CASE WHEN lower(name) = lower(q) THEN 100 WHEN starts_with(lower(name), lower(q)) THEN 70 ELSE 50 END
           + CASE WHEN length(q) >= 2 THEN 12 + CASE WHEN contains(lower(file_path), lower(q)) THEN 3 ELSE 0 END ELSE 0 END AS score FROM tsym t JOIN q1 ON contains(lower(name), lower(q)))
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(file_path), line_start, id) AS rn FROM c) WHERE rn = 1""")
def _(spark, d):
    return lookup.resolve_symbol_by_name(text_symbols(spark, d), corpus.benchmark_queries(spark, d, 1)).select("query_id", "id", "score")


@query("scope_filter", "SELECT file_path FROM files WHERE (file_path = '/docs/en' OR starts_with(file_path, '/docs/en/')) AND contains(file_path, 'src1')")
def _(spark, d):
    return lookup.scope_filter(corpus.document_files(spark, d), root="/docs/EN/", path_prefix="src1").select("file_path")


@query("kind_and_path_filter", """
SELECT query_id, id FROM tsym JOIN (SELECT DISTINCT hash_lang AS query_id, lang FROM (SELECT length(source) * 10 + length(lang) AS hash_lang, lang FROM documents)) r
ON contains(file_path, '/' || lang || '/') WHERE kind IN ('Class', 'Method')""")
def _(spark, d):
    req = corpus.table(spark, d, "documents").select(
        (F.length("source") * 10 + F.length("lang")).alias("query_id"), F.lit("docs").alias("repo"), F.concat(F.lit("/"), "lang", F.lit("/")).alias("path_prefix")
    ).distinct().withColumn("kinds", F.array(F.lit("class"), F.lit("Method")))
    return lookup.kind_and_path_filter(text_symbols(spark, d), req).select("query_id", "id")


ITEM = "query_id, 'symbol:' || id AS id, 's' AS t, name AS n, file_path AS p, line_start AS l, kind AS k"


@query("exact_lookup", f"""
SELECT {ITEM}, 200 AS sc, CAST(rn AS INTEGER) AS rank FROM (SELECT query_id, t.*, row_number() OVER (PARTITION BY query_id ORDER BY lower(name), lower(file_path), line_start, id) AS rn
FROM tsym t JOIN q1 ON lower(name) = lower(q)) WHERE rn <= 12""")
def _(spark, d):
    return ranked.exact_lookup(text_symbols(spark, d), corpus.benchmark_queries(spark, d, 1))


@query("exact_symbols", f"SELECT query_id, {SYM} FROM tsym JOIN q1 ON lower(name) = lower(q)")
def _(spark, d):
    return ranked.exact_symbols(text_symbols(spark, d), corpus.benchmark_queries(spark, d, 1))


def _fuzzy(weights, take: str, cand: str = "SELECT DISTINCT k.query_id, k.q, t.* FROM tsym t JOIN toks2 k ON contains(lower(t.name), k.token)"):
    exact, prefix, inside, n, p = weights
    return f"""
WITH cand AS ({cand}),
sc AS (SELECT c.*, CASE WHEN lower(name) = lower(q) THEN {exact} WHEN starts_with(lower(name), lower(q)) THEN {prefix} WHEN contains(lower(name), lower(q)) THEN {inside} ELSE 0 END
       + (SELECT coalesce(sum(CASE WHEN contains(lower(c.name), k.token) THEN {n} ELSE 0 END + CASE WHEN contains(lower(c.file_path), k.token) THEN {p} ELSE 0 END), 0) FROM toks2 k WHERE k.query_id = c.query_id) AS score FROM cand c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), file_path, line_start, id) AS rn FROM sc WHERE score > 0)
{take}"""


CAPPED = """SELECT DISTINCT query_id, q, id, repo_name, file_path, name, kind, line_start, line_end, signature FROM (
SELECT k.query_id, k.q, t.* FROM tsym t JOIN toks2 k ON contains(lower(t.name), k.token))"""


@query("fuzzy_symbols", _fuzzy((100, 70, 50, 12, 4), f"SELECT query_id, {SYM}, CAST(score AS INTEGER) AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 20"))
def _(spark, d):
    return ranked.fuzzy_symbols(text_symbols(spark, d), corpus.benchmark_queries(spark, d))


@query("fuzzy_query", _fuzzy((100, 70, 50, 12, 4), """
, near AS (SELECT r.query_id, r.rn, r.file_path, r.line_start AS line, string_agg(l.text, chr(10) ORDER BY l.line) AS context FROM r JOIN lines l ON l.file_path = r.file_path AND l.line BETWEEN r.line_start - 6 AND r.line_start + 6 WHERE r.rn <= 10 GROUP BY ALL),
missed AS (SELECT * FROM q2 WHERE query_id NOT IN (SELECT query_id FROM r) AND query_id IN (SELECT query_id FROM toks2)),
m AS (SELECT * FROM (SELECT query_id, file_path, line, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM lines JOIN missed ON contains(lower(text), lower(q))) WHERE rn <= 20),
mc AS (SELECT m.query_id, m.rn, m.file_path, m.line, string_agg(l.text, chr(10) ORDER BY l.line) AS context, max(l.line) AS last FROM m JOIN lines l ON l.file_path = m.file_path AND l.line BETWEEN m.line - 6 AND m.line + 6 GROUP BY ALL)
SELECT query_id, 'symbol' AS result, CAST(rn AS INTEGER) AS rank, id, file_path, line_start AS line, name, signature, CAST(score AS INTEGER) AS score, CAST(NULL AS INTEGER) AS from_line, CAST(NULL AS INTEGER) AS to_line, CAST(NULL AS VARCHAR) AS context FROM r WHERE rn <= 20
UNION ALL SELECT query_id, 'snippet', CAST(rn AS INTEGER), NULL, file_path, line, NULL, NULL, NULL, greatest(1, line - 6), line + 6, context FROM near
UNION ALL SELECT query_id, 'fallback', CAST(rn AS INTEGER), NULL, file_path, line, NULL, NULL, NULL, greatest(1, line - 6), CAST(last AS INTEGER), context FROM mc""".replace("\n, near", ", near", 1)))
def _(spark, d):
    return ranked.fuzzy_query(text_symbols(spark, d), corpus.document_lines(spark, d), corpus.benchmark_queries(spark, d), files=corpus.document_files(spark, d))


@query("fuzzy_compact", _fuzzy((100, 70, 50, 12, 3), f"SELECT {ITEM}, CAST(score AS INTEGER) AS sc, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 12", CAPPED))
def _(spark, d):
    return ranked.fuzzy_compact(text_symbols(spark, d), corpus.benchmark_queries(spark, d))


@query("semantic_search", _fuzzy((0, 0, 0, 4, 1), f"SELECT {ITEM}, CAST(score AS INTEGER) AS sc, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 20", CAPPED))
def _(spark, d):
    return ranked.semantic_search(text_symbols(spark, d), corpus.benchmark_queries(spark, d))


SNIPPETS = """
WITH m AS (SELECT * FROM (SELECT query_id, file_path, line, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM lines JOIN q2 ON contains(lower(text), lower(q))) WHERE rn <= 20)"""


@query("snippet_search", SNIPPETS + """
SELECT m.query_id, CAST(m.rn AS INTEGER) AS rank, m.file_path, m.line, greatest(1, m.line - 6) AS from_line, CAST(max(l.line) AS INTEGER) AS to_line, string_agg(l.text, chr(10) ORDER BY l.line) AS context
FROM m JOIN lines l ON l.file_path = m.file_path AND l.line BETWEEN m.line - 6 AND m.line + 6 GROUP BY m.query_id, m.rn, m.file_path, m.line""")
def _(spark, d):
    return ranked.snippet_search(corpus.document_lines(spark, d), corpus.benchmark_queries(spark, d), files=corpus.document_files(spark, d))


@query("snippet_compact", """
SELECT query_id, 'file:' || file_path || ':' || line AS id, 'm' AS t, regexp_extract(file_path, '[^/]*$') AS n, file_path AS p, line AS l, language AS k, 1 AS sc, CAST(rn AS INTEGER) AS rank
FROM (SELECT query_id, l.*, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM lines l JOIN q2 ON contains(lower(text), lower(q))) WHERE rn <= 12""")
def _(spark, d):
    return ranked.snippet_compact(corpus.document_lines(spark, d), corpus.benchmark_queries(spark, d))


_PART_BEST = """
cand AS (SELECT k.query_id, k.q, y.*, CASE WHEN lower(name) = lower(q) THEN 100 WHEN starts_with(lower(name), lower(q)) THEN 70 ELSE 50 END
         + (SELECT sum(CASE WHEN contains(lower(y.name), lower(t)) THEN 12 ELSE 0 END + CASE WHEN contains(lower(y.signature), lower(t)) THEN 6 ELSE 0 END
                       + CASE WHEN contains(lower(y.file_path), lower(t)) THEN {p} ELSE 0 END) FROM (SELECT unnest(string_split(k.q, ' ')) AS t)) AS score
         FROM psym y JOIN pq k ON contains(lower(name), lower(q))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), file_path, line_start, id) AS rn FROM cand),
best AS (SELECT * FROM r WHERE rn = 1)"""


@query("references_query", "WITH " + _PART_BEST.format(p=4) + """
SELECT query_id, CAST(rk AS INTEGER) AS rank, symbol_id, symbol_name, in_file, line, context FROM (
SELECT b.query_id, f.symbol_id, b.name AS symbol_name, f.in_file, f.line, f.context, row_number() OVER (PARTITION BY b.query_id ORDER BY f.in_file, f.line, f.context) AS rk FROM best b JOIN prefs f ON f.symbol_id = b.id) WHERE rk <= 20""")
def _(spark, d):
    refs = corpus.part_refs(spark, d)
    out = ranked.references_query(corpus.part_symbols(spark, d), refs, part_queries(spark, d))
    return out.select("query_id", "rank", "symbol_id", "symbol_name", "in_file", "line", "context")


@query("references_candidates", "WITH " + _PART_BEST.format(p=4) + f" SELECT query_id, CAST(rn AS INTEGER) AS rank, {SYM}, CAST(score AS INTEGER) AS score FROM r WHERE rn <= 10")
def _(spark, d):
    return ranked.references_candidates(corpus.part_symbols(spark, d), part_queries(spark, d))


_REF_ITEMS = """
refi AS (SELECT query_id, 'ref:' || symbol_id || ':' || in_file || ':' || line AS id, 'r' AS t, n, in_file AS p, line AS l, 'ref' AS k, 1 AS sc, rk FROM (
SELECT b.query_id, f.symbol_id, b.name AS n, f.in_file, f.line, row_number() OVER (PARTITION BY b.query_id ORDER BY f.in_file, f.line) AS rk
FROM best b JOIN (SELECT DISTINCT symbol_id, in_file, line FROM prefs) f ON f.symbol_id = b.id))"""


def _line_refs(spark, d):
    return corpus.part_refs(spark, d).groupBy("symbol_id", "in_file", "repo_name", "line").agg(F.min("context").alias("context"))


@query("references_compact", "WITH " + _PART_BEST.format(p=3) + "," + _REF_ITEMS + " SELECT query_id, id, t, n, p, l, k, sc, CAST(rk AS INTEGER) AS rank FROM refi WHERE rk <= 12")
def _(spark, d):
    return ranked.references_compact(corpus.part_symbols(spark, d), _line_refs(spark, d), part_queries(spark, d))


_IMPACT = "WITH " + _PART_BEST.format(p=3) + "," + _REF_ITEMS + """,
ptok AS (SELECT query_id, q, unnest(string_split(q, ' ')) AS token FROM pq),
fc AS (SELECT DISTINCT query_id, q, id, file_path, name, kind, line_start, signature FROM (SELECT k.query_id, k.q, y.*
       FROM psym y JOIN ptok k ON contains(lower(y.name), k.token))),
fs AS (SELECT c.*, CASE WHEN lower(name) = lower(q) THEN 100 WHEN starts_with(lower(name), lower(q)) THEN 70 WHEN contains(lower(name), lower(q)) THEN 50 ELSE 0 END
       + (SELECT sum(CASE WHEN contains(lower(c.name), k.token) THEN 12 ELSE 0 END + CASE WHEN contains(lower(c.signature), k.token) THEN 6 ELSE 0 END + CASE WHEN contains(lower(c.file_path), k.token) THEN 3 ELSE 0 END)
          FROM ptok k WHERE k.query_id = c.query_id) AS score FROM fc c),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), file_path, line_start, id) AS rk FROM fs),
every AS (SELECT query_id, 'symbol:' || id AS id, 's' AS t, name AS n, file_path AS p, line_start AS l, kind AS k, CAST(score AS INTEGER) AS sc, 0 AS part, rk FROM fr WHERE rk <= {cap}
          UNION ALL SELECT query_id, id, t, n, p, l, k, sc, 1, rk FROM refi WHERE rk <= {cap}),
items AS (SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY query_id ORDER BY part, rk) AS rk FROM every)"""


@query("impact_expand", _IMPACT.format(cap=8) + " SELECT query_id, id, t, n, p, l, k, sc, CAST(rk AS INTEGER) AS rank FROM items WHERE rk <= 8")
def _(spark, d):
    req = part_queries(spark, d).withColumn("max_items", F.lit(8)).withColumn("mode", F.lit("impact"))
    return ranked.impact_expand(corpus.part_symbols(spark, d), _line_refs(spark, d), req)


_PACK = _IMPACT + """,
cost AS (SELECT *, greatest(1, (length(id) + length(n) + length(p) + length(k)) // 4) AS c FROM items WHERE rk <= {cap} AND rk <> 2),
run AS (SELECT *, sum(c) OVER w AS used, row_number() OVER w AS seq FROM cost WINDOW w AS (PARTITION BY query_id ORDER BY rk))"""


@query("pack_compact", _PACK.format(cap=30) + " SELECT query_id, id, t, n, p, l, k, sc, CAST(seq AS INTEGER) AS seq, CAST(c AS INTEGER) AS cost, CAST(used AS BIGINT) AS used FROM run WHERE used <= 250")
def _(spark, d):
    req = part_queries(spark, d).withColumn("mode", F.lit("impact")).withColumn("token_budget", F.lit(250))
    items = cut(ranked.impact_expand(corpus.part_symbols(spark, d), _line_refs(spark, d), req))
    sent = items.filter("rank = 2").select("query_id", F.upper("id").alias("id"))
    return packs.pack_compact(items, req, sent)


_RESOLVE = """
ex AS (SELECT query_id, 'symbol:' || id AS id, 's' AS t, name AS n, file_path AS p, line_start AS l, kind AS k, 200 AS sc, rn AS rank, 'exact' AS stage FROM (SELECT query_id, t.*, row_number() OVER (PARTITION BY query_id ORDER BY lower(name), lower(file_path), line_start, id) AS rn
       FROM tsym t JOIN q2 ON lower(name) = lower(q)) WHERE rn <= 12),
fz AS (SELECT query_id, 'symbol:' || id AS id, 's' AS t, name AS n, file_path AS p, line_start AS l, kind AS k, CAST(score AS INTEGER) AS sc, rn AS rank, 'fuzzy' AS stage FROM r WHERE rn <= 12 AND query_id NOT IN (SELECT query_id FROM ex)),
sn AS (SELECT query_id, 'file:' || file_path || ':' || line AS id, 'm' AS t, regexp_extract(file_path, '[^/]*$') AS n, file_path AS p, line AS l, language AS k, 1 AS sc, rn AS rank, 'snippet' AS stage
       FROM (SELECT query_id, l.*, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM lines l JOIN q2 ON contains(lower(text), lower(q))) WHERE rn <= 12 AND query_id NOT IN (SELECT query_id FROM ex UNION SELECT query_id FROM fz))
SELECT query_id, id, t, n, p, l, k, sc, CAST(rank AS INTEGER) AS rank, stage FROM ex UNION ALL SELECT query_id, id, t, n, p, l, k, sc, CAST(rank AS INTEGER), stage FROM fz UNION ALL SELECT query_id, id, t, n, p, l, k, sc, CAST(rank AS INTEGER), stage FROM sn"""


@query("resolve_chain", _fuzzy((100, 70, 50, 12, 3), "," + _RESOLVE, CAPPED))
def _(spark, d):
    return ranked.resolve_chain(text_symbols(spark, d), corpus.document_lines(spark, d), corpus.benchmark_queries(spark, d))


PATTERNS = [(1, r"[a-z]+tion [a-z]+", True), (2, r"^The ", False), (3, r"(er|en|es)\.$", False), (4, r"[0-9]{3,}", False), (5, r"^[A-Z][a-z]+ [a-z]+, ", False)]
_RX = " UNION ALL ".join(
    f"SELECT {q} AS query_id, file_path, line, substr(trim(text, ' ' || chr(9)), 1, 240) AS text, text AS raw FROM lines WHERE regexp_matches(text, '{'(?i)' if i else ''}{p}')" for q, p, i in PATTERNS
)


@query("regex_scan", f"SELECT CAST(query_id AS BIGINT) AS query_id, file_path, line, text, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM ({_RX})) WHERE rn <= 250")
def _(spark, d):
    return ranked.regex_scan(corpus.document_lines(spark, d), PATTERNS, 250).drop("repo_name")


@query("regex_scan_all", f"SELECT CAST(query_id AS BIGINT) AS query_id, file_path, line, text FROM ({_RX})")
def _(spark, d):
    return ranked.regex_scan(corpus.document_lines(spark, d), PATTERNS).select("query_id", "file_path", "line", "text")


INDEXED = [*PATTERNS, (6, r"\bpress(ure)? [a-z]", True), (7, r"licen[cs]ed? under", False), (8, r"[A-Z]\w+ the river", False)]
_IX = " UNION ALL ".join(
    f"SELECT {q} AS query_id, file_path, line, substr(trim(text, ' ' || chr(9)), 1, 240) AS text FROM lines WHERE regexp_matches(text, '{'(?i)' if i else ''}{p}')" for q, p, i in INDEXED
)


def _postings(spark, d):
    path = scratch_path(spark, "postings")
    postings.write(postings.build(corpus.document_files(spark, d)), path)
    return spark.read.parquet(path)


@query("regex_scan_indexed", f"SELECT CAST(query_id AS BIGINT) AS query_id, file_path, line, text FROM ({_IX})")
def _(spark, d):
    found = ranked.indexed_scan(ranked.regex_scan, corpus.document_files(spark, d), _postings(spark, d), INDEXED)
    return found.select("query_id", "file_path", "line", "text")


_RG = """
WITH h AS (SELECT 1 AS query_id, file_path, line, strpos(lower(text), 'the ') AS col, text FROM lines
           UNION ALL SELECT 2, file_path, line, CASE WHEN regexp_matches(text, '[0-9]+') THEN length(regexp_extract(text, '^([^0-9]*)[0-9]', 1)) + 1 ELSE 0 END, text FROM lines
           UNION ALL SELECT 3, file_path, line, strpos(text, 'Der'), text FROM lines)
SELECT CAST(query_id AS BIGINT) AS query_id, file_path, line, CAST(col AS INTEGER) AS col, substr(trim(text, ' ' || chr(9)), 1, 120) AS text {rank} FROM {rows}"""
_RG_FIRST = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_path, line) AS rn FROM h WHERE col > 0) WHERE rn <= 300"
RG_PATTERNS = [(1, "literal", "THE ", True), (2, "regex", "[0-9]+", False), (3, "literal", "Der", False)]


@query("rg_search", _RG.format(rank=", CAST(rn AS INTEGER) AS rank", rows=_RG_FIRST))
def _(spark, d):
    return ranked.rg_search(corpus.document_lines(spark, d), RG_PATTERNS, 300, max_line_length=120).drop("repo_name")


@query("rg_search_all", _RG.format(rank="", rows="h WHERE col > 0"))
def _(spark, d):
    found = ranked.indexed_scan(ranked.rg_search, corpus.document_files(spark, d), _postings(spark, d), RG_PATTERNS, max_line_length=120)
    return found.select("query_id", "file_path", "line", "col", "text")


@query("test_map", """
WITH f AS (SELECT DISTINCT '/t/' || p_type || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '/Spec.rs' ELSE '/Main_Test.cs' END AS file_path FROM part WHERE p_size % 3 <> 0),
tk AS (SELECT query_id, lower(unnest(string_split(q, ' '))) AS token FROM pq),
s AS (SELECT q.query_id, f.file_path, (SELECT count(DISTINCT token) FROM tk WHERE tk.query_id = q.query_id AND contains(lower(f.file_path), token)) AS score FROM pq q, f)
SELECT query_id, CAST(rn AS INTEGER) AS rank, file_path, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(file_path), file_path) AS rn FROM s) WHERE rn <= 20""")
def _(spark, d):
    p = corpus.table(spark, d, "part")
    tail = F.when(F.col("p_size") % 3 == 0, F.lit("/main.rs")).when(F.col("p_size") % 2 == 0, F.lit("/Spec.rs")).otherwise(F.lit("/Main_Test.cs"))
    files = p.select(F.lit("t").alias("repo_name"), F.concat(F.lit("/t/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), tail).alias("file_path")).distinct()
    return ranked.test_map(files, part_queries(spark, d).withColumn("repo", F.lit("t")))


@query("query_envelope", SNIPPETS + """,
c AS (SELECT m.query_id, count(DISTINCT m.rn) AS n, sum(length(l.text) + 1) - count(DISTINCT m.rn) AS chars FROM m JOIN lines l ON l.file_path = m.file_path AND l.line BETWEEN m.line - 6 AND m.line + 6 GROUP BY m.query_id),
e AS (SELECT q.query_id, q.q, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars, CASE WHEN n IS NULL THEN 'No matching code portions were found.' ELSE 'Found ' || n || ' snippet match(es).' END AS summary FROM q2 q LEFT JOIN c ON c.query_id = q.query_id)
SELECT query_id, 'snippet' AS mode, q, summary, CASE WHEN n = 0 THEN 'low' ELSE 'high' END AS confidence, CAST(n AS BIGINT) AS result_count, CAST(greatest(1, (chars + length(summary)) // 4) AS BIGINT) AS tokens, false AS fallback_used FROM e""")
def _(spark, d):
    req = corpus.benchmark_queries(spark, d)
    hits = ranked.snippet_search(corpus.document_lines(spark, d), req, files=corpus.document_files(spark, d))
    return ranked.query_envelope(hits.select("query_id", F.length("context").alias("chars")), req, "snippet")


def _pack_request(spark, d):
    b = corpus.benchmark_queries(spark, d)
    i = F.col("query_id")
    return b.select(
        "query_id", "q",
        F.element_at(F.array(*[F.lit(x) for x in ("lookup", "impact", "bug-trace", "implementation")]), (i % 4 + 1).cast("int")).alias("mode"),
        F.element_at(F.array(*[F.lit(x) for x in ("compact", "hybrid", "full")]), (i % 3 + 1).cast("int")).alias("format"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "", "high")]), (i % 4 + 1).cast("int")).alias("budget_profile"),
        F.when(i % 5 == 0, 400).otherwise(0).alias("token_budget"),
        (i % 40).cast("int").alias("max_items"),
    )


_PRESETS = """
SELECT query_id, q, CASE query_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'impact' WHEN 2 THEN 'bug-trace' ELSE 'implementation' END AS mode,
       CASE query_id % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'hybrid' ELSE 'full' END AS format,
       CAST(CASE WHEN query_id % 5 = 0 THEN 400 ELSE CASE query_id % 4 WHEN 0 THEN 600 WHEN 1 THEN 1200 WHEN 3 THEN 2200 ELSE CASE query_id % 3 WHEN 0 THEN 600 WHEN 1 THEN 1200 ELSE 2200 END END END AS INTEGER) AS token_budget,
       CAST(CASE WHEN query_id % 40 = 0 THEN 30 ELSE greatest(5, query_id % 40) END AS INTEGER) AS max_items, 6 AS snippet_radius, 900 AS max_snippet_chars, 18 AS max_snippet_lines, 5 AS hybrid_snippet_limit
FROM q2"""


@query("pack_presets", _PRESETS)
def _(spark, d):
    return packs.pack_presets(_pack_request(spark, d))


def text_refs(spark, d):
    """References between documents by name, not multiplied out."""
    from codegraph_spark.operators import extract, linking

    lines = corpus.document_lines(spark, d)
    return linking.NameLinks(cut(extract.lexical_usages(lines).drop("context")), text_symbols(spark, d), lines)


def _pack_items(spark, d):
    return packs.pack_full(text_symbols(spark, d), text_refs(spark, d), corpus.document_files(spark, d), _pack_request(spark, d))


@query("pack_full")
def _(spark, d):
    return _pack_items(spark, d)


@query("pack_summary")
def _(spark, d):
    return packs.pack_summary(_pack_items(spark, d), _pack_request(spark, d))


@query("workflow_run")
def _(spark, d):
    return packs.workflow_run(text_symbols(spark, d), text_refs(spark, d), corpus.document_lines(spark, d), corpus.benchmark_queries(spark, d))


@query("deps", """
WITH fs AS (SELECT DISTINCT 'file' AS type, file_path AS id FROM wfiles), ss AS (SELECT id, file_path FROM psym),
every AS (SELECT f.id AS seed, 'import' AS kind, i.from_file AS src, i.to_file AS dst, row_number() OVER (PARTITION BY f.id ORDER BY i.to_file) AS rn FROM fs f JOIN wimports i ON i.from_file = f.id
          UNION ALL SELECT f.id, 'dependent', i.from_file, i.to_file, row_number() OVER (PARTITION BY f.id ORDER BY i.from_file) FROM fs f JOIN wimports i ON i.to_file = f.id
          UNION ALL SELECT s.id, 'reference', s.file_path, r.in_file, row_number() OVER (PARTITION BY s.id ORDER BY r.in_file, r.line) FROM ss s JOIN prefs r ON r.symbol_id = s.id)
SELECT seed, kind, src, dst, CAST(rn AS INTEGER) AS pos FROM every""")
def _(spark, d):
    pages = _page_paths(spark, d)
    s = corpus.part_symbols(spark, d)
    seeds = pages.select(F.lit("file").alias("type"), F.col("file_path").alias("seed")).unionByName(s.select(F.lit("symbol").alias("type"), F.col("id").alias("seed")))
    seeds = seeds.withColumn("query_id", F.xxhash64("type", "seed")).withColumn("id", F.concat_ws(":", "type", "seed"))
    out = packs.deps(pages, corpus.part_symbols(spark, d), corpus.page_imports(spark, d), corpus.part_refs(spark, d), seeds)
    return out.join(seeds.select("query_id", "seed"), "query_id").select("seed", "kind", "src", "dst", "pos")
