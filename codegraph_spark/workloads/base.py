"""Registration of queries and the SQL definitions of the model tables."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the tables of ``TABLES``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered already.")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register


LINES = r"""
SELECT repo_name, file_path, language, CAST(i AS INTEGER) AS line, parts[i] AS text
FROM (SELECT repo_name, file_path, language, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT repo_name, file_path, language, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS parts
            FROM (SELECT *, string_split_regex(content, '\r\n|\n|\r') AS p FROM {files})))
"""

# The model tables in SQL, by name; each may use the ones above it.
TABLES: dict[str, str] = {
    "files": "SELECT 'docs' AS repo_name, '/docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS file_path, lang AS language, text AS content, doc_id FROM documents",
    "labs": "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "lines": LINES.format(files="files"),
    "tsym": r"""
SELECT 'docs::' || file_path || '::' || name || '::' || kind || '::' || line_start AS id, repo_name, file_path, name, kind, line_start,
       CAST(coalesce(lead(line_start) OVER (PARTITION BY file_path ORDER BY line_start) - 1, 0) AS INTEGER) AS line_end, CAST(NULL AS VARCHAR) AS signature
FROM (SELECT repo_name, file_path, line AS line_start,
             CASE WHEN regexp_matches(text, '^[A-Z][A-Za-z0-9_]{6,}') THEN 'Class'
                  WHEN regexp_matches(text, '^[A-Z][A-Za-z0-9_]{3,5}([^A-Za-z0-9_]|$)') THEN 'Method'
                  WHEN regexp_matches(text, '^[A-Z][A-Za-z0-9_]{1,2}([^A-Za-z0-9_]|$)') THEN 'Field' END AS kind,
             regexp_extract(text, '^([A-Z][A-Za-z0-9_]+)', 1) AS name
      FROM lines WHERE language IN ('en', 'de', 'fr', 'es'))
WHERE kind IS NOT NULL""",
    "psym": """
SELECT CAST(p_partkey AS VARCHAR) AS id, 'parts' AS repo_name, '/' || p_brand || '/' || p_type AS file_path, p_name AS name, p_type AS kind,
       p_size AS line_start, p_size + 9 AS line_end, p_brand AS signature FROM part""",
    "prefs": """
SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS symbol_id, '/' || p_brand || '/' || p_type AS in_file, 'parts' AS repo_name,
       CAST(p_size + l_linenumber AS INTEGER) AS line, 'order ' || l_orderkey AS context
FROM lineitem JOIN part ON p_partkey = l_orderkey % (SELECT count(*) FROM part)""",
    "pfiles": "SELECT 'parts' AS repo_name, '/' || p_brand || '/' || p_type AS file_path, p_type AS language, CAST(count(*) AS INTEGER) AS symbol_count FROM part GROUP BY p_brand, p_type",
    "wfiles": "SELECT 'web' AS repo_name, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS file_path, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS language, html AS content FROM pages",
    "wimports": "SELECT DISTINCT repo_name, file_path AS from_file, unnest(regexp_extract_all(content, 'href=\"(/[^\"]*)\"', 1)) AS to_file FROM wfiles",
    "commits": "SELECT 'orders' AS repo_name, CAST(o_orderkey AS VARCHAR) AS commit_id, CAST(o_custkey AS VARCHAR) AS author_name, o_orderdate AS author_date_utc, o_orderpriority AS subject FROM orders",
    "cfiles": """
SELECT 'orders' AS repo_name, CAST(l_orderkey AS VARCHAR) AS commit_id, CAST(l_partkey AS VARCHAR) AS path,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey // 2 AS VARCHAR) END AS prev_path, CASE l_returnflag WHEN 'N' THEN 'M' ELSE l_returnflag END AS status,
       CAST(l_quantity AS INTEGER) AS inserted, CAST(l_linenumber AS INTEGER) AS deleted FROM lineitem""",
    "cedges": "SELECT DISTINCT CAST(p AS VARCHAR) AS parent_commit_id, CAST(o_orderkey AS VARCHAR) AS child_commit_id FROM (SELECT o_orderkey, unnest([o_orderkey // 2, o_orderkey // 3]) AS p FROM orders WHERE o_orderkey > 0)",
    "pimports": "SELECT DISTINCT r.in_file AS from_file, y.file_path AS to_file FROM prefs r JOIN psym y ON y.id = r.symbol_id WHERE r.in_file <> y.file_path",
    "gnodes": """
SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority FROM orders
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part""",
    "gedges": """
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type FROM nation UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'references' FROM orders UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'imports' FROM lineitem""",
    "encl": """
SELECT file_path, line, id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY outside, CASE WHEN outside = 0 THEN span ELSE 0 END, line_start DESC, id) AS rn FROM (
SELECT p.*, y.id, CASE WHEN p.line <= y.line_end THEN 0 ELSE 1 END AS outside, y.line_start, y.line_end - y.line_start AS span
FROM (SELECT DISTINCT in_file AS file_path, line FROM prefs) p JOIN psym y ON y.file_path = p.file_path AND y.line_start <= p.line)) WHERE rn = 1""",
    "calls": "SELECT DISTINCT e.id AS caller, r.symbol_id AS callee, r.in_file, r.line FROM prefs r JOIN encl e ON e.file_path = r.in_file AND e.line = r.line WHERE e.id <> r.symbol_id",
    "pairs": "SELECT o_custkey AS query_id, CAST(min(o_orderkey) AS VARCHAR) AS left_commit, CAST(max(o_orderkey) AS VARCHAR) AS right_commit FROM orders GROUP BY o_custkey",
    "tel": """
SELECT event_id, ts, event_type AS endpoint, CAST(user_id % 4 AS VARCHAR) AS mode, 'events' AS project, value AS latency_ms,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS result_count, event_type = 'error' AS is_empty, event_type = 'signup' AS used_fallback FROM events""",
    "bench0": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v FROM events",
    "bench": """
SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type || '_' || (user_id % 10) AS scenario,
       'src/' || (user_id % 7) || CASE WHEN user_id % 2 = 0 THEN '.cs' ELSE '.rs' END AS fixture,
       CASE WHEN event_id % 2 = 0 THEN 'warm' ELSE 'cold' END AS temperature, event_type <> 'view' AS is_workflow,
       k AS baseline_count, CAST(k + event_id % 3 - 1 AS INTEGER) AS our_count, CASE WHEN event_id % 5 = 0 THEN 90.0::DOUBLE ELSE 100.0::DOUBLE END AS coverage_percent,
       CAST(event_id % 3 - 1 AS INTEGER) AS extra, CAST(v AS BIGINT) AS baseline_ms, CAST(k AS BIGINT) AS our_ms, v + 40 AS baseline_tokens, k AS our_tokens,
       CASE WHEN event_id % 4 = 0 THEN k + 5 END AS hybrid_tokens, 2 AS baseline_calls, 1 AS our_calls, CASE WHEN event_id % 4 = 0 THEN 2 END AS hybrid_calls,
       CASE WHEN event_type <> 'view' THEN event_id % 11 <> 0 END AS success,
       CASE event_type WHEN 'click' THEN 'history_latest_touch|hybrid:fallback' WHEN 'purchase' THEN 'resolve symbol' ELSE '' END AS notes, event_id FROM bench0""",
    "flags": """
SELECT *, coalesce(success, coverage_percent >= 100.0) AS passed, coalesce(baseline_tokens, 0) AS classic, coalesce(our_tokens, 0) AS compact,
       coalesce(hybrid_tokens, 0) AS hybrid, classic - compact AS compact_delta, classic - hybrid AS hybrid_delta, greatest(compact_delta, hybrid_delta) AS best_delta,
       CASE WHEN classic <= 0 THEN 0.0::DOUBLE ELSE CAST(round_even(best_delta * 100.0::DOUBLE / classic, 1) AS DOUBLE) END AS savings_pct,
       compact_delta < 0 OR hybrid_delta < 0 AS regression FROM bench""",
    "q1": "SELECT item_id AS query_id, string_split(text, ' ')[1] AS q FROM benchmark",
    "q2": "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS q FROM benchmark",
    "q3": "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM benchmark",
    "toks2": "SELECT DISTINCT query_id, q, lower(t) AS token FROM (SELECT query_id, q, unnest(string_split_regex(q, '[ \\t\\r\\n.:/\\\\\\-_()\\[\\]{},]+')) AS t FROM q2) WHERE length(t) >= 2",
    "pq": "SELECT row_number() OVER (ORDER BY p_name) AS query_id, p_name AS q FROM (SELECT DISTINCT p_name FROM part)",
}


def _deps(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def with_tables(sql: str) -> str:
    """``sql`` with the model tables it uses, and theirs, as common table expressions."""
    need: set[str] = set()
    todo = _deps(sql)
    while todo:
        t = todo.pop()
        if t not in need:
            need.add(t)
            todo += [d for d in _deps(TABLES[t]) if d != t]
    ctes = [f"{t} AS ({TABLES[t].strip()})" for t in TABLES if t in need]
    body = re.sub(r"^WITH\s+", "WITH ", sql.strip())
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
