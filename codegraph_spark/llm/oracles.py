"""SQL that the queries of this subpackage must agree with, where SQL can say it."""

from __future__ import annotations

from codegraph_spark.llm import chat, licenses, linedups, mixing


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan(k: int = licenses.K, gap: int = 3, coverage: float = 0.8) -> str:
    all_templates = [*((a, b, True) for a, b in licenses.PHRASES), *((a, b, False) for a, b in licenses.NOTICES)]
    values = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)}, {exact})" for i, (label, text, exact) in enumerate(all_templates))
    gram = lambda i: " || ' ' || ".join(f"w[{i} + {j}]" for j in range(1, k + 1))
    words = r"regexp_extract_all(lower(replace(replace({t}, 'K', 'ß'), 'İ', 'ß')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    names = lambda f: f"coalesce(array_to_string(list_sort(list_distinct(list(label){f})), ','), '')"
    return f"""
WITH t AS (SELECT template, label, exact, {words.format(t='txt')} AS w FROM (VALUES {values}) x(template, label, txt, exact)),
tg AS (SELECT template, label, exact, len(w) - {k - 1} AS n_grams, len(w) AS tn, i AS spot, {gram('i')} AS gram FROM (SELECT *, unnest(range(len(w) - {k - 1})) AS i FROM t)),
dw AS (SELECT doc_id, {words.format(t="coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, i AS pos, {gram('i')} AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS i FROM dw)),
d AS (SELECT doc_id, template, label, exact, n_grams, tn, pos - spot AS diagonal, list(DISTINCT spot) AS met, min(pos) AS f, max(pos) AS l FROM dg JOIN tg USING (gram) GROUP BY ALL),
r AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN exact THEN 0 ELSE {gap} END THEN 1 ELSE 0 END AS new FROM d),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM r),
m AS (SELECT doc_id, template, label, exact, n_grams, tn, run, len(list_distinct(flatten(list(met)))) AS hits, min(f) AS s, max(l) + {k} AS e FROM r2 GROUP BY ALL),
ok AS (SELECT *, hits / n_grams AS cov FROM m WHERE CASE WHEN exact THEN hits = n_grams AND e - s = tn ELSE hits / n_grams >= {coverage} AND e - s <= 1.5 * tn + {gap} END),
a AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(s) FILTER (exact) AS first_word, max(s) FILTER (exact) AS last_word, {names(' FILTER (exact)')} AS base_labels, {names('')} AS labels, max(cov) AS score FROM ok GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM dw LEFT JOIN a USING (doc_id)"""


def line_dedup() -> str:
    return rf"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
y AS (SELECT doc_id, raw, line_no, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9@]') THEN '<*>' ELSE w END) AS tokens FROM x),
l AS (SELECT doc_id, line_no, tokens, len(tokens) || ' ' || array_to_string(tokens[1:{linedups.DEPTH}], ' ') AS leaf, array_to_string(tokens, ' ') AS line FROM y WHERE len(tokens) >= {linedups.MIN_TOKENS}),
leaves AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT doc_id) > 1),
u AS (SELECT leaf, line, any_value(tokens) AS tokens, count(*) AS weight FROM l JOIN leaves USING (leaf) GROUP BY leaf, line),
v AS (SELECT leaf, spot, token, sum(weight) AS n FROM (SELECT leaf, weight, unnest(tokens) AS token, unnest(range(len(tokens))) AS spot FROM u) GROUP BY ALL),
p AS (SELECT leaf, spot, token FROM (SELECT *, row_number() OVER (PARTITION BY leaf, spot ORDER BY n DESC, token DESC) AS rn FROM v) WHERE rn = 1),
s AS (SELECT leaf, line, count(*) FILTER (e.token = p.token) >= {linedups.SIMILARITY} * count(*) AS fits FROM (SELECT leaf, line, unnest(tokens) AS token, unnest(range(len(tokens))) AS spot FROM u) e JOIN p USING (leaf, spot) GROUP BY leaf, line),
m AS (SELECT l.doc_id, l.line_no, CASE WHEN s.fits THEN s.leaf ELSE s.leaf || chr(10) || s.line END AS template FROM l JOIN s USING (leaf, line)),
r AS (SELECT template, min(doc_id) AS first FROM m GROUP BY template HAVING count(DISTINCT doc_id) >= {linedups.MIN_DOCS}),
gone AS (SELECT doc_id, line_no FROM m JOIN r USING (template) WHERE doc_id <> first),
kept AS (SELECT x.doc_id, string_agg(raw, chr(10) ORDER BY x.line_no) AS text FROM x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.line_no = x.line_no GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def chat_format() -> str:
    escaped = lambda c: f"replace({c}, '\\', '\\\\')"

    def esc(c: str) -> str:
        out = escaped(c)
        for x in chat.CONTROLS:
            out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
        return out

    role = f"replace({esc('role')}, chr(10), '\\n')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (VALUES (0), (1)) v(t)),
w AS (SELECT *, length({role}) + 1 + length({esc('text')}) + CASE role WHEN 'assistant' THEN 7 ELSE 13 END AS n FROM c),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


def mix_sources(share: float, epochs: int, weights: dict, seed: int = mixing.SEED) -> str:
    def weight(level: str) -> str:
        given = weights.get(level, {})
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1.0 END" if given else "1.0"

    def level(name: str, source: str, parents: str, own: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        return f"""
{name}0 AS (SELECT *, {weight(own)}::DOUBLE AS wt FROM {source}),
{name}1 AS (SELECT *, supply / wt AS ratio, (pb - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
       FROM {name}0 WINDOW w AS ({by} ORDER BY supply / wt, {own})),
{name} AS (SELECT a.*, CASE WHEN f.lev IS NULL OR a.ratio < f.ratio THEN a.supply ELSE least(a.supply, greatest(f.lev, 0) * a.wt) END AS budget
       FROM {name}1 a LEFT JOIN (SELECT {parents + ',' if parents else ''} min(ratio) AS ratio, arg_min(lev, ratio) AS lev FROM {name}1 WHERE lev < ratio {'GROUP BY ' + parents if parents else ''}) f ON {' AND '.join(f'f.{p} = a.{p}' for p in parents.split(', ')) if parents else 'true'})"""

    return rf"""
WITH rows AS (SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'short' ELSE 'long' END AS domain, lang AS language, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
base AS (SELECT domain, language, source, sum(n_tokens) AS leaf_tokens, (sum(n_tokens) * {epochs})::DOUBLE AS supply FROM rows GROUP BY ALL),
b1 AS (SELECT domain, sum(supply) AS supply, (SELECT floor(sum(leaf_tokens) * {share}) FROM base)::DOUBLE AS pb FROM base GROUP BY domain),
{level('d', 'b1', '', 'domain').strip()},
b2 AS (SELECT b.domain, language, sum(b.supply) AS supply, any_value(d.budget) AS pb FROM base b JOIN d USING (domain) GROUP BY b.domain, language),
{level('g', 'b2', 'domain', 'language').strip()},
b3 AS (SELECT b.*, g.budget AS pb FROM base b JOIN g USING (domain, language)),
{level('s', 'b3', 'domain, language', 'source').strip()},
plan AS (SELECT domain, language, source, leaf_tokens, floor(round(budget, 6)) AS allotted, CASE WHEN leaf_tokens > 0 THEN floor(floor(round(budget, 6)) / leaf_tokens) ELSE {epochs} END AS full_epochs FROM s),
e AS (SELECT r.*, p.full_epochs, allotted - full_epochs * leaf_tokens AS rest FROM rows r JOIN plan p USING (domain, language, source)),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY md5('{seed}:' || CAST(full_epochs AS BIGINT) || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e WHERE rest > 0)
SELECT doc_id, unnest(range(CAST(full_epochs AS BIGINT))) AS epoch, domain, language, source, n_tokens FROM e
UNION ALL SELECT doc_id, CAST(full_epochs AS BIGINT), domain, language, source, n_tokens FROM part WHERE upto <= rest"""


# CRC-32 of a short ASCII text, byte by byte over a table made from the polynomial
CRC = """crc_table AS (SELECT list(list_reduce(list_prepend(i, list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc32(digits: str) -> str:
    codes = f"list_transform(string_split({digits}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def merkle() -> str:
    """Trees and proofs level by level."""
    put = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({put('doc_id')} || {put('source')} || {put('lang')} || {put(n)} || {put('text')})"

    def levels(name: str, base: str) -> str:
        return f"""{name}(run, lvl, i, n, h) AS (SELECT run, 0, CAST(pos AS BIGINT), CAST(size AS BIGINT), h FROM {base} UNION ALL
    SELECT run, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY run, lvl, i // 2, n)"""

    def climb(name: str, base: str, tree: str) -> str:
        step = "CASE WHEN s.h IS NULL THEN {a} WHEN u.i % 2 = 1 THEN s.h || {a} ELSE {a} || s.h END".format(a="u.acc")
        return f"""{name}(id, run, lvl, i, n, acc, sibs) AS (SELECT id, run, 0, CAST(pos AS BIGINT), CAST(size AS BIGINT), acc, sibs FROM {base} UNION ALL
    SELECT u.id, u.run, u.lvl + 1, u.i // 2, (u.n + 1) // 2, sha256({step}), u.sibs || coalesce(s.h, '')
    FROM {name} u LEFT JOIN {tree} s ON s.run = u.run AND s.lvl = u.lvl AND s.i = xor(u.i, 1) WHERE u.n > 1)"""

    return f"""
WITH RECURSIVE {CRC},
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS run, {leaf('n_chars')} AS h, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS given FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY run) AS size FROM d),
{levels('low', 'p')},
subs AS (SELECT '' AS run, run AS sub, h, row_number() OVER (ORDER BY run) - 1 AS pos, count(*) OVER () AS size FROM low WHERE n = 1),
{levels('high', 'subs')},
{climb('up', "(SELECT id, run, pos, size, given AS acc, '' AS sibs FROM p)", 'low')},
{climb('over_', "(SELECT u.id, '' AS run, s.pos, s.size, u.acc, u.sibs FROM up u JOIN subs s ON s.sub = u.run WHERE u.n = 1)", 'high')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(o.sibs) AS proof_sha256, o.acc AS folded_root, o.acc = r.h AS verified
FROM p JOIN subs s ON s.sub = p.run JOIN (SELECT h FROM high WHERE n = 1) r ON true JOIN over_ o ON o.id = p.id AND o.n = 1"""


def prefix_trie(every: int = 100, most: int = 6) -> str:
    return f"""
WITH RECURSIVE {CRC},
c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations),
ids AS (SELECT conv_id, {_crc32('CAST(conv_id AS VARCHAR)')} % {most} AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc_table),
r AS (SELECT i.conv_id, 0 AS side, place, role, text FROM ids i JOIN c ON c.conv_id = i.conv_id - i.conv_id % {every} AND place <= h
      UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN c ON c.conv_id = i.conv_id AND place > h),
q AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS len, sha256(strlen(role) || ':' || role || text) AS said, count(*) OVER (PARTITION BY conv_id) AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, place)),
walk(conv_id, depth, n, len, node, up) AS (SELECT conv_id, CAST(0 AS BIGINT), coalesce(m, 0), CAST(0 AS BIGINT), sha256(''), CAST(NULL AS VARCHAR) FROM ids LEFT JOIN (SELECT conv_id, count(*) AS m FROM r GROUP BY conv_id) USING (conv_id) UNION ALL
      SELECT w.conv_id, q.depth, w.n, q.len, sha256(w.node || q.said), w.node FROM walk w JOIN q ON q.conv_id = w.conv_id AND q.depth = w.depth + 1),
nodes AS (SELECT node, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(len) AS len, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends FROM walk GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * len AS saved FROM nodes n LEFT JOIN kids USING (node)),
above(node, top) AS (SELECT node, node FROM own UNION ALL SELECT a.node, o.up FROM above a JOIN own o ON o.node = a.top WHERE o.up IS NOT NULL),
sums AS (SELECT top AS node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above JOIN own USING (node) GROUP BY top)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends AS ends_sha256
FROM own o JOIN sums USING (node) LEFT JOIN nodes p ON p.node = o.up"""


def decontaminate(window: int) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i + 1 : i + {window}], ' ') AS gram, least(len(w), {window}) AS k FROM (SELECT item, w, unnest(range(greatest(len(w) - {window - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
g AS (SELECT id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hits AS (SELECT g.id, g.i, g.k, win.item FROM g JOIN win USING (gram, k)),
spots AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + k)) AS spot FROM hits) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (id) LEFT JOIN its USING (id)"""
