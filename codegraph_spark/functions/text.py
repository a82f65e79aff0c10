"""Text, path, scoring and number helpers; every one is a Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_CHAR = r"[\p{L}\p{M}\p{N}_]"
TOKEN_SPLIT = r"[ \t\r\n.:/\\\-_()\[\]{},]+"
LINE_BREAK = r"\r\n|\n|\r"
WHITESPACE = " \t\r\n\f\x0b"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(trim(c)) == 0)


def distinct_ignore_case(arr: Column) -> Column:
    """Ordered distinct of a string array ignoring case; the first spelling stays."""
    lowered = F.transform(arr, F.lower)
    return F.filter(arr, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def tokenize(q: Column) -> Column:
    """Split on separators, keep tokens of two or more characters, distinct ignoring case."""
    parts = F.filter(F.split(q, TOKEN_SPLIT), lambda t: F.length(t) >= 2)
    return distinct_ignore_case(parts)


def search_tokens(q: Column, take: int | None = None) -> Column:
    """``tokenize`` with the whole query as the only token when nothing is left."""
    toks = tokenize(q)
    toks = F.when(F.size(toks) == 0, F.array(q)).otherwise(toks)
    return F.slice(toks, 1, take) if take else toks


def est_tokens(*cols: Column, floor: int = 1) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.length(c), F.lit(0))
    return F.greatest(F.lit(floor), F.floor(total / 4).cast("int"))


def truncate(c: Column, n) -> Column:
    return F.left(c, F.lit(n) if isinstance(n, int) else n)


def lines_of(content: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    parts = F.split(content, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def prepare_snippet(s: Column, max_chars: Column, max_lines: Column) -> Column:
    lines = F.split(F.replace(s, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    cut = F.array_join(F.slice(lines, F.lit(1), max_lines), "\n")
    return F.when(is_blank(s), F.lit("")).otherwise(F.left(cut, max_chars))


def compact_title(kind: Column, name: Column, signature: Column) -> Column:
    suffix = F.when(is_blank(signature), F.lit("")).otherwise(F.left(F.concat(F.lit(" :: "), signature), F.lit(120)))
    return F.concat(kind, F.lit(": "), name, suffix)


def count_occurrences(s: Column, find: Column, ignore_case: bool | Column = False) -> Column:
    """Non-overlapping literal occurrences."""
    flag = F.lit(ignore_case) if isinstance(ignore_case, bool) else ignore_case
    hay = F.when(flag, F.lower(s)).otherwise(s)
    needle = F.when(flag, F.lower(find)).otherwise(find)
    removed = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
    n = F.floor(removed / F.length(needle)).cast("int")
    return F.when((F.coalesce(F.length(s), F.lit(0)) == 0) | (F.coalesce(F.length(find), F.lit(0)) == 0), F.lit(0)).otherwise(n)


def quote_regex(c: Column) -> Column:
    """A pattern that matches the text of ``c`` literally."""
    body = F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"\Q"), body, F.lit(r"\E"))


def nth_occurrence(s: Column, find: Column, n: Column) -> Column:
    """0-based offset of the n-th non-overlapping occurrence, -1 when absent."""
    parts = F.split(s, quote_regex(find), -1)
    head = F.array_join(F.slice(parts, F.lit(1), n), "")
    return F.when((n <= 0) | (F.size(parts) <= n), F.lit(-1)).otherwise(
        F.length(head) + (n - 1) * F.length(find)
    )


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normalize_path(path: Column) -> Column:
    return trim(F.replace(path, F.lit("\\"), F.lit("/")))


def normalize_relative(path: Column) -> Column:
    """Forward slashes, without leading ``./`` and ``/``."""
    return F.ltrim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), F.lit("/"))


def relpath(path: Column, root: Column) -> Column:
    base = F.rtrim(root, F.lit("/"))
    inside = F.startswith(F.lower(path), F.concat(F.lower(base), F.lit("/")))
    return F.when(inside, F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def canonical_path(path: Column) -> Column:
    """Absolute path with ``.`` dropped and each ``..`` folded into its parent."""
    segs = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when the file has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def strip_id_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(?:symbol|file):", "")


def icontains(hay: Column, needle: Column) -> Column:
    return F.contains(F.lower(hay), F.lower(needle))


def path_matches(path: Column, prefix: Column) -> Column:
    """Loose path filter: blank matches all, else the prefix occurs in the path."""
    return is_blank(prefix) | icontains(path, prefix)


def path_within(path: Column, scope: Column) -> Column:
    p, s = F.lower(F.rtrim(path, F.lit("/"))), F.lower(F.rtrim(scope, F.lit("/")))
    return (p == s) | F.startswith(p, F.concat(s, F.lit("/")))


def project_path_matches(path: Column, root: Column, prefix: Column) -> Column:
    rel = F.ltrim(normalize_path(prefix), F.lit("/"))
    return path_matches(path, prefix) | (F.length(rel) == 0) | icontains(relpath(path, root), rel)


def is_excluded(path: Column, excludes: Column) -> Column:
    p = F.lower(path)
    return F.exists(
        F.coalesce(excludes, F.array().cast("array<string>")),
        lambda x: F.contains(p, F.concat(F.lit("/"), F.lower(x), F.lit("/")))
        | F.endswith(p, F.concat(F.lit("/"), F.lower(x))),
    )


def _has(line: Column, token: Column, before: str, after: str) -> Column:
    return F.contains(line, F.concat(F.lit(before), token, F.lit(after)))


def is_call_like(line: Column, token: Column) -> Column:
    return _has(line, token, "", "(")


def is_type_like(line: Column, token: Column) -> Column:
    return _any(line, token, TYPE_SHAPES)


# Text around a token that marks a call, a type, a use of it (before, after).
CALL_SHAPES = [("", "(")]
TYPE_SHAPES = [(": ", ""), ("-> ", ""), ("<", ">"), (" ", " {")]
USAGE_SHAPES = [("", "("), (".", ""), ("::", ""), ("", "::"), ("<", ">"), (" ", "<"), (" ", " "), (": ", ""), ("= ", "")]


def _any(line: Column, token: Column, shapes) -> Column:
    cond = F.lit(False)
    for before, after in shapes:
        cond = cond | _has(line, token, before, after)
    return cond


def around(line: Column, shapes) -> Column:
    """The places of ``line`` where a run of name characters has one of the ``shapes``, one under the other.

    A token of name characters has a shape in the line exactly if it has it here. Long lines of prose have few such places, so testing
    each token of a line takes no time that grows with the square of the line.
    """
    found = []
    for before, after in shapes:
        start = "" if before else f"(?<!{NAME_CHAR})"
        pattern = f"{start}{re.escape(before)}{NAME_CHAR}++{re.escape(after)}"
        here = F.contains(line, F.lit(before if before.strip() else after))
        found.append(F.when(here, F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.concat(*found)), "\n")


def used_in(line: Column, tokens: Column) -> Column:
    """Those of the distinct ``tokens`` (runs of name characters) that have one of ``USAGE_SHAPES`` in the line; the line is read once."""
    shapes = [s for s in USAGE_SHAPES if s != (" ", " ")]
    words = F.split(line, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))  # what stands between two blanks
    given = F.struct(tokens.alias("tokens"), inner.alias("inner"), around(line, shapes).alias("near"))
    return bind(
        given,
        lambda g: F.concat(
            F.array_intersect(g["tokens"], g["inner"]), F.filter(F.array_except(g["tokens"], g["inner"]), lambda t: _any(g["near"], t, shapes))
        ),
    )


def clamp(x: Column, default, lo, hi) -> Column:
    """Clamp to [lo, hi]; a missing, zero or negative value means the default."""
    base = F.when(F.coalesce(x, F.lit(0)) <= 0, F.lit(default) if not isinstance(default, Column) else default).otherwise(x)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), base)).cast("int")


def best_delta(classic: Column, compact: Column, hybrid: Column) -> Column:
    return classic - F.least(compact, hybrid)


def savings_pct(classic: Column, compact: Column, hybrid: Column) -> Column:
    raw = best_delta(classic, compact, hybrid) * F.lit(100.0) / classic
    return F.when(classic <= 0, F.lit(0.0)).otherwise(F.bround(raw, 1)).cast("double")


def short_hash(c: Column) -> Column:
    return F.when(is_blank(c), F.lit("-")).otherwise(F.left(c, F.lit(7)))


def short_run(c: Column) -> Column:
    return F.left(c, F.lit(8))


def parse_time(c: Column) -> Column:
    """ISO-like date text to a timestamp; text that is no date gives null."""
    return F.try_to_timestamp(F.regexp_replace(c, r" ([+-]\d{2})(\d{2})$", "$1:$2"))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def one_of(c: Column, allowed, default: str) -> Column:
    """Trimmed lower-case value when it is allowed, else the default."""
    v = F.lower(trim(c))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def pack_mode(c: Column) -> Column:
    return one_of(c, ("impact", "implementation", "bug-trace"), "lookup")


def pack_format(c: Column) -> Column:
    return one_of(c, ("compact", "hybrid"), "full")


def compact_mode(c: Column) -> Column:
    return one_of(c, ("snippet", "references", "impact"), "fuzzy")


def edge_types(raw) -> list[str]:
    """Known edge types of a request; unknown ones drop out, an empty set is an error."""
    from codegraph_spark.schemas import EDGE_TYPES

    if raw is None:
        return ["contains", "imports", "references"]
    kept = [t for t in EDGE_TYPES if t in {str(x).lower() for x in raw}]
    if not kept:
        raise ValueError("At least one edge type is required.")
    return kept


def to_json(*cols) -> Column:
    return F.to_json(F.struct(*cols))


# Weights (exact, prefix, contains, token in name / signature / path).
SCORE_WEIGHTS = {
    "query": (100, 70, 50, 12, 6, 4),
    "compact": (100, 70, 50, 12, 6, 3),
    "pack": (140, 80, 48, 16, 8, 5),
    "semantic": (0, 0, 0, 4, 2, 1),
    "resolve": (300, 200, 100, 0, 0, 0),
}


def score(scorer: str, name: Column, signature: Column, path: Column, q: Column, tokens: Column) -> Column:
    """Relevance of one symbol to one query under the named weights."""
    exact, prefix, inside, in_name, in_sig, in_path = SCORE_WEIGHTS[scorer]
    n, k = F.lower(name), F.lower(q)
    whole = (
        F.when(n == k, F.lit(exact)).when(F.startswith(n, k), F.lit(prefix)).when(F.contains(n, k), F.lit(inside)).otherwise(F.lit(0))
    )
    if not (in_name or in_sig or in_path):
        return whole

    def points(t):
        t = F.lower(t)
        return (
            F.when(F.contains(n, t), F.lit(in_name)).otherwise(F.lit(0))
            + F.when(F.contains(F.lower(F.coalesce(signature, F.lit(""))), t), F.lit(in_sig)).otherwise(F.lit(0))
            + F.when(F.contains(F.lower(path), t), F.lit(in_path)).otherwise(F.lit(0))
        )

    return whole + F.aggregate(tokens, F.lit(0), lambda acc, t: acc + points(t))
