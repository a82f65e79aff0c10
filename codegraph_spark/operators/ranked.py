"""Ranked retrieval over symbols and lines for batches of queries.

Candidates come from substring joins, are scored with native expressions and
cut to the requested number per query before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.functions.required import literal_texts, required_texts
from codegraph_spark.operators.linking import NameLinks, first_refs
from codegraph_spark.operators.lookup import SYMBOL_COLUMNS, in_repo, name_matches, source_context, symbol_filters
from codegraph_spark.plans import postings as grams
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.substring import LINE_GRAMS, contains_join
from codegraph_spark.plans.topk import best_one, top_k
from codegraph_spark.schemas import optional
from codegraph_spark.sources.scan import explode_lines

ITEM_COLUMNS = ["query_id", "id", "t", "n", "p", "l", "k", "sc", "rank"]


def _limit(req: DataFrame, default: int, hi: int) -> Column:
    return tx.clamp(optional(req, "limit", default).cast("int"), default, 1, hi)


def with_limit(req: DataFrame, default: int, hi: int) -> DataFrame:
    return req.withColumn("limit", _limit(req, default, hi))


def symbol_items(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id",
        F.concat(F.lit("symbol:"), "id").alias("id"),
        F.lit("s").alias("t"),
        F.col("name").alias("n"),
        F.col("file_path").alias("p"),
        F.col("line_start").alias("l"),
        F.col("kind").alias("k"),
        F.col("score").cast("int").alias("sc"),
        F.col("rank"),
    )


def symbol_order():
    return [F.lower("name"), F.col("file_path"), F.col("line_start"), F.col("id")]


def exact_lookup(symbols: DataFrame, req: DataFrame, limit: int = 12, max_limit: int = 40) -> DataFrame:
    """Symbols named exactly like the query, ignoring case; score 200."""
    r = with_limit(req, limit, max_limit).withColumn("_k", F.lower("q"))
    hits = symbols.select(*SYMBOL_COLUMNS, F.lower("name").alias("_k")).join(r, "_k")
    hits = hits.filter(in_repo(hits)).withColumn("score", F.lit(200))
    order = [F.lower("name"), F.lower("file_path"), F.col("line_start"), F.col("id")]
    return symbol_items(top_k(hits, ["query_id"], order, max_limit, F.col("limit")))


def exact_symbols(symbols: DataFrame, req: DataFrame) -> DataFrame:
    """The unlimited form of exact lookup."""
    hits = symbols.select(*SYMBOL_COLUMNS, F.lower("name").alias("_k")).join(req.withColumn("_k", F.lower("q")), "_k")
    return hits.filter(in_repo(hits)).select("query_id", *SYMBOL_COLUMNS)


def token_candidates(symbols: DataFrame, req: DataFrame, tokens: Column, per_token: int | None = None) -> DataFrame:
    """Distinct (query, symbol) pairs where the name contains any token of the query.

    ``per_token`` keeps the first hits of each token by (file, line, id).
    """
    asked = req.withColumn("_token", F.explode(tokens))
    hits = name_matches(symbols, asked, "_token")
    if per_token:
        hits = top_k(hits, ["query_id", "_token"], ["file_path", "line_start", "id"], per_token, rank="_place").drop("_place")
    return hits.drop("_token").dropDuplicates(["query_id", "id"])


def _scored(hits: DataFrame, scorer: str, tokens: Column) -> DataFrame:
    points = tx.score(scorer, F.col("name"), F.col("signature"), F.col("file_path"), F.col("q"), tokens)
    return hits.withColumn("score", points).filter("score > 0")


def fuzzy_symbols(symbols: DataFrame, req: DataFrame, limit: int = 20, max_limit: int = 50) -> DataFrame:
    """Symbols matching any token of the query under the query weights, best first."""
    r = with_limit(req.withColumn("q", tx.trim(F.col("q"))), limit, max_limit)
    toks = tx.tokenize(F.col("q"))
    hits = token_candidates(symbols, r, toks)
    hits = _scored(hits.filter(symbol_filters(hits)), "query", toks)
    best = top_k(hits, ["query_id"], [F.col("score").desc(), *symbol_order()], max_limit, F.col("limit"))
    return best.select("query_id", *SYMBOL_COLUMNS, F.col("score").cast("int").alias("score"), "rank")


def fuzzy_query(symbols: DataFrame, lines: DataFrame, req: DataFrame, limit: int = 20, radius: int = 6, files: DataFrame | None = None) -> DataFrame:
    """Fuzzy symbols with the context of the first ten; snippet search where none match.

    One row per result: ``result`` is symbol, snippet or fallback.
    """
    # a bounded answer with several readers: computed once
    best = cut(fuzzy_symbols(symbols, req, limit))
    heads = best.filter("rank <= 10").select("query_id", "rank", "repo_name", "file_path", F.col("line_start").alias("line"))
    shown = source_context(lines if files is None else files, heads, radius, clamp_end=False).filter(F.col("context").isNotNull())
    sym = best.select(
        "query_id", F.lit("symbol").alias("result"), "rank", F.col("id"), F.col("file_path"), F.col("line_start").alias("line"),
        F.col("name"), F.col("signature"), "score", F.lit(None).cast("int").alias("from_line"), F.lit(None).cast("int").alias("to_line"),
        F.lit(None).cast("string").alias("context"),
    )
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    snip = lambda df, kind: df.select(
        "query_id", F.lit(kind).alias("result"), "rank", none("id", "string"), "file_path", "line", none("name", "string"),
        none("signature", "string"), none("score", "int"), F.col("from_line").cast("int"), F.col("to_line").cast("int"), "context",
    )
    missed = req.join(best.select("query_id").distinct(), "query_id", "left_anti").filter(F.size(tx.tokenize(F.col("q"))) > 0)
    fallback = snippet_search(lines, missed, limit, radius, files)
    return sym.unionByName(snip(shown, "snippet")).unionByName(snip(fallback, "fallback"))


def fuzzy_compact(symbols: DataFrame, req: DataFrame, limit: int = 12, max_limit: int = 80, per_token: int | None = None) -> DataFrame:
    """Compact fuzzy items under the compact weights; ``per_token`` (the original service: 200) bounds the candidates of a token."""
    r = with_limit(req, limit, max_limit)
    hits = token_candidates(symbols, r, tx.search_tokens(F.col("q")), per_token)
    hits = _scored(hits, "compact", tx.search_tokens(F.col("q")))
    return symbol_items(top_k(hits, ["query_id"], [F.col("score").desc(), *symbol_order()], max_limit, F.col("limit")))


def line_matches(lines: DataFrame, req: DataFrame, limit: int, max_limit: int) -> DataFrame:
    """The first lines by (file, line) that contain the query, ignoring case."""
    r = with_limit(req, limit, max_limit)
    hits = contains_join(lines, "text", r, "q", ["repo_name", "file_path", "line"], LINE_GRAMS, repeated=False)
    keep = in_repo(hits)
    if "path_prefix" in hits.columns:
        keep = keep & tx.path_matches(F.col("file_path"), F.col("path_prefix"))
    return top_k(hits.filter(keep), ["query_id"], ["file_path", "line"], max_limit, F.col("limit"))


def snippet_search(lines: DataFrame, req: DataFrame, limit: int = 20, radius: int = 6, files: DataFrame | None = None) -> DataFrame:
    """Case-insensitive line search with the lines around each hit, cut from ``files`` where they are given."""
    best = cut(line_matches(lines, req, limit, 50).select("query_id", "rank", "repo_name", "file_path", "line"))
    return source_context(lines if files is None else files, best, radius).select(
        "query_id", "rank", "file_path", "line", F.col("from_line").cast("int").alias("from_line"), F.col("to_line").cast("int").alias("to_line"), "context"
    )


def snippet_compact(lines: DataFrame, req: DataFrame, limit: int = 12, max_limit: int = 40) -> DataFrame:
    best = line_matches(lines, req, limit, max_limit)
    return best.select(
        "query_id",
        F.concat(F.lit("file:"), "file_path", F.lit(":"), F.col("line").cast("string")).alias("id"),
        F.lit("m").alias("t"),
        tx.basename(F.col("file_path")).alias("n"),
        F.col("file_path").alias("p"),
        F.col("line").alias("l"),
        F.col("language").alias("k"),
        F.lit(1).alias("sc"),
        "rank",
    )


def selected_symbol(symbols: DataFrame, req: DataFrame, scorer: str) -> DataFrame:
    """The best symbol whose name contains the whole query."""
    hits = name_matches(symbols, req)
    hits = hits.filter(symbol_filters(hits))
    points = tx.score(scorer, F.col("name"), F.col("signature"), F.col("file_path"), F.col("q"), tx.tokenize(F.col("q")))
    return best_one(hits.withColumn("score", points), ["query_id"], [F.col("score").desc(), *symbol_order()])


def references_query(symbols: DataFrame, refs: DataFrame, req: DataFrame, limit: int = 20, max_limit: int = 50) -> DataFrame:
    """References of the best symbol for each query, in (file, line) order."""
    r = with_limit(req, limit, max_limit)
    best = selected_symbol(symbols, r, "query").select("query_id", "limit", F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "score")
    hits = refs.join(best, "symbol_id")
    kept = top_k(hits, ["query_id"], ["in_file", "line", "context"], max_limit, F.col("limit"))
    return kept.select("query_id", "rank", "symbol_id", "symbol_name", "in_file", "repo_name", "line", "context")


def references_candidates(symbols: DataFrame, req: DataFrame) -> DataFrame:
    """The ten best symbols a references query chose among."""
    hits = name_matches(symbols, req)
    hits = hits.filter(symbol_filters(hits))
    points = tx.score("query", F.col("name"), F.col("signature"), F.col("file_path"), F.col("q"), tx.tokenize(F.col("q")))
    ranked = top_k(hits.withColumn("score", points), ["query_id"], [F.col("score").desc(), *symbol_order()], 10)
    return ranked.select("query_id", "rank", *SYMBOL_COLUMNS, F.col("score").cast("int").alias("score"))


def references_snippets(lines: DataFrame, references: DataFrame, radius: int = 6) -> DataFrame:
    """Context of the first ten references of each query."""
    heads = references.filter("rank <= 10").select("query_id", "rank", "repo_name", F.col("in_file").alias("file_path"), "line")
    return source_context(lines, heads, radius, clamp_end=False).filter(F.col("context").isNotNull())


def references_compact(symbols: DataFrame, refs: DataFrame | NameLinks, req: DataFrame, limit: int = 12, max_limit: int = 80) -> DataFrame:
    r = with_limit(req, limit, max_limit)
    best = selected_symbol(symbols, r, "compact").select("query_id", "limit", F.col("id").alias("symbol_id"), F.col("name").alias("n"))
    first = first_refs(refs, best, max_limit).join(best, "symbol_id")
    kept = first.filter(F.col("rank") <= F.col("limit"))
    return kept.select(
        "query_id",
        F.concat(F.lit("ref:"), "symbol_id", F.lit(":"), "in_file", F.lit(":"), F.col("line").cast("string")).alias("id"),
        F.lit("r").alias("t"),
        "n",
        F.col("in_file").alias("p"),
        F.col("line").alias("l"),
        F.lit("ref").alias("k"),
        F.lit(1).alias("sc"),
        "rank",
    )


STAGES = ("exact", "fuzzy", "snippet")


def resolve_chain(symbols: DataFrame, lines: DataFrame, req: DataFrame, limit: int = 12, max_limit: int = 40) -> DataFrame:
    """Exact, else fuzzy, else snippet items: the first stage that answers a query wins.

    A later stage only runs over the queries the earlier ones left open.
    """
    r = with_limit(req, limit, max_limit).filter(~tx.is_blank(F.col("q")))
    exact = cut(exact_lookup(symbols, r, limit, max_limit))
    open_1 = r.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    fuzzy = cut(fuzzy_compact(symbols, open_1, limit, max_limit))
    open_2 = open_1.join(fuzzy.select("query_id").distinct(), "query_id", "left_anti")
    snippet = snippet_compact(lines, open_2, limit, max_limit)
    staged = None
    for stage, items in zip(STAGES, (exact, fuzzy, snippet)):
        rows = items.select(*ITEM_COLUMNS).withColumn("stage", F.lit(stage))
        staged = rows if staged is None else staged.unionByName(rows)
    return staged


def impact_expand(symbols: DataFrame, refs: DataFrame | NameLinks, req: DataFrame, max_items: int = 30, hi: int = 80) -> DataFrame:
    """Fuzzy items, then reference items not yet present, up to the requested number."""
    r = req.withColumn("limit", tx.clamp(optional(req, "max_items", max_items).cast("int"), max_items, 1, hi))
    mode = tx.one_of(optional(req, "mode", "impact").cast("string"), ("references", "impact"), "plain")
    fuzzy = fuzzy_compact(symbols, r, max_items, hi).withColumn("_part", F.lit(0))
    expand = r.filter(mode != "plain")
    extra = references_compact(symbols, refs, expand, max_items, hi).withColumn("_part", F.lit(1))
    both = fuzzy.unionByName(extra)
    first = best_one(both, ["query_id", F.lower("id"), "p", "l"], ["_part", "rank"])
    merged = top_k(first.withColumnRenamed("rank", "_place"), ["query_id"], ["_part", "_place"], hi)
    caps = r.select("query_id", F.col("limit").alias("_cap"))
    return merged.join(caps, "query_id").filter(F.col("rank") <= F.col("_cap")).select(*ITEM_COLUMNS)


def semantic_search(symbols: DataFrame, req: DataFrame, limit: int = 20, max_limit: int = 200, per_token: int | None = None) -> DataFrame:
    r = with_limit(req.withColumn("q", tx.trim(F.col("q"))), limit, max_limit)
    hits = token_candidates(symbols, r, tx.tokenize(F.col("q")), per_token)
    hits = _scored(hits, "semantic", tx.tokenize(F.col("q")))
    return symbol_items(top_k(hits, ["query_id"], [F.col("score").desc(), *symbol_order()], max_limit, F.col("limit")))


PATTERNS_PER_SCAN = 64


def _pattern_scan(lines: DataFrame, patterns, probe) -> DataFrame:
    """One pass over the lines per ``PATTERNS_PER_SCAN`` patterns.

    Patterns are literals, so each is compiled once; lines are never shuffled
    or paired with a pattern table.  Lines with ``_may`` are tried with the
    patterns of those numbers only.
    """
    out = None
    some = "_may" in lines.columns
    for at in range(0, len(patterns), PATTERNS_PER_SCAN):
        probes = [(i, probe(patterns[i])) for i in range(at, min(at + PATTERNS_PER_SCAN, len(patterns)))]
        hits = F.array_compact(F.array(*[F.when(F.array_contains("_may", i), p) if some else p for i, p in probes]))
        rows = lines.withColumn("_m", F.explode(hits))
        out = rows if out is None else out.unionByName(rows)
    return out


def _regex(pattern: str, ignore_case: bool = False, multi_line: bool = False) -> str:
    flags = ("i" if ignore_case else "") + ("m" if multi_line else "")
    return f"(?{flags}){pattern}" if flags else pattern


def _check_pattern(spark, pattern: str) -> None:
    """A pattern that does not compile is an error before any scan starts."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as err:
        raise ValueError(f"Invalid regex: {pattern}") from err


def _first_files(hits: DataFrame, max_files: int | None, files: DataFrame | None) -> DataFrame:
    if max_files is None or files is None:
        return hits
    first = files.select("file_path").distinct().orderBy("file_path").limit(max_files)
    return hits.join(first, "file_path", "left_semi")


def _repo(lines: DataFrame) -> list[str]:
    """Files of one path in two repos are told apart where lines name their repo."""
    return ["repo_name"] if "repo_name" in lines.columns else []


def regex_scan(lines: DataFrame, patterns, max_matches: int | None = None, max_files: int | None = None, path_prefix: str | None = None) -> DataFrame:
    """Lines matching each ``(query_id, pattern, ignore_case)``; the first matches by (file, repo, line)."""
    src = lines.filter(tx.path_matches(F.col("file_path"), F.lit(path_prefix))) if path_prefix else lines

    def probe(p):
        query_id, pattern, ignore_case = (*p, False)[:3]
        rx = _regex(pattern, ignore_case)
        _check_pattern(lines.sparkSession, rx)
        return F.when(F.col("text").rlike(rx), F.struct(F.lit(query_id).cast("long").alias("query_id")))

    hits = _first_files(_pattern_scan(src, list(patterns), probe), max_files, src)
    repo = _repo(lines)
    found = hits.select("_m.query_id", *repo, "file_path", "line", tx.truncate(tx.trim(F.col("text")), 240).alias("text"))
    return top_k(found, ["query_id"], ["file_path", *repo, "line"], max_matches)


def rg_search(
    lines: DataFrame, patterns, max_matches: int | None = None, max_line_length: int = 240, max_files: int | None = None, root: str = "/", path_prefix: str | None = None
) -> DataFrame:
    """Regex or literal search with the 1-based column of the first match.

    ``patterns`` holds (query_id, mode, pattern, ignore_case).
    """
    src = lines.filter(tx.project_path_matches(F.col("file_path"), F.lit(root), F.lit(path_prefix))) if path_prefix else lines

    def probe(p):
        query_id, mode, pattern, ignore_case = p
        if mode not in ("regex", "literal"):
            raise ValueError("'mode' must be 'regex' or 'literal'.")
        if mode == "regex":
            rx = _regex(pattern, ignore_case)
            _check_pattern(lines.sparkSession, rx)
            col = F.regexp_instr("text", F.lit(rx))
        else:
            hay, needle = (F.lower("text"), pattern.lower()) if ignore_case else (F.col("text"), pattern)
            col = F.nullif(F.locate(needle, hay), F.lit(0))
        return F.when(col > 0, F.struct(F.lit(query_id).cast("long").alias("query_id"), col.cast("int").alias("col")))

    hits = _first_files(_pattern_scan(src, list(patterns), probe), max_files, src)
    repo = _repo(lines)
    found = hits.select("_m.query_id", *repo, "file_path", "line", "_m.col", tx.truncate(tx.trim(F.col("text")), max_line_length).alias("text"))
    return top_k(found, ["query_id"], ["file_path", *repo, "line"], max_matches)


def indexed_scan(scan, files: DataFrame, postings: DataFrame, patterns, **options) -> DataFrame:
    """``scan`` (``regex_scan`` or ``rg_search``) over the files that can hold a match, by their gram postings.

    The rows are those of the scan over all lines of ``files``. Patterns of which no text of three characters is required read every line.
    """
    patterns = list(patterns)
    if scan is rg_search:
        needs = [literal_texts(p[2], p[3]) if p[1] == "literal" else required_texts(p[2]) for p in patterns]
    else:
        needs = [required_texts(p[1]) for p in patterns]
    met = [i for i, texts in enumerate(needs) if grams.grams_of(texts)]
    rest = [p for i, p in enumerate(patterns) if i not in set(met)]
    parts = []
    if met:
        lines = grams.candidate_lines(files, postings, {at: needs[i] for at, i in enumerate(met)})
        parts.append(scan(lines, [patterns[i] for i in met], **options))
    if rest or not met:
        parts.append(scan(explode_lines(files), rest, **options))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def test_map(files: DataFrame, req: DataFrame, limit: int = 20, max_limit: int = 200) -> DataFrame:
    """Test files by the number of query tokens in their path; a file may score 0.

    Only the best files and, for zero scores, the first files by path can be
    answers, so queries meet the matched files plus one shared short list.
    """
    r = with_limit(req, limit, max_limit)
    seed = optional(r, "seed_name", None).cast("string")
    toks = tx.tokenize(F.coalesce("q", F.lit("")))
    toks = tx.distinct_ignore_case(F.when(F.length(seed) > 0, F.concat(toks, F.array(seed))).otherwise(toks))
    r = r.select("query_id", "limit", toks.alias("tokens"), optional(r, "repo", None).cast("string").alias("repo"))
    tests = files.filter(
        F.contains(F.lower("file_path"), F.lit("test")) | F.contains(F.lower("file_path"), F.lit("spec"))
    ).select("repo_name", "file_path").distinct()
    hits = contains_join(tests, "file_path", r.withColumn("_t", F.explode("tokens")), "_t", ["repo_name", "file_path"])
    scored = hits.filter(in_repo(hits)).groupBy("query_id", "limit", "file_path").agg(F.count_distinct(F.lower("_t")).cast("int").alias("score"))
    first = tests.groupBy("repo_name", "file_path").agg(F.lit(0).alias("score"))
    first = top_k(first, ["repo_name"], [F.lower("file_path"), "file_path"], 2 * max_limit).drop("rank")
    # requests without a repo meet the first files of all repos, which stand under a name no repo has
    anywhere = top_k(first.withColumn("_all", F.lit(0)), ["_all"], [F.lower("file_path"), "file_path"], 2 * max_limit).select(F.lit("").alias("repo_name"), "file_path", "score")
    first = first.unionByName(anywhere.dropDuplicates(["file_path"]))
    padded = first.join(r.withColumn("repo_name", F.coalesce("repo", F.lit(""))).drop("repo"), "repo_name")
    zeros = padded.join(scored.select("query_id", "file_path"), ["query_id", "file_path"], "left_anti")
    every = scored.unionByName(zeros.select("query_id", "limit", "file_path", "score"))
    return top_k(every, ["query_id"], [F.col("score").desc(), F.lower("file_path"), "file_path"], max_limit, F.col("limit")).select(
        "query_id", "rank", "file_path", "score"
    )


def query_envelope(results: DataFrame, req: DataFrame, mode: str) -> DataFrame:
    """Per query: count, summary, confidence, token estimate and whether a fallback was used.

    ``results`` needs ``query_id``, ``chars`` and may have ``is_fallback``.
    """
    fb = F.max(optional(results, "is_fallback", False)) if "is_fallback" in results.columns else F.lit(False)
    agg = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), fb.alias("fallback_used"))
    n = F.coalesce("n", F.lit(0))
    num = n.cast("string")
    fallback = F.coalesce("fallback_used", F.lit(False))
    summary, confidence = {
        "snippet": (
            F.when(n == 0, F.lit("No matching code portions were found.")).otherwise(F.concat(F.lit("Found "), num, F.lit(" snippet match(es)."))),
            F.when(n == 0, F.lit("low")).otherwise(F.lit("high")),
        ),
        "fuzzy": (
            F.when(fallback | (n == 0), F.lit("No symbol-level fuzzy matches found; returning snippet fallback.")).otherwise(
                F.concat(F.lit("Found "), num, F.lit(" fuzzy symbol match(es)."))
            ),
            F.when(n == 0, F.lit("low")).when(fallback | (n >= 3), F.lit("high")).otherwise(F.lit("medium")),
        ),
        "references": (
            F.when(n == 0, F.lit("No matching symbol found for reference lookup.")).otherwise(F.concat(F.lit("Resolved with "), num, F.lit(" reference(s)."))),
            F.when(n == 0, F.lit("low")).otherwise(F.lit("high")),
        ),
    }[mode]
    return req.select("query_id", "q").join(agg, "query_id", "left").select(
        "query_id",
        F.lit(mode).alias("mode"),
        "q",
        summary.alias("summary"),
        confidence.alias("confidence"),
        n.cast("long").alias("result_count"),
        F.greatest(F.lit(1), F.floor((F.coalesce("chars", F.lit(0)) + F.length(summary)) / 4)).cast("long").alias("tokens"),
        fallback.alias("fallback_used"),
    )
