"""Index lookups: symbols, references, files, paths and seeds for batches of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.plans.substring import contains_join
from codegraph_spark.plans.topk import best_one
from codegraph_spark.schemas import SYMBOL_KINDS, check_kinds, optional

SYMBOL_COLUMNS = ["id", "repo_name", "file_path", "name", "kind", "line_start", "line_end", "signature"]


def in_repo(df: DataFrame, repo: str = "repo") -> Column:
    """Rows of the requested repo; a request without one matches every repo."""
    return optional(df, repo, None).isNull() | (F.lower("repo_name") == F.lower(optional(df, repo, None).cast("string")))


def name_matches(symbols: DataFrame, req: DataFrame, needle: str = "q") -> DataFrame:
    """Symbols whose name contains the needle, ignoring case, in the requested repo."""
    hits = contains_join(symbols.select(*SYMBOL_COLUMNS), "name", req, needle, ["id"])
    return hits.filter(in_repo(hits))


def symbols_by_name(symbols: DataFrame, req: DataFrame) -> DataFrame:
    return name_matches(symbols, req).select("query_id", *SYMBOL_COLUMNS)


def symbols_by_file(symbols: DataFrame, req: DataFrame) -> DataFrame:
    wanted = req.withColumn("_path", F.lower("path"))
    hits = symbols.withColumn("_path", F.lower("file_path")).join(wanted, "_path")
    return hits.filter(in_repo(hits)).select("query_id", *SYMBOL_COLUMNS)


def symbols_by_kind(symbols: DataFrame, kinds, q: str | None = None, repo: str | None = None, domain_check: bool = True) -> DataFrame:
    """Symbols of the given kinds; an unknown kind is an error."""
    names = check_kinds(kinds) if domain_check else list(kinds)
    out = symbols.filter(F.col("kind").isin(*names))
    if q:
        out = out.filter(tx.icontains(F.col("name"), F.lit(q)))
    if repo:
        out = out.filter(F.lower("repo_name") == repo.lower())
    return out.select(*SYMBOL_COLUMNS)


IMPLEMENTING_KINDS = ("Class", "Struct", "TraitImpl")


def implementors(symbols: DataFrame, req: DataFrame, kinds=IMPLEMENTING_KINDS) -> DataFrame:
    """Types and trait implementations whose name or signature holds the needle."""
    s = symbols.filter(F.col("kind").isin(*kinds)).select(*SYMBOL_COLUMNS)
    # NUL keeps a needle from matching across the two fields
    both = s.withColumn("_text", F.concat(F.col("name"), F.lit("\x00"), F.coalesce("signature", F.lit(""))))
    hits = contains_join(both, "_text", req, "q", ["id"])
    return hits.filter(in_repo(hits)).select("query_id", *SYMBOL_COLUMNS)


def references_of(refs: DataFrame, req: DataFrame) -> DataFrame:
    wanted = req.withColumn("symbol_id", tx.strip_id_prefix(F.col("symbol_id")))
    hits = refs.join(wanted, "symbol_id")
    return hits.filter(in_repo(hits)).select("query_id", "symbol_id", "in_file", "repo_name", "line", "context")


def dependents_of(file_imports: DataFrame, req: DataFrame) -> DataFrame:
    """Files that import the requested file."""
    wanted = req.withColumn("_to", F.lower("path"))
    hits = file_imports.withColumn("_to", F.lower("to_file")).join(wanted, "_to")
    return hits.filter(in_repo(hits)).select("query_id", "repo_name", F.col("from_file").alias("file_path")).distinct()


def file_catalog(files: DataFrame, req: DataFrame) -> DataFrame:
    """All files of the requested projects."""
    wanted = req.select(F.lower("repo").alias("_repo")).distinct()
    keep = [c for c in files.columns if c != "content"]
    return files.withColumn("_repo", F.lower("repo_name")).join(wanted, "_repo", "left_semi").select(*keep)


def file_node(files: DataFrame, file_imports: DataFrame, req: DataFrame) -> DataFrame:
    """One requested file with each file it imports (a null import when it has none)."""
    wanted = req.withColumn("_path", F.lower("path"))
    keep = [c for c in ("repo_name", "file_path", "language", "symbol_count") if c in files.columns]
    node = files.select(*keep, F.lower("file_path").alias("_path")).join(wanted.select("query_id", "_path"), "_path")
    imports = file_imports.select("repo_name", F.lower("from_file").alias("_path"), "to_file")
    return node.join(imports, ["repo_name", "_path"], "left").select("query_id", *keep, F.col("to_file").alias("imports"))


def _joined_lines(lines: DataFrame, spots: DataFrame, out: str) -> DataFrame:
    key = ["repo_name", "file_path"]
    asked = spots.withColumn("_at", F.explode(F.sequence("_lo", "_hi")))
    text = lines.select(*key, F.col("line").alias("_at"), "text")
    return (
        asked.join(text, [*key, "_at"])
        .groupBy(*key, "line", "_lo", "_hi")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "\n").alias(out),
            F.max("_at").alias("_last"),
        )
    )


def _cut_from_files(files: DataFrame, spots: DataFrame, out: str) -> DataFrame:
    key = ["repo_name", "file_path"]
    asked = spots.groupBy(*key).agg(F.collect_list(F.struct("line", "_lo", "_hi")).alias("_spots"))
    split = files.select(*key, "content").join(asked, key).select(*key, tx.lines_of(F.col("content")).alias("_lines"), "_spots")
    each = split.select(*key, "_lines", F.explode("_spots").alias("_s")).filter(F.col("_s._lo") <= F.size("_lines"))
    text = F.array_join(F.slice("_lines", F.col("_s._lo"), F.col("_s._hi") - F.col("_s._lo") + 1), "\n")
    return each.select(*key, "_s.line", "_s._lo", "_s._hi", text.alias(out), F.least(F.col("_s._hi"), F.size("_lines")).alias("_last"))


def source_context(lines: DataFrame, points: DataFrame, radius: int | Column = 20, out: str = "context", clamp_end: bool = True) -> DataFrame:
    """``points`` plus the text within ``radius`` lines, null when the file is missing.

    ``lines`` is a table of lines, of which each point asks for its few by
    (file, line), or of files (with ``content``): then only files that a point
    lies in are split, and the lines are cut out in the row.
    """
    r = F.lit(radius) if isinstance(radius, int) else radius
    key = ["repo_name", "file_path"]
    lo = F.greatest(F.lit(1), F.col("line") - r)
    spots = points.select(*key, "line", lo.alias("_lo"), (F.col("line") + r).alias("_hi")).distinct()
    got = _cut_from_files(lines, spots, out) if "content" in lines.columns else _joined_lines(lines, spots, out)
    joined = points.withColumn("_lo", lo).withColumn("_hi", F.col("line") + r).join(got, [*key, "line", "_lo", "_hi"], "left")
    return joined.withColumn("from_line", F.col("_lo")).withColumn(
        "to_line", F.coalesce("_last", "_hi") if clamp_end else F.col("_hi")
    ).drop("_lo", "_hi", "_last")


def _suffixes(path: Column) -> Column:
    """The path and each of its tails that start after a slash."""
    parts = F.split(F.ltrim(F.lower(path), F.lit("/")), "/")
    n = F.size(parts)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lower(path)), tails))


def resolve_path(files: DataFrame, req: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """``req(query_id, path[, repo])`` to one indexed path or an error.

    Absolute paths stay.  A relative path is the project root's file of that
    name, else the only file whose path ends with it.
    """
    r = req.select("query_id", "path", optional(req, "repo", None).cast("string").alias("repo"))
    rooted = F.startswith("path", F.lit("/"))
    asked = r.filter(~rooted & ~tx.is_blank(F.col("path"))).withColumn("_key", F.lower(tx.normalize_relative(F.col("path"))))
    tails = files.select(F.lower("repo_name").alias("_r"), "file_path", F.explode(_suffixes(F.col("file_path"))).alias("_key"))
    hits = (
        tails.join(asked, "_key")
        .filter(F.col("repo").isNull() | (F.col("_r") == F.lower("repo")))
        .groupBy("query_id")
        .agg(F.min("file_path").alias("_hit"), F.count_distinct(F.lower("file_path")).alias("_n"))
    )
    out = r.join(hits, "query_id", "left")
    exact = F.lit(None).cast("string")
    if projects is not None:
        roots = projects.select(F.lower("name").alias("_r"), F.col("path").alias("_root"))
        want = F.lower(F.concat(F.rtrim("_root", F.lit("/")), F.lit("/"), tx.normalize_relative(F.col("path"))))
        known = files.select(F.lower("repo_name").alias("_r"), F.lower("file_path").alias("_want"), F.col("file_path").alias("_exact")).distinct()
        out = (
            out.withColumn("_r", F.lower("repo")).join(roots, "_r", "left").withColumn("_want", want)
            .join(known, ["_r", "_want"], "left")
        )
        exact = F.col("_exact")
        unknown = F.col("repo").isNotNull() & F.col("_root").isNull() & ~rooted
    else:
        unknown = F.lit(False)
    n = F.coalesce("_n", F.lit(0))
    path = (
        F.when(tx.is_blank(F.col("path")) | unknown, F.lit(None))
        .when(rooted, tx.canonical_path(F.col("path")))
        .when(exact.isNotNull(), exact)
        .when(n == 1, F.col("_hit"))
    )
    error = (
        F.when(tx.is_blank(F.col("path")), F.lit("'path' is required."))
        .when(unknown, F.concat(F.lit("Project '"), "repo", F.lit("' is not registered.")))
        .when(rooted | exact.isNotNull() | (n == 1), F.lit(None))
        .when(n == 0, F.concat(F.lit("No indexed file matches path '"), "path", F.lit("'.")))
        .otherwise(F.concat(F.lit("Path '"), "path", F.lit("' is ambiguous across indexed files. Provide 'project' or an absolute path.")))
    )
    return out.select("query_id", path.alias("resolved_path"), error.alias("error"))


def resolve_file_seed(files: DataFrame, req: DataFrame, root: str = "/", excludes=()) -> DataFrame:
    """Best file for ``req(query_id, path)``; the shortest path wins a tie.

    Points: the rooted path 100, the seed as path or tail 80, the seed without
    leading dots and slashes 70, the same file name 30.
    """
    f = files.select("repo_name", "file_path").distinct()
    if excludes:
        f = f.filter(~tx.is_excluded(F.col("file_path"), F.array(*[F.lit(x) for x in excludes])))
    norm = F.lower(tx.normalize_path(F.col("path")))
    plain = F.lower(tx.normalize_path(F.ltrim("path", F.lit("./\\"))))
    rooted = F.when(F.startswith("path", F.lit("/")), norm).otherwise(F.concat(F.lit(root.rstrip("/").lower() + "/"), plain))
    asked = req.select("query_id", norm.alias("_seed"), plain.alias("_plain"), rooted.alias("_rooted"), F.lower(tx.basename(F.col("path"))).alias("_name"))
    # every scoring rule implies the same file name, so the name is the join key
    c = f.withColumn("_p", F.lower(tx.normalize_path(F.col("file_path")))).withColumn("_name", tx.basename(F.col("_p"))).join(asked, "_name")
    ends = lambda s: (F.col("_p") == s) | F.endswith("_p", F.concat(F.lit("/"), s))
    points = (
        F.when(F.col("_p") == F.col("_rooted"), 100).otherwise(0)
        + F.when(ends(F.col("_seed")), 80).otherwise(0)
        + F.when(ends(F.col("_plain")), 70).otherwise(0)
        + F.lit(30)
    )
    ranked = best_one(c.withColumn("score", points), ["query_id"], [F.col("score").desc(), F.length("_p"), "file_path"])
    return ranked.select("query_id", "repo_name", "file_path", "score")


def resolve_symbol_seed(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds(query_id[, id, name, kind, path_hint])`` to one symbol each.

    An exact id wins outright; else the best scored symbol among those whose
    name contains the seed's name, ties by path and line.
    """
    s = symbols.select(*SYMBOL_COLUMNS)
    opt = lambda n: optional(seeds, n, None).cast("string")
    ask = seeds.select(
        "query_id",
        tx.strip_id_prefix(opt("id")).alias("_id"),
        opt("name").alias("_name"),
        opt("kind").alias("_kind"),
        opt("path_hint").alias("_hint"),
    )
    by_id = (
        s.withColumn("_id", F.lower("id"))
        .join(ask.select("query_id", F.lower("_id").alias("_id")), "_id")
        .select("query_id", *SYMBOL_COLUMNS, F.lit(1_000_000).alias("score"))
    )
    named = contains_join(s, "name", ask, "_name", ["id"])
    n, k = F.lower("name"), F.lower("_name")
    points = (
        F.when(F.lower("id") == F.lower("_id"), 2000).otherwise(0)
        + F.when(n == k, 600).when(F.startswith(n, k), 300).otherwise(120)
        + F.when(F.lower("kind") == F.lower("_kind"), 120).otherwise(0)
        + F.when(tx.icontains(F.col("file_path"), F.col("_hint")), 90).otherwise(0)
        + F.when(F.col("kind") != "Unknown", 12).otherwise(0)
    )
    every = by_id.unionByName(named.withColumn("score", points).select("query_id", *SYMBOL_COLUMNS, "score"))
    return best_one(every, ["query_id"], [F.col("score").desc(), F.lower("file_path"), "line_start", "id"])


def resolve_symbol_by_name(symbols: DataFrame, req: DataFrame) -> DataFrame:
    """Name-only seed form: compact score, ties by path and line."""
    hits = name_matches(symbols, req)
    points = tx.score("compact", F.col("name"), F.col("signature"), F.col("file_path"), F.col("q"), tx.tokenize(F.col("q")))
    return best_one(hits.withColumn("score", points), ["query_id"], [F.col("score").desc(), F.lower("file_path"), "line_start", "id"]).select(
        "query_id", *SYMBOL_COLUMNS, "score"
    )


def scope_filter(df: DataFrame, path: str = "file_path", root: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Rows inside ``root`` whose path holds ``path_prefix``, absolute or project-relative."""
    out = df
    if root is not None:
        out = out.filter(tx.path_within(F.col(path), F.lit(root)))
    if path_prefix is not None:
        out = out.filter(tx.project_path_matches(F.col(path), F.lit(root or "/"), F.lit(path_prefix)))
    return out


def symbol_filters(hits: DataFrame) -> Column:
    """Kind set and path predicate of the request a hit belongs to."""
    kinds = optional(hits, "kinds", None)
    by_kind = F.lit(True)
    if "kinds" in hits.columns:
        by_kind = kinds.isNull() | (F.size(kinds) == 0) | F.array_contains(F.transform(kinds, F.lower), F.lower("kind"))
    by_path = F.lit(True)
    if "path_prefix" in hits.columns:
        by_path = tx.path_matches(F.col("file_path"), F.col("path_prefix"))
    return by_kind & by_path


def kind_and_path_filter(symbols: DataFrame, req: DataFrame, domain=SYMBOL_KINDS) -> DataFrame:
    """Symbols of the requested kinds below the requested path.

    Kinds are join keys next to the repo; a request without kinds asks for all
    of ``domain``, one without a repo for all repos.
    """
    every = F.array(*[F.lit(k) for k in domain])
    kinds = F.when(F.coalesce(F.size("kinds"), F.lit(0)) <= 0, every).otherwise(F.col("kinds"))
    wanted = req.select(
        "query_id", F.col("repo").alias("repo_name"), "path_prefix", F.explode(F.array_distinct(F.transform(kinds, F.lower))).alias("_kind")
    )
    offered = symbols.select(*SYMBOL_COLUMNS, F.lower("kind").alias("_kind"))
    named = offered.join(wanted.filter(F.col("repo_name").isNotNull()), ["repo_name", "_kind"])
    anywhere = offered.join(wanted.filter(F.col("repo_name").isNull()).drop("repo_name"), "_kind")
    hits = named.unionByName(anywhere)
    return hits.filter(tx.path_matches(F.col("file_path"), F.col("path_prefix"))).select("query_id", *SYMBOL_COLUMNS)
