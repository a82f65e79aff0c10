"""Reads and edits of file text, and plans for bulk changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.operators.ranked import _check_pattern, _pattern_scan, _regex
from codegraph_spark.plans.prefix import running_sum
from codegraph_spark.plans.topk import rank_within, top_k

PREVIEW = 240
SHOWN_MATCHES = 24


def replace_matches(lines: DataFrame, patterns, path_prefix: str | None = None) -> DataFrame:
    """Lines with matches of ``(query_id, mode, find, ignore_case)`` and their match count."""
    src = lines.filter(tx.path_matches(F.col("file_path"), F.lit(path_prefix))) if path_prefix else lines

    def probe(p):
        query_id, mode, find, ignore_case = p
        if mode == "regex":
            rx = _regex(find, ignore_case)
            _check_pattern(lines.sparkSession, rx)
            n = F.regexp_count("text", F.lit(rx))
        else:
            n = tx.count_occurrences(F.col("text"), F.lit(find), ignore_case)
        return F.when(n > 0, F.struct(F.lit(query_id).cast("long").alias("query_id"), n.cast("int").alias("count")))

    return _pattern_scan(src, list(patterns), probe).select(
        "_m.query_id", "repo_name", "file_path", "line", "_m.count", tx.truncate(tx.trim(F.col("text")), PREVIEW).alias("preview")
    )


def replace_plan(lines: DataFrame, patterns, max_matches: int | None = None, path_prefix: str | None = None) -> DataFrame:
    """Matched lines in (file, line) order until the running count reaches ``max_matches``.

    The line that reaches it is the last one.  ``shown`` marks the first 24
    lines of each file; ``None`` plans every match.
    """
    hits = replace_matches(lines, patterns, path_prefix)
    if max_matches:
        # a line counts at least one, so no more than max_matches lines can be part of the plan
        first = top_k(hits, ["query_id"], ["file_path", "line"], max_matches, rank="_seq")
        run = running_sum(first, ["query_id"], "_seq", F.col("count"), "running")
        hits = run.filter(F.col("running") - F.col("count") < max_matches).drop("_seq")
    else:
        hits = hits.withColumn("running", F.lit(None).cast("long"))
    return rank_within(hits, ["query_id", "file_path"], ["line"], "_n").withColumn("shown", F.col("_n") <= SHOWN_MATCHES).drop("_n")


def replace_plan_files(plan: DataFrame) -> DataFrame:
    return plan.groupBy("query_id", "file_path").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("lines"))


def rename_plan(symbols: DataFrame, refs: DataFrame, req: DataFrame) -> DataFrame:
    """``req(query_id, symbol_name, new_name)`` to its definitions and their references."""
    r = req.withColumn("_k", F.lower("symbol_name"))
    found = symbols.select("id", "file_path", "line_start", "name", F.lower("name").alias("_k")).join(r, "_k")
    defs = top_k(found, ["query_id"], ["file_path", "line_start", "id"], None).drop("rank")
    d = defs.select("query_id", F.col("id").alias("symbol_id"), F.col("name").alias("old_name"), "new_name", "file_path", F.col("line_start").alias("line"))
    first = top_k(
        refs.join(d.select("symbol_id").distinct(), "symbol_id", "left_semi").select("symbol_id", "in_file", "line").distinct(),
        ["symbol_id"], ["in_file", "line"], None,
    ).drop("rank")
    uses = first.join(d.select("query_id", "symbol_id", "old_name", "new_name"), "symbol_id").select(
        "query_id", "symbol_id", "old_name", "new_name", F.col("in_file").alias("file_path"), "line", F.lit("reference").alias("kind")
    )
    return d.withColumn("kind", F.lit("definition")).select(*uses.columns).unionByName(uses)


def _replace_all(content: Column, find: Column, repl: Column, ignore_case: Column) -> Column:
    literal = F.replace(content, find, repl)
    escaped = F.regexp_replace(repl, F.lit(r"([\\$])"), F.lit(r"\\$1"))
    folded = F.regexp_replace(content, F.concat(F.lit("(?iu)"), tx.quote_regex(find)), escaped)
    return F.when(ignore_case, folded).otherwise(literal)


def _replace_first(content: Column, find: Column, repl: Column, ignore_case: Column) -> Column:
    at = F.when(ignore_case, F.position(F.lower(find), F.lower(content))).otherwise(F.position(find, content))
    return F.when(at == 0, content).otherwise(
        F.concat(F.left(content, at - 1), repl, F.substr(content, at + F.length(find)))
    )


def _patched(content: Column, op: Column) -> Column:
    """(updated text, number of changes) of one patch operation."""
    find, repl, ic = op["find"], F.coalesce(op["replace"], F.lit("")), F.coalesce(op["ignore_case"], F.lit(False))
    every = F.coalesce(op["replace_all"], F.lit(False))
    rx = F.concat(F.when(ic, F.lit("(?i)")).otherwise(F.lit("")), find)
    n_rx = F.regexp_count(content, rx)
    first_at = F.regexp_instr(content, rx)
    hit = F.regexp_substr(content, rx)
    rx_first = F.when(n_rx == 0, content).otherwise(
        F.concat(F.left(content, first_at - 1), F.regexp_replace(hit, rx, repl), F.substr(content, first_at + F.length(hit)))
    )
    by_regex = F.struct(
        F.when(every, F.regexp_replace(content, rx, repl)).otherwise(rx_first).alias("text"),
        F.when(every, n_rx).otherwise(F.least(n_rx, F.lit(1))).cast("int").alias("changes"),
    )
    n = tx.count_occurrences(content, find, ic)
    by_text = F.struct(
        F.when(every, _replace_all(content, find, repl, ic)).otherwise(_replace_first(content, find, repl, ic)).alias("text"),
        F.when(every, n).otherwise(F.least(n, F.lit(1))).cast("int").alias("changes"),
    )
    return F.when(F.lower(op["mode"]) == "regex", by_regex).otherwise(by_text)


PATCH_FIELDS = ("seq", "mode", "find", "replace", "replace_all", "ignore_case")


def _request(ops: DataFrame) -> list[str]:
    """Operations of several requests are told apart by ``query_id``, where they have one."""
    return ["query_id"] if "query_id" in ops.columns else []


def _owner(files: DataFrame) -> list[str]:
    return ["repo_name"] if "repo_name" in files.columns else []


def _repo(asked: DataFrame) -> list[str]:
    return ["repo"] if "repo" in asked.columns else []


def at_path(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``files`` joined with ``asked(file_path[, repo])``: a request that names a repo meets its file only, one without meets every repo's."""
    if "repo" not in asked.columns:
        return files.join(asked, "file_path")
    named = asked.filter("repo is not null").withColumn("_repo", F.lower("repo"))
    met = files.withColumn("_repo", F.lower("repo_name")).join(named, ["_repo", "file_path"]).drop("_repo")
    return met.unionByName(files.join(asked.filter("repo is null"), "file_path"))


def _ops_by_file(ops: DataFrame, fields) -> DataFrame:
    """The operations of each request as one ordered array per file."""
    return ops.groupBy(*_request(ops), *_repo(ops), "path").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("ops"))


def _by_operation(asked: DataFrame, done: DataFrame, key) -> DataFrame:
    """Every operation with its outcomes, one per file that it met."""
    if "repo" not in asked.columns:
        return asked.join(done, [*key, "seq", "path"], "left")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*key, "repo")]
    cond = (F.col("a.seq") == F.col("d.seq")) & (F.col("a.path") == F.col("d.path"))
    for c in same:
        cond = cond & c
    rest = [c for c in done.columns if c not in (*key, "seq", "path", "repo")]
    return asked.alias("a").join(done.alias("d"), cond, "left").select("a.*", *[F.col(f"d.{c}") for c in rest])


def patch_files(files: DataFrame, ops: DataFrame, dry_run: bool = True):
    """Literal or regex replacements: (files with new text, result per operation).

    A dry run answers each operation against the stored text; an applied run
    folds them in order, each on the text the one before left.  ``ops.seq``
    numbers the operations of the request from 1.
    """
    blank = tx.is_blank(F.col("path")) | tx.is_blank(F.col("find"))
    good = ops.filter(~blank)
    per_file = _ops_by_file(good, PATCH_FIELDS).withColumnRenamed("path", "file_path")
    state = F.struct(F.col("content").alias("text"), F.array().cast("array<struct<seq:int,changes:int>>").alias("done"))

    def step(acc, op):
        def after(r):
            row = F.struct(op["seq"].cast("int").alias("seq"), r["changes"].alias("changes"))
            return F.struct((acc["text"] if dry_run else r["text"]).alias("text"), F.array_append(acc["done"], row).alias("done"))

        return tx.bind(_patched(F.col("content") if dry_run else acc["text"], op), after)

    folded = at_path(files, per_file).withColumn("_r", F.aggregate("ops", state, step))
    key = _request(ops)
    touched = folded.select(*key, *[c for c in files.columns if c != "content"], F.col("_r.text").alias("content"))
    done = folded.select(*key, *_repo(ops), *_owner(files), "file_path", F.explode("_r.done").alias("d")).select(*key, *_repo(ops), *_owner(files), "d.seq", F.col("file_path").alias("path"), "d.changes")
    asked = ops.select(*key, *_repo(ops), F.col("seq").cast("int").alias("seq"), "path", blank.alias("_bad"))
    results = _by_operation(asked, done, key).select(
        *key, "seq", *_owner(files), "path",
        (~F.col("_bad") & F.col("changes").isNotNull()).alias("ok"),
        F.when(F.col("_bad"), F.lit("invalid op: path/find required"))
        .when(F.col("changes").isNull(), F.lit("file not found or outside project root"))
        .otherwise(F.lit("planned" if dry_run else "applied")).alias("status"),
        F.coalesce("changes", F.lit(0)).alias("changes"),
    )
    return touched, results


EDIT_FIELDS = ("seq", "type", "start_line", "end_line", "content", "find", "occurrence")
_NO_LINES = "array<string>"


def _outcome(ok, status, changed, first, last, lines) -> Column:
    return F.struct(
        (F.lit(ok) if isinstance(ok, bool) else ok).alias("ok"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        changed.cast("int").alias("changed"), first.cast("int").alias("from_line"), last.cast("int").alias("to_line"), lines.alias("lines"),
    )


def _failed(status, lines) -> Column:
    zero = F.lit(0)
    return _outcome(False, status, zero, zero, zero, lines)


def edited(lines: Column, op: Column) -> Column:
    """Outcome of one line edit: ok, status, changed lines, from, to and the new lines."""
    n = F.size(lines)
    kind = F.lower(tx.trim(F.coalesce(op["type"], F.lit("replace_range"))))
    start, end = F.coalesce(op["start_line"], F.lit(0)), F.coalesce(op["end_line"], F.lit(0))
    new = F.split(F.replace(F.coalesce(op["content"], F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    head = lambda k: F.slice(lines, F.lit(1), F.greatest(k, F.lit(0)))
    tail = lambda k: F.slice(lines, k + 1, F.greatest(n - k, F.lit(0)))
    bad_range = (start <= 0) | (end <= 0) | (end < start)
    required = "startLine/endLine are required and must be valid"

    last_line = F.greatest(n, F.lit(1))
    frm = F.least(start, n + 1)
    to = F.least(end, n)
    removed = F.when(to >= frm, to - frm + 1).otherwise(0)
    replace_range = (
        F.when(bad_range, _failed(required, lines))
        .when((start > last_line + 1) | (end > last_line + 1), _failed("line range is outside file", lines))
        .otherwise(
            _outcome(True, "applied", F.greatest(removed, F.size(new)), frm, F.greatest(frm, frm + F.size(new) - 1),
                     F.concat(head(frm - 1), new, tail(frm - 1 + removed)))
        )
    )

    def insert(idx):
        return _outcome(True, "applied", F.size(new), idx + 1, F.greatest(idx + 1, idx + F.size(new)), F.concat(head(idx), new, tail(idx)))

    before = F.when(start <= 0, _failed("startLine is required", lines)).otherwise(insert(F.least(start - 1, n)))
    after = F.when(start < 0, _failed("startLine must be >= 0", lines)).otherwise(insert(F.least(start, n)))

    cut_to = F.least(n, end)
    delete = (
        F.when(bad_range, _failed(required, lines))
        .when(start > n, _failed("startLine is outside file", lines))
        .otherwise(_outcome(True, "applied", cut_to - start + 1, start, cut_to, F.concat(head(start - 1), tail(cut_to))))
    )

    text = F.array_join(lines, "\n")
    find, repl, which = op["find"], F.coalesce(op["content"], F.lit("")), F.coalesce(op["occurrence"], F.lit(1))
    at = tx.nth_occurrence(text, find, which)
    one = F.concat(F.left(text, at), repl, F.substr(text, at + F.length(find) + 1))
    zero = F.lit(0)
    snippet = (
        F.when(F.coalesce(F.length(find), zero) == 0, _failed("find is required", lines))
        .when((which <= 0) & ~F.contains(text, find), _failed("snippet not found", lines))
        .when(which <= 0, _outcome(True, "applied", F.lit(1), zero, zero, F.split(F.replace(text, find, repl), "\n", -1)))
        .when(at < 0, _failed("snippet occurrence not found", lines))
        .otherwise(_outcome(True, "applied", F.lit(1), zero, zero, F.split(one, "\n", -1)))
    )
    return (
        F.when(kind == "replace_range", replace_range)
        .when(kind == "insert_before", before)
        .when(kind == "insert_after", after)
        .when(kind == "delete_range", delete)
        .when(kind == "replace_snippet", snippet)
        .otherwise(_failed(F.concat(F.lit("unsupported op type '"), kind, F.lit("'")), lines))
    )


def edit_lines(files: DataFrame, ops: DataFrame, dry_run: bool = False):
    """Line edits: (edited files, outcome per operation).

    Applied edits are cumulative per file in ``seq`` order; a dry run checks
    each one against the stored text.
    """
    per_file = _ops_by_file(ops.filter(~tx.is_blank(F.col("path"))), EDIT_FIELDS).withColumnRenamed("path", "file_path")
    stored = tx.lines_of(F.col("content"))
    row_type = "array<struct<seq:int,type:string,ok:boolean,status:string,changed:int,from_line:int,to_line:int>>"
    state = F.struct(F.col("_stored").alias("lines"), F.lit(False).alias("dirty"), F.array().cast(row_type).alias("done"))

    def step(acc, op):
        kind = F.lower(tx.trim(F.coalesce(op["type"], F.lit("replace_range"))))

        def after(r):
            row = F.struct(
                op["seq"].cast("int").alias("seq"), kind.alias("type"), r["ok"].alias("ok"), r["status"].alias("status"),
                r["changed"].alias("changed"), r["from_line"].alias("from_line"), r["to_line"].alias("to_line"),
            )
            # the stored file ends with a line break, so reading it again folds stray breaks
            saved = tx.bind(F.concat(F.array_join(r["lines"], "\n"), F.lit("\n")), tx.lines_of)
            kept = acc["lines"] if dry_run else F.when(r["ok"], saved).otherwise(acc["lines"])
            return F.struct(kept.alias("lines"), (acc["dirty"] | (F.lit(not dry_run) & r["ok"])).alias("dirty"), F.array_append(acc["done"], row).alias("done"))

        return tx.bind(edited(F.col("_stored") if dry_run else acc["lines"], op), after)

    folded = at_path(files, per_file).withColumn("_stored", stored).withColumn("_r", F.aggregate("ops", state, step))
    content = F.when(F.col("_r.dirty"), F.concat(F.array_join("_r.lines", "\n"), F.lit("\n"))).otherwise(F.col("content"))
    key = _request(ops)
    touched = folded.select(*key, *[c for c in files.columns if c != "content"], content.alias("content"))
    done = folded.select(*key, *_repo(ops), *_owner(files), "file_path", F.explode("_r.done").alias("d")).select(*key, *_repo(ops), *_owner(files), F.col("file_path").alias("path"), "d.*")
    asked = ops.select(
        *key, *_repo(ops), F.col("seq").cast("int").alias("seq"), "path", F.lower(tx.trim(F.coalesce("type", F.lit("unknown")))).alias("_type")
    )
    missing = F.when(tx.is_blank(F.col("path")), F.lit("invalid op: path is required")).otherwise(F.lit("file not found or outside project root"))
    z = F.lit(0)
    results = _by_operation(asked, done, key).select(
        *key, "seq", *_owner(files), "path", F.coalesce("type", "_type").alias("type"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("status", missing).alias("status"),
        F.coalesce("changed", z).alias("changed"), F.coalesce("from_line", z).alias("from_line"), F.coalesce("to_line", z).alias("to_line"),
    )
    return touched, results


def _cut_ranges(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(file_path[, repo], _from, _to, ...)`` with the lines of its file; ranges behind the end drop out."""
    met = at_path(files.select("repo_name", "file_path", "content"), asked)
    return met.withColumn("_lines", tx.lines_of(F.col("content"))).drop("content").filter(F.col("_from") <= F.size("_lines"))


def read_range(lines: DataFrame, req: DataFrame) -> DataFrame:
    """Lines ``from`` to ``to`` of a file, ``to`` defaults to 50 further.

    ``req(query_id, path, from_line, to_line[, repo])``; without a repo the files of that path in all repos answer, told apart by
    ``repo_name``.  From a table of lines requests ask for line numbers; from a table of files the range is cut out in the row.
    """
    frm = F.greatest(F.lit(1), F.coalesce("from_line", F.lit(0)))
    to = F.when(F.coalesce("to_line", F.lit(0)) <= 0, frm + 50).otherwise(F.col("to_line"))
    to = F.greatest(frm, to)
    if "content" in lines.columns:
        return _cut_ranges(lines, req.select("query_id", *_repo(req), F.col("path").alias("file_path"), frm.alias("_from"), to.alias("_to"))).select(
            "query_id", "repo_name", "file_path", F.posexplode(F.slice("_lines", F.col("_from"), F.col("_to") - F.col("_from") + 1)).alias("_i", "text"), "_from"
        ).select("query_id", "repo_name", "file_path", (F.col("_i") + F.col("_from")).cast("int").alias("line"), "text")
    asked = req.select("query_id", *_repo(req), F.col("path").alias("file_path"), F.explode(F.sequence(frm, to)).alias("_line"))
    return _lines_at(lines, asked).select("query_id", "repo_name", "file_path", "line", "text")


def _lines_at(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines joined with ``asked(file_path, _line[, repo])``."""
    place = lambda df, n: df.withColumn("file_path", F.struct("file_path", F.col(n).alias("line")))
    got = at_path(place(lines.select("repo_name", "file_path", "line", "text"), "line"), place(asked, "_line").drop("_line"))
    return got.withColumn("file_path", F.col("file_path.file_path"))


def read_spans(lines: DataFrame, spans: DataFrame, max_lines_per_span: int | None = None) -> DataFrame:
    """Joined text of spans ``(query_id, pos, path, from_line, to_line[, repo])``; one past the end drops out.

    ``max_lines_per_span`` (the original service: 220) cuts longer spans.
    """
    frm = F.greatest(F.lit(1), F.coalesce("from_line", F.lit(0)))
    to = F.when(F.coalesce("to_line", F.lit(0)) <= 0, frm + 80).otherwise(F.col("to_line"))
    to = F.greatest(frm, to)
    if max_lines_per_span:
        to = F.least(to, frm + max_lines_per_span - 1)
    if "content" in lines.columns:
        cut = _cut_ranges(lines, spans.filter(~tx.is_blank(F.col("path"))).select("query_id", "pos", *_repo(spans), F.col("path").alias("file_path"), frm.alias("_from"), to.alias("_to")))
        return cut.select(
            "query_id", "pos", "repo_name", "file_path", F.col("_from").alias("span_from"), F.least(F.col("_to"), F.size("_lines")).alias("span_to"),
            F.array_join(F.slice("_lines", F.col("_from"), F.col("_to") - F.col("_from") + 1), "\n").alias("text"),
        )
    asked = spans.filter(~tx.is_blank(F.col("path"))).select(
        "query_id", "pos", *_repo(spans), F.col("path").alias("file_path"), frm.alias("span_from"), F.explode(F.sequence(frm, to)).alias("_line")
    )
    return _lines_at(lines, asked).groupBy("query_id", "pos", "repo_name", "file_path", "span_from").agg(
        F.max("line").alias("span_to"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )


def read_many(files: DataFrame, req: DataFrame) -> DataFrame:
    """Whole files, or a line range of each, in request order ``pos``."""
    wanted = req.withColumnRenamed("path", "file_path")
    frm = F.greatest(F.lit(1), F.coalesce("from_line", F.lit(0)))
    all_lines = tx.lines_of(F.col("content"))
    to = F.when(F.coalesce("to_line", F.lit(0)) <= 0, F.size(all_lines)).otherwise(F.greatest(frm, F.col("to_line")))
    part = F.array_join(F.slice(all_lines, frm, F.greatest(to - frm + 1, F.lit(0))), "\n")
    return at_path(files.select("repo_name", "file_path", "content"), wanted).select(
        "query_id", "pos", "repo_name", "file_path",
        F.size(all_lines).alias("total_lines"),
        F.when(F.coalesce("from_line", F.lit(0)) + F.coalesce("to_line", F.lit(0)) <= 0, F.col("content")).otherwise(part).alias("text"),
    )


def dir_tree(files: DataFrame, root: str = "/", max_depth: int = 3, max_entries: int | None = None, excludes=()) -> DataFrame:
    """Folders and files below ``root`` down to a depth (the root's children have depth 0)."""
    max_depth = min(max(max_depth, 1), 10)
    base = root.rstrip("/")
    f = files.filter(F.startswith("file_path", F.lit(base + "/"))).select("file_path")
    if excludes:
        f = f.filter(~tx.is_excluded(F.col("file_path"), F.array(*[F.lit(x) for x in excludes])))
    parts = F.split(F.substr("file_path", F.lit(len(base) + 2)), "/")
    n = F.size(parts)
    entries = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max_depth + 1))),
        lambda i: F.struct(
            F.when(i == n, F.lit("f")).otherwise(F.lit("d")).alias("type"),
            F.concat(F.lit(base + "/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("path"),
            (i - 1).alias("depth"),
        ),
    )
    tree = f.select(F.explode(entries).alias("e")).select("e.*").distinct()
    if max_entries:
        tree = tree.orderBy("path", "type").limit(max_entries)
    return tree


def upsert_files(files: DataFrame, writes: DataFrame):
    """Whole-file writes: (files after the writes, outcome per write).

    ``writes(path, repo_name, language, content, overwrite, trailing_newline)``,
    one per repo and path.  An existing file of the repo stays and the write is a conflict unless it
    may overwrite.
    """
    body = F.coalesce("content", F.lit(""))
    ended = F.when(F.coalesce("trailing_newline", F.lit(False)) & ~F.endswith(body, F.lit("\n")), F.concat(body, F.lit("\n"))).otherwise(body)
    w = writes.withColumn("content", ended).withColumnRenamed("path", "file_path")
    key = ["repo_name", "file_path"]
    existing = files.select(*key, F.lit(True).alias("_exists")).distinct()
    marked = w.join(existing, key, "left").withColumn(
        "ok", F.coalesce("overwrite", F.lit(False)) | F.col("_exists").isNull()
    )
    done = marked.filter("ok")
    after = files.join(done.select(*key), key, "left_anti").select(*files.columns).unionByName(done.select(*files.columns))
    outcome = marked.select(
        *key, "ok",
        F.when(F.col("ok"), F.lit("written")).otherwise(F.lit("File already exists and overwrite=false.")).alias("status"),
        F.when(F.col("ok"), F.length("content")).alias("chars"),
        F.when(F.col("ok"), F.octet_length("content")).alias("bytes"),
    )
    return after, outcome
