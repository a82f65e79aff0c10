"""Commit history as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.functions import text as tx
from codegraph_spark.operators.ranked import with_limit
from codegraph_spark.plans import chains, sizing
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.topk import best_one, top_k
from codegraph_spark.schemas import optional

_SCOPES = "_scope"


def _folders_and_path(c):
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def touching(commit_files: DataFrame, req: DataFrame) -> DataFrame:
    """(query, commit) pairs whose commit changes the requested file or something below it.

    Paths offer each of their folders as a key, so scope is an equi-join.
    """
    asked = req.filter(~tx.is_blank(F.col("path"))).select("query_id", F.rtrim("path", F.lit("/")).alias(_SCOPES))
    keys = commit_files.select("repo_name", "commit_id", F.explode(_folders_and_path(F.col("path"))).alias(_SCOPES)).join(
        asked.select(_SCOPES).distinct(), _SCOPES, "left_semi"
    )
    return keys.distinct().join(asked, _SCOPES).select("query_id", "repo_name", "commit_id").distinct()


def _newest():
    return [F.col("author_date_utc").desc(), F.col("commit_id").desc()]


def history(commits: DataFrame, commit_files: DataFrame, req: DataFrame, limit: int = 20, max_limit: int = 200) -> DataFrame:
    """Newest commits of ``req(query_id, path[, since, until, limit])`` with change counts of the whole commit."""
    r = with_limit(req, limit, max_limit).select(
        "query_id", "limit", optional(req, "since", None).cast("timestamp").alias("since"), optional(req, "until", None).cast("timestamp").alias("until")
    )
    hits = touching(commit_files, req).join(commits, ["repo_name", "commit_id"]).join(r, "query_id")
    in_time = (F.col("since").isNull() | (F.col("author_date_utc") >= F.col("since"))) & (
        F.col("until").isNull() | (F.col("author_date_utc") <= F.col("until"))
    )
    best = top_k(hits.filter(in_time), ["query_id"], _newest(), max_limit, F.col("limit")).select(
        "query_id", "rank", "repo_name", "commit_id", "author_name", "author_date_utc", "subject"
    )
    changed = commit_files.join(best.select("repo_name", "commit_id").distinct(), ["repo_name", "commit_id"], "left_semi")
    counts = changed.groupBy("repo_name", "commit_id").agg(
        F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"), F.count_distinct("path").alias("files")
    )
    return best.join(counts, ["repo_name", "commit_id"])


def commit_summary(commits: DataFrame, commit_files: DataFrame, hunks: DataFrame | None, req: DataFrame, hunks_shown: int | None = None) -> DataFrame:
    """One row per changed file of the requested commits, its status and hunks (the first ``hunks_shown``)."""
    asked = commits.join(req.select("query_id", "commit_id"), "commit_id")
    f = commit_files.select("repo_name", "commit_id", "path", "status", "inserted", "deleted")
    totals = f.join(req.select("commit_id").distinct(), "commit_id", "left_semi").groupBy("repo_name", "commit_id").agg(
        F.sum("inserted").alias("total_inserted"), F.sum("deleted").alias("total_deleted")
    )
    out = asked.join(f, ["repo_name", "commit_id"]).join(totals, ["repo_name", "commit_id"])
    shown = F.lit(None).cast("array<struct<ordinal:int,old_start:int,old_count:int,new_start:int,new_count:int>>").alias("hunks")
    cols = ["query_id", "repo_name", "commit_id", "author_name", "author_date_utc", "subject", "total_inserted", "total_deleted", "path", "status"]
    if hunks is None:
        return out.select(*cols, shown)
    mine = hunks.join(req.select("commit_id").distinct(), "commit_id", "left_semi")
    if hunks_shown:
        mine = mine.filter(F.col("ordinal") <= hunks_shown)
    grouped = mine.groupBy("commit_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "old_start", "old_count", "new_start", "new_count"))).alias("hunks")
    )
    return out.join(grouped, ["commit_id", "path"], "left").select(*cols, "hunks")


def _touches(commits: DataFrame, commit_files: DataFrame, req: DataFrame) -> DataFrame:
    mine = commit_files.join(req.select("path").distinct(), "path", "left_semi")
    return mine.join(commits.select("repo_name", "commit_id", "author_date_utc"), ["repo_name", "commit_id"])


def latest_touch(commits: DataFrame, commit_files: DataFrame, req: DataFrame) -> DataFrame:
    """Last commit of each requested path."""
    last = _touches(commits, commit_files, req).groupBy("path").agg(F.max(F.struct("author_date_utc", "commit_id")).alias("m"))
    return req.select("query_id", "path").join(last, "path").select("query_id", "path", F.col("m.commit_id").alias("commit_id"), F.col("m.author_date_utc").alias("author_date_utc"))


def first_touch(commits: DataFrame, commit_files: DataFrame, req: DataFrame) -> DataFrame:
    """First commit that adds each requested path."""
    added = _touches(commits, commit_files.filter("status = 'A'"), req)
    first = added.groupBy("path").agg(F.min(F.struct("author_date_utc", "commit_id")).alias("m"))
    return req.select("query_id", "path").join(first, "path").select("query_id", "path", F.col("m.commit_id").alias("commit_id"), F.col("m.author_date_utc").alias("author_date_utc"))


def touch_count(commit_files: DataFrame, req: DataFrame) -> DataFrame:
    """Commits that change each requested path; touches are counted after they are dealt out, as nearly all of them differ."""
    n = sizing.parts(commit_files)
    asked = req.select("path").distinct()
    many = asked.count() > sizing.ROWS
    touches = commit_files.select("path", "repo_name", "commit_id")
    # few paths leave few touches; many are met where both sides were dealt out by path
    mine = touches.repartition(n, "path").join(asked.repartition(n, "path"), "path", "left_semi") if many else touches.join(asked, "path", "left_semi").repartition(n, "path", "repo_name", "commit_id")
    counts = mine.distinct().groupBy("path").agg(F.count(F.lit(1)).alias("touches"))
    return req.select("query_id", "path").join(counts, "path", "left").select("query_id", "path", F.coalesce("touches", F.lit(0)).alias("touches"))


def patch_text(patches: DataFrame, req: DataFrame, max_chars: int = 30000) -> DataFrame:
    n = tx.clamp(optional(req, "max_chars", max_chars).cast("int"), max_chars, 1000, 250000)
    return patches.join(req.withColumn("_n", n), ["commit_id"]).select("query_id", "commit_id", F.left("patch", F.col("_n")).alias("patch"))


def diff_summary(diffs: DataFrame, status: DataFrame, req: DataFrame, max_chars: int = 24000) -> DataFrame:
    """Diff text of ``req(query_id, path, staged)`` cut to a length, with its line count.

    An untracked path without a diff answers ``UNTRACKED path``.
    """
    n = tx.clamp(optional(req, "max_chars", max_chars).cast("int"), max_chars, 800, 200000)
    r = req.withColumn("_n", n)
    new = status.filter("untracked").select("path", F.lit(True).alias("_new")).distinct()
    j = r.join(diffs.select("path", "staged", "text"), ["path", "staged"], "left").join(new, "path", "left")
    text = F.when(~tx.is_blank(F.col("text")), F.col("text")).when(F.col("_new"), F.concat(F.lit("UNTRACKED "), "path")).otherwise(F.lit(""))
    body = F.left(text, F.col("_n"))
    return j.select(
        "query_id", "path", "staged", body.alias("diff"),
        F.when(F.length(body) == 0, 0).otherwise(F.regexp_count(body, F.lit("\n")) + 1).cast("int").alias("line_count"),
    )


def file_facts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Per path: first and latest commit, touch count, last author, subject and date."""
    c = commits.select("repo_name", "commit_id", "author_name", "author_date_utc", "subject")
    t = commit_files.select("repo_name", "commit_id", "path").distinct().join(c, ["repo_name", "commit_id"])
    at = F.struct("author_date_utc", "commit_id")
    return t.groupBy("repo_name", "path").agg(
        F.min(at).alias("first"),
        F.max(F.struct("author_date_utc", "commit_id", "author_name", "subject")).alias("last"),
        F.count(F.lit(1)).alias("touch_count"),
    ).select(
        "repo_name", "path", F.col("first.commit_id").alias("first_commit"), F.col("last.commit_id").alias("latest_commit"), "touch_count",
        F.col("last.author_name").alias("last_author"), F.col("last.subject").alias("last_subject"), F.col("last.author_date_utc").alias("last_date"),
    )


def commit_neighbors(commit_edges: DataFrame, req: DataFrame) -> DataFrame:
    """Parents and children of the requested commits.

    Requests and edges are made distinct where they meet, so their rows are distinct too and need no further exchange.
    """
    edges = commit_edges.select("child_commit_id", "parent_commit_id")
    n = sizing.parts(edges, req)
    r = req.select("query_id", "commit_id").repartition(n, "commit_id").distinct()

    def side(mine: str, relation: str, other: str) -> DataFrame:
        e = edges.select(F.col(mine).alias("commit_id"), F.col(other).alias("other")).repartition(n, "commit_id").distinct()
        return r.join(e, "commit_id").select("query_id", "commit_id", F.lit(relation).alias("relation"), "other")

    return side("child_commit_id", "parent", "parent_commit_id").unionByName(side("parent_commit_id", "child", "child_commit_id"))


def commit_chains(commit_edges: DataFrame) -> chains.ChainIndex:
    """The commit graph cut into chains; built once, it serves any number of requests."""
    more = ["ordinal"] if "ordinal" in commit_edges.columns else []
    return chains.chain_index(commit_edges.select(F.col("child_commit_id").alias("child"), F.col("parent_commit_id").alias("parent"), *more))


def _index(graph: DataFrame | chains.ChainIndex) -> chains.ChainIndex:
    return graph if isinstance(graph, chains.ChainIndex) else commit_chains(graph)


def ancestors(graph: DataFrame | chains.ChainIndex, heads: DataFrame) -> DataFrame:
    """Every ancestor of ``heads(query_id, side, commit_id)`` with its least distance.

    ``graph`` is the commit edges or their ``commit_chains``. Heads that several queries share are followed once.
    """
    asked = heads.select("query_id", "side", F.col("commit_id").alias("head")).distinct()
    index, asked = _numbered(graph, asked)
    w = Window.partitionBy("h", "chain").orderBy("pos")
    entries = chains.reach(index, asked.select("h", "head").distinct()).withColumn("low", F.coalesce(F.lag("pos").over(w), F.lit(-1)))
    got = chains.spread(index, cut(entries))
    return asked.join(got, "h").select("query_id", "side", F.col("node").alias("commit_id"), (F.col("key") - F.col("at")).alias("distance"))


def _numbered(graph: DataFrame | chains.ChainIndex, asked: DataFrame) -> tuple[chains.ChainIndex, DataFrame]:
    """The index with the ``head`` of every row of ``asked`` in it, and the rows with ``h``, a number per head."""
    index = _index(graph)
    heads = cut(asked.select("head").filter("head is not null").distinct().withColumn("h", F.monotonically_increasing_id()))
    return chains.including(index, heads), cut(asked.join(heads, "head"))


def _reached(graph: DataFrame | chains.ChainIndex, pairs: DataFrame, keys: bool) -> tuple[chains.ChainIndex, DataFrame]:
    """The index, and the entries of both sides of every pair: query_id, side, chain, pos and, with ``keys``, key."""
    heads = pairs.select("query_id", F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col("left_commit").alias("head")),
        F.struct(F.lit("right").alias("side"), F.col("right_commit").alias("head")),
    )).alias("h")).select("query_id", "h.side", "h.head").distinct()
    index, asked = _numbered(graph, heads)
    return index, asked.select("query_id", "side", "h").join(chains.reach(index, asked.select("h", "head").distinct(), keys), "h")


def divergence(graph: DataFrame | chains.ChainIndex, pairs: DataFrame) -> DataFrame:
    """Commits reachable from only one side of ``pairs(query_id, left_commit, right_commit)``.

    Each side reaches a prefix of every chain, so what one side alone reaches is a stretch; commits both reach are never listed.
    """
    index, both = _reached(graph, pairs, keys=False)
    top = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("pos"))), F.lit(-1)).alias(side)
    tops = both.groupBy("query_id", "chain").agg(top("left"), top("right")).filter("left <> right")
    stretch = tops.select("query_id", F.when(F.col("left") > F.col("right"), "left").otherwise("right").alias("side"), "chain", F.least("left", "right").alias("low"), F.greatest("left", "right").alias("pos"))
    return chains.spread(index, stretch).select("query_id", "side", F.col("node").alias("commit_id"))


def merge_base(graph: DataFrame | chains.ChainIndex, pairs: DataFrame) -> DataFrame:
    """Nearest common ancestor of each pair: least total distance, then least distance of the farther side, then least id.

    Between two entries of a chain only the highest place can be nearest, so entries are the only candidates.
    """
    index, reached = _reached(graph, pairs, keys=True)
    key = lambda side: F.when(F.col("side") == side, F.col("key"))
    w = Window.partitionBy("query_id", "chain").orderBy(F.desc("pos"))
    both = reached.select("query_id", "chain", "pos", F.min(key("left")).over(w).alias("l"), F.min(key("right")).over(w).alias("r")).filter("l is not null and r is not null")
    cost = F.struct((F.col("l") + F.col("r") - 2 * F.col("pos")).alias("total"), (F.greatest("l", "r") - F.col("pos")).alias("far"))
    near = both.select("query_id", cost.alias("cost"), F.struct("chain", "pos").alias("spot"))
    # all spots of the least cost, kept while they are found instead of sorting a query's entries once more
    near = near.groupBy("query_id", "cost").agg(F.collect_set("spot").alias("spots")).groupBy("query_id").agg(F.min_by(F.struct("cost", "spots"), "cost").alias("m"))
    ends = near.select("query_id", F.col("m.cost.total").alias("total"), F.explode("m.spots").alias("spot")).select("query_id", "total", "spot.*").join(index.places, ["chain", "pos"])
    return ends.groupBy("query_id").agg(F.min("node").alias("base_commit"), F.first("total").alias("total"))


def rename_chain(commits: DataFrame, commit_files: DataFrame, req: DataFrame) -> DataFrame:
    """Names of ``req(query_id, path)`` through renames, newest first (``hop`` 0 is the asked path).

    Each hop follows the latest rename into the current name that is older than the hop before. Which rename that is depends on the hop
    alone, so renames form a forest and a request asks for the ancestors of its first one.
    """
    dates = commits.select("repo_name", "commit_id", "author_date_utc")
    moves = (
        commit_files.filter(F.col("prev_path").isNotNull() & (F.col("prev_path") != F.col("path")))
        .join(dates, ["repo_name", "commit_id"])
        .select(F.col("path").alias("to"), F.col("prev_path").alias("path"), F.col("author_date_utc").alias("at"), "commit_id")
        .distinct()
    )
    moves = cut(moves.withColumn("move", F.concat_ws("\x00", "commit_id", "to", "path")))
    into = moves.select(F.col("to").alias("name"), "at", "commit_id", "path", F.lit(1).alias("kind"), "move", F.col("move").alias("target"))
    out = moves.select(F.col("path").alias("name"), "at", "commit_id", "path", F.lit(0).alias("kind"), "move", F.lit(None).cast("string").alias("target"))
    # at equal times the way out comes first: only older renames count
    older = Window.partitionBy("name").orderBy("at", "kind", "commit_id", F.desc("path")).rowsBetween(Window.unboundedPreceding, -1)
    before = into.unionByName(out).withColumn("parent", F.last("target", ignorenulls=True).over(older)).filter("kind = 0 and parent is not null")
    index = chains.chain_index(cut(before.select(F.col("move").alias("child"), "parent")))
    latest = best_one(moves, ["to"], [F.col("at").desc(), F.col("commit_id").desc(), "path"]).select(F.col("to").alias("path"), F.col("move").alias("commit_id"))
    first = req.select("query_id", "path").join(latest, "path").select("query_id", F.lit("").alias("side"), "commit_id")
    hops = ancestors(index, first).select("query_id", F.col("commit_id").alias("move"), (F.col("distance") + 1).cast("int").alias("hop")).join(moves, "move")
    asked = req.select("query_id", "path", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast("timestamp").alias("at"))
    return asked.unionByName(hops.select(*asked.columns))


def changed_by_directory(status_entries: DataFrame) -> DataFrame:
    """Changed entries per folder, every level up to the root."""
    levels = F.array_union(F.array(F.lit("")), F.slice(_folders_and_path(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1))
    return status_entries.withColumn("directory", F.explode(levels)).groupBy("directory").agg(
        F.count(F.lit(1)).alias("changed"),
        F.sum(F.col("staged").cast("int")).alias("staged"),
        F.sum(F.col("unstaged").cast("int")).alias("unstaged"),
        F.sum(F.col("untracked").cast("int")).alias("untracked"),
    )


def commits_between(commits: DataFrame, commit_files: DataFrame, graph: DataFrame | chains.ChainIndex, req: DataFrame) -> DataFrame:
    """Commits reachable from ``to_commit`` but not ``from_commit`` that touch the path (any, when blank)."""
    pairs = req.select("query_id", F.col("to_commit").alias("left_commit"), F.col("from_commit").alias("right_commit"))
    only = divergence(graph, pairs).filter("side = 'left'").select("query_id", "commit_id")
    scoped = only.join(touching(commit_files, req).select("query_id", "commit_id"), ["query_id", "commit_id"], "left_semi")
    free = only.join(req.filter(tx.is_blank(F.col("path"))).select("query_id"), "query_id", "left_semi")
    return scoped.unionByName(free).join(commits, "commit_id").select("query_id", "commit_id", "author_date_utc", "subject")

