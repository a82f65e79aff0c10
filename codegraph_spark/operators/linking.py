"""From usages and imports to references: module resolution, linking, enclosing symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.operators.extract import USE_LINE
from codegraph_spark.plans import intervals
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.products import product_join
from codegraph_spark.plans.topk import best_one, top_k

OPEN_END = (1 << 31) - 1
MIN_SCORE = 12
TIE_WINDOW = 2
NEAR_LINES = 16


def _ancestors(path: Column) -> Column:
    """Every folder above a path, from the root down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def crate_table(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests plus the source root of each crate (``src`` when it holds files)."""
    src = F.concat("crate_root", F.lit("/src"))
    holders = files.select("repo_name", F.explode(_ancestors(F.col("file_path"))).alias("_src")).distinct()
    return (
        manifests.withColumn("_src", src)
        .join(holders.withColumn("_has", F.lit(True)), ["repo_name", "_src"], "left")
        .withColumn("src_root", F.when(F.col("_has"), F.col("_src")).otherwise(F.col("crate_root")))
        .drop("_src", "_has")
    )


def local_crates(crates: DataFrame) -> DataFrame:
    """(repo, crate_root, key, dep_src): crates each crate may name in an import."""
    own = crates.select("repo_name", "crate_root", F.col("crate_key").alias("key"), F.col("src_root").alias("dep_src"), F.lit(0).alias("_prio"))
    roots = crates.select("repo_name", F.col("crate_root").alias("_root"), F.col("src_root").alias("dep_src"))
    deps = (
        crates.select("repo_name", "crate_root", F.explode("path_deps").alias("d"))
        .select("repo_name", "crate_root", F.col("d.key").alias("key"), F.col("d.root").alias("_root"))
        .join(roots, ["repo_name", "_root"])
        .select("repo_name", "crate_root", "key", "dep_src", F.lit(2).alias("_prio"))
    )
    spaces = crates.filter("is_workspace").select("repo_name", F.col("crate_root").alias("_ws"), "members")
    near = (
        crates.select("repo_name", "crate_root", F.explode(F.concat(_ancestors(F.col("crate_root")), F.array("crate_root"))).alias("_ws"))
        .join(spaces.select("repo_name", "_ws"), ["repo_name", "_ws"])
        .groupBy("repo_name", "crate_root")
        .agg(F.max_by("_ws", F.length("_ws")).alias("_ws"))
    )
    listed = spaces.select("repo_name", "_ws", F.explode(F.concat(F.array(F.lit(".")), "members")).alias("m"))
    starred = F.contains("m", F.lit("*"))
    listed = listed.withColumn("_base", tx.canonical_path(F.concat("_ws", F.lit("/"), F.regexp_replace("m", r"/?\*.*$", ""))))
    inside = (F.col("_base") == F.col("_ws")) | F.startswith("_base", F.concat("_ws", F.lit("/")))
    named = crates.filter(F.col("crate_key").isNotNull()).select(
        "repo_name", F.col("crate_root").alias("_member"), F.col("crate_key").alias("key"), F.col("src_root").alias("dep_src")
    )
    exact = listed.filter(inside & ~starred).join(
        named.withColumn("_base", F.col("_member")), ["repo_name", "_base"]
    ).select("repo_name", "_ws", "key", "dep_src")
    below = listed.filter(inside & starred).join(
        named.withColumn("_base", tx.dirname(F.col("_member"))), ["repo_name", "_base"]
    ).select("repo_name", "_ws", "key", "dep_src")
    members = near.join(exact.unionByName(below).distinct(), ["repo_name", "_ws"]).select(
        "repo_name", "crate_root", "key", "dep_src", F.lit(1).alias("_prio")
    )
    every = own.filter(F.col("key").isNotNull()).unionByName(deps).unionByName(members)
    return best_one(every, ["repo_name", "crate_root", "key"], ["_prio", "dep_src"]).drop("_prio")


def _candidates(rule: int, base: Column, segs: Column, or_entry: bool = False) -> Column:
    """Candidate files of one resolution rule, longest module prefix first.

    ``or_entry`` ends with the crate's entry file, where an item named right
    after a crate lives.
    """
    n = F.size(segs)
    entry = F.array(
        F.struct(F.lit(rule).alias("rule"), F.lit(1).alias("short"), F.lit(0).alias("form"), F.concat(base, F.lit("/main.rs")).alias("file")),
        F.struct(F.lit(rule).alias("rule"), F.lit(1).alias("short"), F.lit(1).alias("form"), F.concat(base, F.lit("/lib.rs")).alias("file")),
    )

    def at(k: Column, form: int, suffix: str) -> Column:
        stem = F.concat(base, F.lit("/"), F.array_join(F.slice(segs, F.lit(1), k), "/"), F.lit(suffix))
        return F.struct(F.lit(rule).alias("rule"), (-k).alias("short"), F.lit(form).alias("form"), stem.alias("file"))

    ks = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    prefixes = F.flatten(F.transform(ks, lambda k: F.array(at(k, 0, ".rs"), at(k, 1, "/mod.rs"))))
    return F.when(n == 0, entry).otherwise(F.concat(prefixes, entry) if or_entry else prefixes)


def resolve_modules(imports: DataFrame, files: DataFrame, crates: DataFrame) -> DataFrame:
    """Import paths to files by crate, self, super, workspace and local rules.

    ``imports(repo_name, file_path, path)`` as ``expand_imports`` gives them.
    The longest existing module prefix of the first matching rule wins; a file
    never imports itself.
    """
    owner = (
        files.select("repo_name", "file_path", F.explode(_ancestors(F.col("file_path"))).alias("crate_root"))
        .join(crates.select("repo_name", "crate_root", "crate_key", "crate_name", "src_root"), ["repo_name", "crate_root"])
        .groupBy("repo_name", "file_path")
        .agg(F.max_by(F.struct("crate_root", "crate_name", "src_root"), F.length("crate_root")).alias("c"))
        .select("repo_name", "file_path", "c.*")
        .filter(F.startswith("file_path", F.concat("src_root", F.lit("/"))))
    )
    rel = F.split(F.substr("file_path", F.length("src_root") + 2), "/")
    dirs = F.slice(rel, F.lit(1), F.size(rel) - 1)
    last = F.element_at(rel, -1)
    module = F.when(F.lower(last).isin("lib.rs", "main.rs", "mod.rs"), dirs).otherwise(
        F.concat(dirs, F.array(F.regexp_replace(last, r"\.[^.]*$", "")))
    )
    segs = F.filter(F.split("path", "::"), lambda s: s != "")
    d = (
        imports.select("repo_name", "file_path", "path").distinct()
        .join(owner.withColumn("module", module), ["repo_name", "file_path"])
        .withColumn("segs", segs)
        .filter(F.size("segs") > 0)
        .withColumn("key", F.replace(F.lower(F.col("segs")[0]), F.lit("-"), F.lit("_")))
        .join(local_crates(crates), ["repo_name", "crate_root", "key"], "left")
    )
    head = F.lower(F.col("segs")[0])
    n = F.size("segs")
    rest = F.slice("segs", F.lit(2), n)
    src, cur = F.col("src_root"), F.col("module")
    lead = F.aggregate(
        F.transform("segs", F.lower), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, s: F.struct(
            F.when(acc["on"] & (s == "super"), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & (s == "super")).alias("on")
        ),
        lambda acc: acc["n"],
    )
    ups = F.least(lead, F.size(cur))
    scoped = F.concat(F.slice(cur, F.lit(1), F.size(cur) - ups), F.slice("segs", ups + 1, n))
    none = F.array().cast("array<struct<rule:int,short:int,form:int,file:string>>")
    free = F.concat(
        F.when(F.col("dep_src").isNotNull(), _candidates(1, F.col("dep_src"), rest, or_entry=True)).otherwise(none),
        _candidates(2, src, F.col("segs")),
        _candidates(3, src, F.concat(cur, "segs")),
        F.when(F.size(cur) > 0, _candidates(4, src, F.concat(F.slice(cur, F.lit(1), F.size(cur) - 1), "segs"))).otherwise(none),
    )
    options = (
        F.when((head == "crate") | (head == F.lower("crate_name")), _candidates(1, src, rest))
        .when(head == "self", _candidates(1, src, F.concat(cur, rest)))
        .when(head == "super", _candidates(1, src, scoped))
        .otherwise(free)
    )
    known = files.select("repo_name", F.col("file_path").alias("to_file"))
    hits = (
        d.select("repo_name", "file_path", "path", F.explode(options).alias("o"))
        .select("repo_name", "file_path", "path", F.struct("o.rule", "o.short", "o.form").alias("prio"), F.col("o.file").alias("to_file"))
        .join(known, ["repo_name", "to_file"])
        .groupBy("repo_name", "file_path", "path")
        .agg(F.min_by("to_file", "prio").alias("to_file"))
    )
    return (
        hits.filter(F.lower("to_file") != F.lower("file_path"))
        .select("repo_name", F.col("file_path").alias("from_file"), "to_file")
        .distinct()
    )


LINE = ["repo_name", "in_file", "line"]
TEXT_WEIGHT = 4  # a use with the text of its line against a symbol


def _own() -> Column:
    """A use on the line that declares the symbol; numbers are compared first, since this is asked of every pair."""
    return (F.col("_start") == F.col("line")) & (F.lower("_file") == F.lower("in_file"))


def _context(usages: DataFrame, lines: DataFrame | None) -> DataFrame:
    """The text of every line, from the corpus lines (each once) where there are some, else from any usage on the line."""
    if lines is not None:
        return lines.select("repo_name", F.col("file_path").alias("in_file"), "line", tx.trim(F.col("text")).alias("context"))
    return usages.select("repo_name", F.col("file_path").alias("in_file"), "line", "context").distinct()


def with_context(refs: DataFrame, usages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``refs`` plus the text of their line.

    Linking moves keys only.  The text of a line is shipped once, however many names it holds and however many symbols they link to.
    """
    return refs.join(_context(usages, lines), LINE).select("symbol_id", "in_file", "repo_name", "line", "context")


class NameLinks:
    """References by equal name, kept as usages and symbols of each name instead of their product.

    They answer for the symbols that are asked for: how many references each has, its first ones, or all of them. A symbol's own
    declaration is no reference to it.
    """

    def __init__(self, usages: DataFrame, symbols: DataFrame, lines: DataFrame | None = None):
        self.usages, self.lines = usages, lines
        self.uses = usages.select("repo_name", "token", F.col("file_path").alias("in_file"), "line").distinct()
        self.symbols = symbols.select(
            "repo_name", F.col("name").alias("token"), F.col("id").alias("symbol_id"), F.col("file_path").alias("_file"), F.col("line_start").alias("_start")
        )

    def _asked(self, ids: DataFrame):
        named = cut(self.symbols.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi"))
        mine = cut(self.uses.join(named.select("repo_name", "token").distinct(), ["repo_name", "token"], "left_semi"))
        at = named.select("repo_name", "token", "symbol_id", F.lower("_file").alias("_low"), F.col("_start").alias("line"))
        own = mine.withColumn("_low", F.lower("in_file")).join(at, ["repo_name", "token", "_low", "line"]).select("symbol_id", "in_file", "line")
        return named, mine, cut(own)

    def counts(self, ids: DataFrame) -> DataFrame:
        """symbol_id and n_refs of ``ids(symbol_id)``, from the size of each name."""
        named, mine, own = self._asked(ids)
        of_name = mine.groupBy("repo_name", "token").agg(F.count_distinct("in_file", "line").alias("_n"))
        of_own = own.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("_own"))
        n = F.col("_n") - F.coalesce("_own", F.lit(0))
        return named.join(of_name, ["repo_name", "token"]).join(of_own, "symbol_id", "left").select("symbol_id", n.cast("int").alias("n_refs")).filter("n_refs > 0")

    def first(self, ids: DataFrame, k: int) -> DataFrame:
        """The first ``k`` references of each of ``ids`` by (file, line), with ``rank``: names are cut before they meet their symbols."""
        named, mine, own = self._asked(ids)
        spare = own.groupBy("symbol_id").count().agg(F.max("count")).first()[0] or 0
        heads = top_k(mine, ["repo_name", "token"], ["in_file", "line"], k + spare).drop("rank")
        refs = heads.join(named, ["repo_name", "token"]).join(own, ["symbol_id", "in_file", "line"], "left_anti")
        kept = cut(top_k(refs.select("symbol_id", *LINE), ["symbol_id"], ["in_file", "line"], k))
        return self._told(kept).join(kept, ["symbol_id", *LINE])

    def of(self, ids: DataFrame) -> DataFrame:
        """Every reference of ``ids``."""
        named, mine, own = self._asked(ids)
        refs = self._met(mine, named).join(own, ["symbol_id", "in_file", "line"], "left_anti")
        return self._told(cut(refs))

    def per_file(self) -> DataFrame:
        """repo_name, in_file, refs, n_lines and symbols (distinct ones) of every file with references, from the size of each name.

        A symbol is left out on the one line that declares it, so a name on two lines of a file meets all of its symbols there.
        """
        sizes = self.symbols.groupBy("repo_name", "token").agg(F.count_distinct("symbol_id").alias("_all"))
        at = self.symbols.groupBy("repo_name", "token", F.lower("_file").alias("_low"), F.col("_start").alias("line")).agg(F.count_distinct("symbol_id").alias("_own"))
        each = self.uses.join(sizes, ["repo_name", "token"]).withColumn("_low", F.lower("in_file")).join(at, ["repo_name", "token", "_low", "line"], "left")
        each = each.withColumn("_n", F.col("_all") - F.coalesce("_own", F.lit(0)))
        # a row per name or per line of a file: no distinct count over all uses of a large file
        names = each.groupBy("repo_name", "in_file", "token").agg(F.sum("_n").alias("refs"), F.when(F.count(F.lit(1)) > 1, F.max("_all")).otherwise(F.max("_n")).alias("symbols"))
        lines = each.filter("_n > 0").select("repo_name", "in_file", "line").distinct().groupBy("repo_name", "in_file").agg(F.count(F.lit(1)).alias("n_lines"))
        return names.groupBy("repo_name", "in_file").agg(F.sum("refs").alias("refs"), F.sum("symbols").alias("symbols")).join(lines, ["repo_name", "in_file"]).select(
            "repo_name", "in_file", "refs", "n_lines", "symbols"
        )

    def all(self) -> DataFrame:
        """Every reference. The text of a line joins its uses before they meet their symbols, so that no pair is shuffled."""
        symbols = cut(self.symbols)
        uses = cut(self.uses.join(symbols.select("repo_name", "token").distinct(), ["repo_name", "token"], "left_semi"))
        told = uses.join(_context(self.usages, self.lines), LINE)
        return self._met(told, symbols, ~_own(), uses).select("symbol_id", "in_file", "repo_name", "line", "context")

    @staticmethod
    def _met(uses: DataFrame, symbols: DataFrame, keep: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
        met = product_join(uses, symbols, ["repo_name", "token"], ["in_file", "line"], keys, 1 if keys is None else TEXT_WEIGHT)
        return (met if keep is None else met.filter(keep)).select("symbol_id", *[c for c in uses.columns if c != "token"])

    def _told(self, refs: DataFrame) -> DataFrame:
        wanted = refs.select("repo_name", F.col("in_file").alias("file_path"), "line").distinct()
        key = ["repo_name", "file_path", "line"]
        if self.lines is not None:
            return with_context(refs.select("symbol_id", *LINE), self.usages, self.lines.join(wanted, key, "left_semi"))
        return with_context(refs.select("symbol_id", *LINE), self.usages.join(wanted, key, "left_semi"))


def count_refs(refs: DataFrame | NameLinks, ids: DataFrame) -> DataFrame:
    """symbol_id and n_refs of those of ``ids(symbol_id)`` that have references."""
    if isinstance(refs, NameLinks):
        return refs.counts(ids)
    mine = refs.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")
    return mine.groupBy("symbol_id").agg(F.count(F.lit(1)).cast("int").alias("n_refs"))


def first_refs(refs: DataFrame | NameLinks, ids: DataFrame, k: int) -> DataFrame:
    """The first ``k`` references of each of ``ids`` by (file, line), with ``rank``."""
    if isinstance(refs, NameLinks):
        return refs.first(ids, k)
    return top_k(refs.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi"), ["symbol_id"], ["in_file", "line"], k)


def link_lexical(
    usages: DataFrame, symbols: DataFrame, candidates_per_name: int | None = None, tokens_per_file: int | None = None, refs_per_file: int | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Usages joined to symbols of the same name (case-sensitive) in the same repo.

    Every symbol of the name is a candidate.  ``candidates_per_name`` (the original service: 32) takes the first ones by (file, line, id).
    The two per-file limits are options as well.  Where only some symbols are asked for, ``NameLinks`` spares the product.
    """
    if candidates_per_name:
        symbols = top_k(symbols, ["repo_name", "name"], ["file_path", "line_start", "id"], candidates_per_name).drop("rank")
    use = usages
    if tokens_per_file:
        firsts = use.groupBy("repo_name", "file_path", "token").agg(F.min("line").alias("_first"))
        allowed = top_k(firsts, ["repo_name", "file_path"], ["_first", "token"], tokens_per_file).select("repo_name", "file_path", "token")
        use = use.join(allowed, ["repo_name", "file_path", "token"], "left_semi")
    links = NameLinks(use, symbols, lines)
    if not refs_per_file:
        return links.all()
    refs = top_k(links._met(links.uses, links.symbols, ~_own()), ["repo_name", "in_file"], ["line", "symbol_id"], refs_per_file).drop("rank")
    return with_context(refs, use, lines)


CALLABLE = ("Function", "Method")
TYPE_KINDS = ("Struct", "Trait", "Enum", "Class", "Interface")


def _kind_group(kind: Column) -> Column:
    """Kinds that always score alike."""
    return (
        F.when(kind.isin(*CALLABLE), F.lit("call"))
        .when(kind == "Enum", F.lit("enum"))
        .when(kind.isin("Struct", "Class", "Interface", "Trait"), F.lit("type"))
        .otherwise(F.lit("other"))
    )


def link_score(kind: Column, same_file: Column, distance: Column, imported: Column, call_like: Column, type_like: Column) -> Column:
    """Points of one candidate for one usage."""
    base = F.when(same_file, 18 + F.greatest(F.lit(0), NEAR_LINES - F.least(F.lit(NEAR_LINES), distance))).otherwise(F.lit(0))
    neutral = (
        F.when(kind.isin(*CALLABLE), 9).when(kind.isin("Struct", "Class", "Interface", "Trait"), 8).otherwise(3)
    )
    return (
        base
        + F.when(imported, 30).otherwise(0)
        + F.when(call_like & kind.isin(*CALLABLE), 24).otherwise(0)
        + F.when(type_like & kind.isin(*TYPE_KINDS), 22).otherwise(0)
        + F.when(~call_like & ~type_like, neutral).otherwise(0)
    )


def link_ranked(
    usages: DataFrame, symbols: DataFrame, resolved_imports: DataFrame, usages_per_file: int | None = None, refs_per_file: int | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Best symbol of each usage, with a runner-up when the two scores are close.

    A usage never meets every symbol of its name.  Symbols of one kind group
    score alike outside the lines near the usage, so two of them per
    (repo, name, group), per imported file and per own file, plus the ones
    within 16 lines, always hold the best two.

    ``lines`` gives the text of a usage's line; without them ``usages`` bring it as ``context``.
    """
    s = symbols.select(
        "repo_name", F.col("name").alias("token"), F.col("id").alias("symbol_id"), "kind",
        F.col("file_path").alias("_file"), F.col("line_start").alias("_start"), _kind_group(F.col("kind")).alias("_group"),
    )
    # both inputs feed several pools below; each is computed once
    s = cut(s)
    order = [F.lower("_file"), "_start", "symbol_id"]
    shape = ["repo_name", "token", "symbol_id", "kind", "_file", "_start"]
    at = ["repo_name", "file_path", "line"]
    if lines is None:
        use = usages.select(*at, "token", F.col("context").alias("_near"), F.col("context").rlike(USE_LINE).alias("_use"))
    else:
        # a line is looked at once, and only the places that tell calls and types meet its usages
        text = tx.trim(F.col("text"))
        near = lines.filter(~text.rlike(USE_LINE)).select(*at, tx.around(text, tx.CALL_SHAPES + tx.TYPE_SHAPES).alias("_near"), F.lit(False).alias("_use"))
        use = usages.select(*at, "token")
    if usages_per_file:
        if lines is not None:
            use = use.join(near.select(*at), at, "left_semi")
        use = top_k((use.filter("not _use") if lines is None else use).distinct(), ["repo_name", "file_path"], ["line", "token"], usages_per_file).drop("rank")
    # names that no symbol has link to nothing
    use = use.join(s.select("repo_name", "token").distinct(), ["repo_name", "token"], "left_semi")
    if lines is not None:
        use = use.join(near, at)
    use = use.filter("not _use").select(
        "repo_name", "file_path", "token", "line",
        tx.is_call_like(F.col("_near"), F.col("token")).alias("call_like"), tx.is_type_like(F.col("_near"), F.col("token")).alias("type_like"),
    ).distinct()
    use = cut(use)
    anywhere = top_k(s, ["repo_name", "token", "_group"], order, 2).select(*shape)
    per_file = top_k(s, ["repo_name", "token", "_group", "_file"], order, 2).select(*shape, "_group")
    names_used = use.select("repo_name", "file_path", "token").distinct()
    imports = resolved_imports.select("repo_name", F.col("from_file").alias("file_path"), F.col("to_file").alias("_file")).distinct()
    from_imports = top_k(
        imports.join(per_file, ["repo_name", "_file"]).join(names_used, ["repo_name", "file_path", "token"], "left_semi"),
        ["repo_name", "file_path", "token", "_group"], order, 2,
    ).select("file_path", *shape)
    block = lambda c: F.floor(c / NEAR_LINES)
    near_by = (
        use.withColumn("_block", F.explode(F.array(*[block(F.col("line")) + i for i in (-1, 0, 1)])))
        .join(s.withColumn("_block", block(F.col("_start"))).withColumn("file_path", F.col("_file")).drop("_group"), ["repo_name", "file_path", "token", "_block"])
        .select(*use.columns, "symbol_id", "kind", "_file", "_start")
    )
    # every pool is scored where it is made, and candidates below the least score go at once: they are never linked, and rank last.
    # A candidate of several pools counts by its best score: an imported one is always among ``from_imports`` too.
    own_import = imports.filter(F.col("file_path") == F.col("_file")).select("repo_name", "file_path", F.lit(True).alias("_imported"))
    in_own = lambda df: df.join(own_import, ["repo_name", "file_path"], "left")
    pools = [
        use.join(anywhere, ["repo_name", "token"]).withColumn("_imported", F.lit(False)),
        in_own(use.join(per_file.drop("_group").withColumn("file_path", F.col("_file")), ["repo_name", "file_path", "token"])),
        use.join(from_imports, ["repo_name", "file_path", "token"]).withColumn("_imported", F.lit(True)),
        in_own(near_by),
    ]
    score = link_score(
        F.col("kind"), F.lower("_file") == F.lower("file_path"),
        F.when(F.col("_start") > 0, F.abs(F.col("_start") - F.col("line"))).otherwise(F.lit(NEAR_LINES)),
        F.coalesce("_imported", F.lit(False)),
        F.col("call_like"), F.col("type_like"),
    )
    good = [p.select("repo_name", "file_path", "token", "line", "symbol_id", "_file", "_start", score.alias("score")).filter(F.col("score") >= MIN_SCORE) for p in pools]
    pool = good[0]
    for p in good[1:]:
        pool = pool.unionByName(p)
    best_of = F.max(F.struct("score", "_file", "_start")).alias("_c")
    scored = pool.groupBy("repo_name", "file_path", "token", "line", "symbol_id").agg(best_of).select(
        "repo_name", "file_path", "token", "line", "symbol_id", "_c.*"
    )
    usage = ["repo_name", "file_path", "token", "line"]
    ranked = top_k(scored, usage, [F.col("score").desc(), *order], 2)
    best = F.max("score").over(_window(usage))
    kept = ranked.withColumn("_best", best).filter(
        (F.col("rank") == 1) | (F.col("_best") - F.col("score") <= TIE_WINDOW)
    )
    own = (F.lower("_file") == F.lower("file_path")) & (F.col("_start") == F.col("line"))
    refs = kept.filter(~own).select("symbol_id", F.col("file_path").alias("in_file"), "repo_name", "line").distinct()
    if refs_per_file:
        refs = top_k(refs, ["repo_name", "in_file"], ["line", "symbol_id"], refs_per_file).drop("rank")
    return with_context(refs, usages, lines)


def _window(keys):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)


def _interval_end(c: Column) -> Column:
    return F.when(c <= 0, F.lit(OPEN_END)).otherwise(c)


def link_decl_site(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Usages with a known declaration place to the symbol declared there.

    ``sites(repo_name, file_path, line, context, name, decl_file, decl_line)``.
    """
    s = symbols.select("repo_name", F.lower("file_path").alias("_df"), "name", "id", "line_start", _interval_end(F.col("line_end")).alias("_end"))
    at = sites.withColumn("_df", F.lower("decl_file"))
    hits = intervals.best_containing(
        at, s, ["repo_name", "_df", "name"], "decl_line", F.col("line_start"), F.col("_end"),
        F.struct((-F.col("line_start")).alias("near"), F.col("id")), deal=True,
    )
    linked = at.join(hits, ["repo_name", "_df", "name", "decl_line"])
    own = (F.col("_df") == F.lower("file_path")) & (-F.col("hit.near") == F.col("line"))
    return linked.filter(~own).groupBy(
        F.col("hit.id").alias("symbol_id"), F.col("file_path").alias("in_file"), "repo_name", "line"
    ).agg(F.min("context").alias("context"))


def build_file_nodes(files: DataFrame, symbols: DataFrame, imports: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """Per file: language, symbol count, sorted imports and the index time."""
    counts = symbols.groupBy("repo_name", "file_path").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    out = imports.groupBy("repo_name", F.col("from_file").alias("file_path")).agg(F.sort_array(F.collect_set("to_file")).alias("imports"))
    return (
        files.select("repo_name", "file_path", "language")
        .join(counts, ["repo_name", "file_path"], "left")
        .join(out, ["repo_name", "file_path"], "left")
        .select(
            "repo_name", "file_path", "language",
            F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"),
            F.coalesce("imports", F.array().cast("array<string>")).alias("imports"),
            (indexed_at if indexed_at is not None else F.unix_timestamp()).cast("long").alias("last_indexed_at"),
        )
    )


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """``points(repo_name, file_path, line)`` plus the innermost symbol holding them.

    Ties go to the latest start, then the least id.  A point inside no symbol
    takes the nearest declaration before it; a point before all of them drops
    out.
    """
    key = ["repo_name", "file_path"]
    s = symbols.select(*key, "id", "line_start", _interval_end(F.col("line_end")).alias("_end"))
    span = F.when(F.col("_end") == OPEN_END, F.lit(OPEN_END)).otherwise(F.col("_end") - F.col("line_start"))
    inside = intervals.best_containing(
        points, s, key, "line", F.col("line_start"), F.col("_end"),
        F.struct(span.alias("span"), (-F.col("line_start")).alias("near"), F.col("id")), deal=True,
    ).select(*key, "line", F.col("hit.id").alias("symbol_id"))
    open_points = points.select(*key, "line").distinct().join(inside, [*key, "line"], "left_anti")
    before = intervals.best_at_or_before(
        open_points, s, key, "line", F.col("line_start"), F.struct((-F.col("line_start")).alias("near"), F.col("id")), deal=True
    ).select(*key, "line", F.col("hit.id").alias("symbol_id"))
    return points.join(inside.unionByName(before), [*key, "line"])
