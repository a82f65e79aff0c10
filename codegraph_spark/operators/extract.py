"""Extraction: declarations, imports, usages, logs and change text to tables.

Everything here is a projection of lines, except where state runs over lines;
those scans are blocked (``plans.prefix``), so one long log or file is spread
over many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.functions.import_groups import leaf_paths
from codegraph_spark.plans import intervals, prefix
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.topk import top_k

IDENTIFIER = r"[_A-Za-z][_A-Za-z0-9]*"

# Words that are never usages.
LEXICAL_STOP_WORDS = [
    "class", "interface", "struct", "enum", "namespace", "using", "public", "private", "protected", "internal", "static", "void", "return", "if",
    "else", "switch", "case", "for", "foreach", "while", "do", "break", "continue", "new", "var", "this", "base", "null", "true", "false", "try",
    "catch", "finally", "throw", "async", "await", "get", "set", "fn", "mod", "pub", "crate", "self", "super", "impl", "trait", "let", "mut", "match",
    "where", "const", "use", "type", "unsafe", "move", "ref", "as", "in", "loop",
]
RUST_STOP_WORDS = [
    "fn", "mod", "pub", "crate", "self", "super", "impl", "trait", "let", "mut", "match", "where", "const", "static", "use", "enum", "struct", "type",
    "unsafe", "move", "ref", "as", "in", "loop", "dyn", "Self",
]

# Patterns of names in use position.
CALL_NAME = r"(?:(?:\b|::|\.)([_A-Za-z][_A-Za-z0-9]*))\s*\("
RUST_PATH = r"(\b(?:crate|self|super|[_A-Za-z][_A-Za-z0-9]*)(?:::[_A-Za-z][_A-Za-z0-9]*)+\b)"
RUST_ANNOTATION = r"(?:->|:)\s*&?\s*(?:'[_A-Za-z][_A-Za-z0-9]*\s+)?(?:mut\s+)?([_A-Za-z][_A-Za-z0-9]*)"
RUST_GENERIC = r"(?:<|,)\s*&?\s*(?:'[_A-Za-z][_A-Za-z0-9]*\s+)?([_A-Za-z][_A-Za-z0-9]*)"
RUST_LITERAL = r"\b([A-Z][_A-Za-z0-9]*)\s*\{"
USE_LINE = r"^\s*(?:pub\s+)?use\s+(.+?)\s*;\s*$"


class SymbolRule(NamedTuple):
    """A declaration pattern; several name groups are joined by `` for ``."""

    language: str
    kind: str
    pattern: str
    name_groups: tuple | int = 1
    signature: str = "none"  # none | line | bases


_CS_MODS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|extern|unsafe|new)\s+)*"
_CS_TYPE = (
    r"(?!(?:public|private|protected|internal|static|class|interface|enum|struct|record|namespace|using|return|new|await|else|throw|if|while|for|foreach|switch|case|get|set|yield|var|in|out|lock)\b)"
    r"[\w.]+(?:<[^()]*>)?(?:\[\])*\??"
)
CSHARP_RULES = [
    SymbolRule("CSharp", "Class", rf"^\s*{_CS_MODS}class\s+({IDENTIFIER})", 1, "bases"),
    SymbolRule("CSharp", "Interface", rf"^\s*{_CS_MODS}interface\s+({IDENTIFIER})", 1, "bases"),
    SymbolRule("CSharp", "Enum", rf"^\s*{_CS_MODS}enum\s+({IDENTIFIER})"),
    SymbolRule("CSharp", "Method", rf"^\s*{_CS_MODS}{_CS_TYPE}\s+({IDENTIFIER})\s*(?:<[^<>]*>)?\s*\(", 1, "line"),
    SymbolRule("CSharp", "Property", rf"^\s*{_CS_MODS}{_CS_TYPE}\s+({IDENTIFIER})\s*(?:\{{|=>)"),
]
_RS_VIS = r"(?:pub(?:\([^)]*\))?\s+)?"
_RS_SEG = rf"(?:{IDENTIFIER}::)*({IDENTIFIER})(?:<[^{{}}]*?>)?"
RUST_RULES = [
    SymbolRule("Rust", "Function", rf"^\s*{_RS_VIS}(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+({IDENTIFIER})", 1, "line"),
    SymbolRule("Rust", "Struct", rf"^\s*{_RS_VIS}struct\s+({IDENTIFIER})"),
    SymbolRule("Rust", "Enum", rf"^\s*{_RS_VIS}enum\s+({IDENTIFIER})"),
    SymbolRule("Rust", "Trait", rf"^\s*{_RS_VIS}(?:unsafe\s+)?trait\s+({IDENTIFIER})"),
    SymbolRule("Rust", "TraitImpl", rf"^\s*(?:unsafe\s+)?impl(?:<[^{{}}]*?>)?\s+!?{_RS_SEG}\s+for\s+&?(?:mut\s+)?{_RS_SEG}", (1, 2)),
    SymbolRule("Rust", "Module", rf"^\s*{_RS_VIS}mod\s+({IDENTIFIER})"),
]
# The simple one-pattern form used to measure workflows.
RUST_SIMPLE_RULES = [SymbolRule("Rust", "Unknown", r"^\s*(?:pub\s+)?(?:fn|struct|enum)\s+([_A-Za-z][_A-Za-z0-9]*)")]
_RUST_CONTAINER = r"^\s*(?:unsafe\s+)?(?:impl\b|(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\b)"


def _rule_hit(rule: SymbolRule) -> Column:
    groups = (rule.name_groups,) if isinstance(rule.name_groups, int) else rule.name_groups
    text = F.col("text")
    name = F.concat_ws(" for ", *[F.regexp_extract(text, rule.pattern, g) for g in groups])
    if rule.signature == "line":
        signature = tx.trim(text)
    elif rule.signature == "bases":
        bases = F.regexp_extract(text, r"\b(?:class|interface)\s+[_A-Za-z]\w*(?:<[^>]*>)?\s*:\s*(.*?)\s*(?:\bwhere\b.*|\{.*)?$", 1)
        signature = F.when(bases == "", name).otherwise(F.concat(name, F.lit(" : "), bases))
    else:
        signature = F.lit(None).cast("string")
    hit = F.struct(F.lit(rule.kind).alias("kind"), name.alias("name"), signature.alias("signature"))
    return F.when((F.col("language") == rule.language) & text.rlike(rule.pattern), hit)


def _declarations(lines: DataFrame, rules) -> DataFrame:
    rules = [r if isinstance(r, SymbolRule) else SymbolRule(*r) for r in rules]
    hits = F.array_compact(F.array(*[_rule_hit(r) for r in rules]))
    return lines.withColumn("_hit", F.explode(hits)).select(
        "repo_name", "file_path", "language", F.col("line").alias("line_start"), "text", "_hit.*"
    )


def _without_literals(text: Column) -> Column:
    no_strings = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'', "")
    return F.regexp_replace(no_strings, r"//.*$", "")


def block_ends(decls: DataFrame, lines: DataFrame) -> DataFrame:
    """``decls`` plus ``line_end`` and ``depth``: where the braces opened at a declaration close.

    Only line numbers and brace counts are shuffled.  The close is an equi-join
    on (file, depth) with the next close event, not a scan of later lines.
    """
    key = ["repo_name", "file_path"]
    clean = _without_literals(F.col("text"))
    counts = lines.select(
        *key,
        "line",
        tx.count_occurrences(clean, F.lit("{")).alias("opens"),
        tx.count_occurrences(clean, F.lit("}")).alias("closes"),
        F.endswith(tx.trim(clean), F.lit(";")).alias("ended"),
    )
    wanted = decls.select(*key, F.col("line_start").alias("line"), F.lit(True).alias("_decl")).distinct()
    marks = counts.join(wanted, [*key, "line"], "left").filter((F.col("opens") + F.col("closes") > 0) | F.col("_decl"))
    # line numbers and counts only; written once because starts and events both read it
    depth = prefix.running_sum(cut(marks), key, "line", F.col("opens") - F.col("closes"), "after").withColumn(
        "before", F.col("after") - F.col("opens") + F.col("closes")
    )
    top = F.greatest("before", F.col("after") + F.col("opens"))
    events = depth.filter("closes > 0").select(
        *key,
        "line",
        F.explode(F.when(F.col("after") < top, F.sequence(F.col("after"), top - 1)).otherwise(F.array().cast("array<bigint>"))).alias("level"),
    )
    starts = depth.filter("_decl").select(*key, "line", F.col("before").alias("level"), "opens", "ended")
    pending = starts.filter(~((F.col("opens") == 0) & F.col("ended")))
    closes = intervals.first_at_or_after(pending, events, [*key, "level"], "line", "line", "end_line")
    ends = (
        starts.join(closes, [*key, "level", "line"], "left")
        .select(
            *key,
            F.col("line").alias("line_start"),
            F.col("level").cast("int").alias("depth"),
            F.when((F.col("opens") == 0) & F.col("ended"), F.col("line")).otherwise(F.coalesce("end_line", F.lit(0))).cast("int").alias("line_end"),
        )
    )
    return decls.join(ends, [*key, "line_start"])


def symbol_id(style: str) -> Column:
    if style == "short":
        return F.concat_ws(":", "repo_name", "file_path", "name", F.col("line_start").cast("string"))
    return F.concat_ws("::", "repo_name", "file_path", "name", "kind", F.col("line_start").cast("string"))


def extract_symbols(lines: DataFrame, rules, repo_separator: str = "::", ends: str = "brace", impl_methods: bool = False) -> DataFrame:
    """Declarations of ``lines`` by rule.

    ``ends="brace"`` closes a symbol where its braces close; ``ends="next"``
    lets it run to the next symbol of the file (the last one stays open, 0).
    Functions directly inside an ``impl`` or ``trait`` block are methods, which
    the Rust index leaves out unless ``impl_methods`` asks for them.
    """
    decls = _declarations(lines, rules)
    if ends == "next":
        from pyspark.sql.window import Window

        after = Window.partitionBy("repo_name", "file_path").orderBy("line_start")
        ended = decls.drop("text").withColumn(
            "line_end", F.coalesce(F.lead("line_start").over(after) - 1, F.lit(0)).cast("int")
        )
    else:
        decls = decls.drop("text")
        if not impl_methods:
            boxes = lines.filter((F.col("language") == "Rust") & F.col("text").rlike(_RUST_CONTAINER)).select(
                "repo_name", "file_path", "language", F.col("line").alias("line_start"),
                F.lit(BOX).alias("kind"), F.lit("").alias("name"), F.lit(None).cast("string").alias("signature"),
            )
            decls = decls.unionByName(boxes)
        ended = block_ends(cut(decls), lines)
        if not impl_methods:
            ended = _free_functions(cut(ended))
    style = "short" if repo_separator == ":" else "long"
    return ended.select(
        symbol_id(style).alias("id"), "repo_name", "file_path", "name", "kind", "line_start", "line_end", "signature"
    )


BOX = "impl or trait"


def _free_functions(decls: DataFrame) -> DataFrame:
    """Drop functions one brace level inside an impl or trait block, and the block rows."""
    key = ["repo_name", "file_path"]
    boxes = decls.filter(F.col("kind") == BOX)
    fns = decls.filter("kind = 'Function' and language = 'Rust'").select(*key, "line_start", "depth")
    inside = intervals.best_containing(
        fns.withColumn("box_depth", F.col("depth") - 1),
        boxes.select(*key, F.col("depth").alias("box_depth"), "line_start", "line_end"),
        [*key, "box_depth"],
        "line_start",
        F.col("line_start") + 1,
        F.when(F.col("line_end") <= 0, F.lit((1 << 31) - 1)).otherwise(F.greatest("line_end", F.col("line_start") + 1)),
        F.col("line_start"),
    ).select(*key, "line_start", F.lit("Function").alias("kind"))
    return decls.filter(F.col("kind") != BOX).join(inside, [*key, "line_start", "kind"], "left_anti")


# Import lines per language (language, pattern, group).
IMPORT_RULES = [
    ("CSharp", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:[\w]+\s*=\s*)?([\w.]+(?:<[^;]*>)?)\s*;", 1),
    ("Rust", USE_LINE, 1),
    ("Rust", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([_A-Za-z][_A-Za-z0-9]*)\s*;", 1),
]


def extract_imports(lines: DataFrame, rules=tuple(IMPORT_RULES)) -> DataFrame:
    """Raw imports per file, distinct ignoring case, first line first."""
    found = [
        F.when((F.col("language") == lang) & F.col("text").rlike(pattern), F.regexp_extract("text", pattern, group))
        for lang, pattern, group in rules
    ]
    raw = lines.select(
        "repo_name", "file_path", "language", "line", F.explode(F.array_compact(F.array(*found))).alias("import")
    ).filter(F.length("import") > 0)
    return dedupe_imports(raw)


def dedupe_imports(imports: DataFrame) -> DataFrame:
    """One row per import ignoring case; the first spelling by line stays."""
    first = F.min(F.struct("line", "import")).alias("_first")
    return (
        imports.groupBy("repo_name", "file_path", "language", F.lower("import").alias("_k"))
        .agg(first)
        .select("repo_name", "file_path", "language", F.col("_first.line").alias("line"), F.col("_first.import").alias("import"))
    )


def _usage_rows(lines: DataFrame, tokens: Column) -> DataFrame:
    told = lines.withColumn("context", tx.trim(F.col("text")))  # once per line, not once per token
    return told.select("repo_name", "file_path", F.explode(tokens).alias("token"), "line", "context")


def lexical_usages(lines: DataFrame) -> DataFrame:
    """Identifiers of three or more characters in a usage-like place.

    Every distinct identifier of a line that is no keyword is looked at.
    """
    runs = F.regexp_extract_all("text", F.lit(f"({tx.NAME_CHAR}+)"), 1)
    stop = F.array(*[F.lit(w) for w in LEXICAL_STOP_WORDS])
    ids = F.filter(F.array_except(runs, stop), lambda t: (F.length(t) >= 3) & F.rlike(t, F.lit(f"^{IDENTIFIER}$")))
    return _usage_rows(lines, tx.used_in(F.col("text"), ids))


def rust_usages(lines: DataFrame) -> DataFrame:
    """Names in call, path, annotation, generic and struct-literal position."""
    code = F.regexp_replace("text", r"//.*$", "")
    paths = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(RUST_PATH), 1), lambda p: F.split(p, "::")))
    found = F.concat(
        F.regexp_extract_all(code, F.lit(CALL_NAME), 1),
        paths,
        *[F.regexp_extract_all(code, F.lit(p), 1) for p in (RUST_ANNOTATION, RUST_GENERIC, RUST_LITERAL)],
    )
    stop = F.array(*[F.lit(w) for w in RUST_STOP_WORDS])
    keep = F.filter(
        F.array_distinct(found), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~F.rlike(t, F.lit("^_+$"))
    )
    return _usage_rows(lines, keep)


# Names of C# code that are never references.
CSHARP_STOP_WORDS = [
    *LEXICAL_STOP_WORDS,
    "int", "string", "bool", "double", "float", "long", "object", "char", "byte", "decimal", "nameof", "typeof", "sizeof", "default", "is", "out",
    "when",
]
CSHARP_USE_POSITIONS = [
    CALL_NAME,
    r"\.\s*([_A-Za-z]\w*)",
    r"\b([_A-Za-z]\w*)\s*\.",
    r"\bnew\s+([_A-Za-z]\w*)",
    r"(?:[-+*/%=<>!&|?:]|\breturn)\s*([_A-Za-z]\w*)",
    r"\b([_A-Za-z]\w*)\s*(?:[-+*/%<>!&|?]=?|==?)\s",
    r"[(,]\s*([_A-Za-z]\w*)\s*(?=[,)])",
    r"^\s*\[\s*([_A-Za-z]\w*)",
    r"[<,]\s*([_A-Za-z]\w*)\s*(?=[,>])",
]
_CS_DECLARED = [r.pattern for r in CSHARP_RULES] + [r"\b(?:var|[\w.<>\[\]?]+)\s+([_A-Za-z]\w*)\s*="]


def csharp_usages(lines: DataFrame) -> DataFrame:
    """Names of three or more characters in reference position; declared names drop out."""
    is_code = ~F.col("text").rlike(r"^\s*(?:using|namespace)\b")
    mine = lines.filter(is_code).withColumn("_code", _without_literals(F.col("text")))  # once per line, not once per pattern
    found = F.concat(*[F.regexp_extract_all("_code", F.lit(p), 1) for p in CSHARP_USE_POSITIONS])
    declared = F.array(*[F.regexp_extract("_code", p, 1) for p in _CS_DECLARED])
    stop = F.array(*[F.lit(w) for w in CSHARP_STOP_WORDS])
    # the declared names are looked for once per line, not once per token
    keep = F.filter(F.array_except(found, F.concat(declared, stop)), lambda t: F.length(t) >= 3)
    return _usage_rows(mine, keep)


def expand_imports(imports: DataFrame) -> DataFrame:
    """One row per imported path; grouped imports name several."""
    paths = imports.withColumn("path", F.explode(leaf_paths(F.col("import"))))
    return paths.select(*imports.columns, "path")


# Places of a manifest.
MANIFEST_SECTION = r"(?is)(?:^|\n)[ \t]*\[{name}\][ \t]*\r?\n(.*?)(?=\n[ \t]*\[[^\n]*\][ \t]*(?:\r?\n|$)|$)"
MANIFEST_MEMBERS = r"(?is)members\s*=\s*\[(.*?)\]"
MANIFEST_PATH = r'(?im)^\s*([A-Za-z0-9_\-]+)\s*=\s*\{[^}]*path\s*=\s*"([^"]+)"'
MANIFEST_NAME = r'(?m)^\s*name[^=\n]*=\s*"?([^"\n]*)"?'
MANIFEST_DEPENDENCIES = ["dependencies", "dev-dependencies", "build-dependencies"]


def parse_manifests(files: DataFrame) -> DataFrame:
    """Crate name, workspace members and path dependencies of ``Cargo.toml`` files."""
    section = lambda name: MANIFEST_SECTION.replace("{name}", name)
    body = F.col("content")
    package = F.regexp_extract(body, section("package"), 1)
    members = F.regexp_extract(body, MANIFEST_MEMBERS, 1)
    deps = F.array_join(F.array(*[F.regexp_extract(body, section(s), 1) for s in MANIFEST_DEPENDENCIES]), "\n")
    dep = MANIFEST_PATH
    root = tx.dirname(F.col("file_path"))
    name = F.nullif(tx.trim(F.regexp_extract(package, MANIFEST_NAME, 1)), F.lit(""))
    return files.filter(tx.basename(F.col("file_path")) == "Cargo.toml").select(
        "repo_name",
        root.alias("crate_root"),
        name.alias("crate_name"),
        F.replace(F.lower(name), F.lit("-"), F.lit("_")).alias("crate_key"),
        F.contains(F.lower(body), F.lit("[workspace]")).alias("is_workspace"),
        tx.distinct_ignore_case(
            F.filter(F.transform(F.regexp_extract_all(members, F.lit('"([^"]+)"'), 1), tx.trim), lambda m: F.length(m) > 0)
        ).alias("members"),
        F.transform(
            F.arrays_zip(
                F.regexp_extract_all(deps, F.lit(dep), 1).alias("name"), F.regexp_extract_all(deps, F.lit(dep), 2).alias("path")
            ),
            lambda d: F.struct(
                F.replace(F.lower(d["name"]), F.lit("-"), F.lit("_")).alias("key"),
                tx.canonical_path(F.concat(root, F.lit("/"), d["path"])).alias("root"),
            ),
        ).alias("path_deps"),
    )


def parse_numstat(change_lines: DataFrame) -> DataFrame:
    """Numstat and name-status lines of commits to one row per changed path.

    ``R100`` style codes give ``prev_path``; a ``-`` count marks a binary file.
    """
    p = F.split("text", "\t", -1)
    num = F.col("text").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t")
    renamed = r"^(.*)\{(.*) => (.*)\}(.*)$"
    raw = p[2]
    path = (
        F.when(raw.rlike(renamed), F.replace(F.regexp_replace(raw, renamed, "$1$3$4"), F.lit("//"), F.lit("/")))
        .when(F.contains(raw, F.lit(" => ")), F.regexp_extract(raw, r" => (.*)$", 1))
        .otherwise(raw)
    )
    counts = change_lines.filter(num).select(
        "commit_id",
        path.alias("path"),
        F.lit(None).cast("string").alias("prev_path"),
        F.lit(None).cast("string").alias("status"),
        F.expr("try_cast(split(text, '\\t')[0] as int)").alias("inserted"),
        F.expr("try_cast(split(text, '\\t')[1] as int)").alias("deleted"),
        (p[0] == "-").alias("is_binary"),
    )
    named = change_lines.filter(~num & F.col("text").rlike(r"^[A-Z]\d*\t")).select(
        "commit_id",
        F.element_at(p, -1).alias("path"),
        F.when(F.size(p) >= 3, p[1]).alias("prev_path"),
        F.left(p[0], F.lit(1)).alias("status"),
        F.lit(None).cast("int").alias("inserted"),
        F.lit(None).cast("int").alias("deleted"),
        F.lit(None).cast("boolean").alias("is_binary"),
    )
    pick = lambda c: F.max(c).alias(c)
    return counts.unionByName(named).groupBy("commit_id", "path").agg(
        pick("prev_path"), pick("status"), pick("inserted"), pick("deleted"), F.coalesce(F.max("is_binary"), F.lit(False)).alias("is_binary")
    )


def change_totals(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("commit_id").agg(
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
        F.count(F.lit(1)).alias("files"),
    )


def parse_hunks(patch_lines: DataFrame) -> DataFrame:
    """Hunk headers of unified diffs with the file they belong to; a missing count is 1."""
    named = F.when(F.startswith("text", F.lit("+++ b/")), tx.trim(F.substring("text", 7, 1_000_000)))
    header = r"^@@\s+-?(\d+)(?:,(\d+))?\s+\+?(\d+)(?:,(\d+))?"
    marks = patch_lines.filter(F.startswith("text", F.lit("+++ b/")) | F.startswith("text", F.lit("@@")))
    at = prefix.fill_forward(marks, ["commit_id"], "line", named, "path")
    hunks = at.filter(F.startswith("text", F.lit("@@")) & F.col("path").isNotNull()).select(
        "commit_id", "path", "line",
        F.coalesce(F.nullif(F.regexp_extract("text", header, 1), F.lit("")), F.lit("0")).cast("int").alias("old_start"),
        F.coalesce(F.nullif(F.regexp_extract("text", header, 2), F.lit("")), F.lit("1")).cast("int").alias("old_count"),
        F.coalesce(F.nullif(F.regexp_extract("text", header, 3), F.lit("")), F.lit("0")).cast("int").alias("new_start"),
        F.coalesce(F.nullif(F.regexp_extract("text", header, 4), F.lit("")), F.lit("1")).cast("int").alias("new_count"),
    )
    numbered = prefix.running_sum(hunks, ["commit_id", "path"], "line", F.lit(1), "ordinal")
    return numbered.withColumn("ordinal", F.col("ordinal").cast("int")).drop("line")


def parse_status(status_lines: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Porcelain status lines ``XY path`` and ``XY old -> new`` of snapshots."""
    xy = F.left("text", F.lit(2))
    raw = tx.trim(F.substring("text", 4, 1_000_000))
    arrow = F.instr(raw, " -> ")
    moved = arrow > 1
    src = F.when(moved, F.left(raw, arrow - 1))
    path = F.when(moved, F.substr(raw, arrow + 4)).otherwise(raw)
    x, y = F.substring("text", 1, 1), F.substring("text", 2, 1)
    first = top_k(status_lines.filter(F.length("text") > 0), ["snapshot_id"], ["line"], max_entries)
    return first.filter(F.length("text") >= 3).select(
        "snapshot_id",
        F.col("rank").alias("pos"),
        path.alias("path"),
        xy.alias("xy"),
        (~x.isin(" ", "?")).alias("staged"),
        (~y.isin(" ", "?")).alias("unstaged"),
        (xy == "??").alias("untracked"),
        src.alias("renamed_from"),
        F.when(moved, F.concat(xy, F.lit(" "), src, F.lit(" -> "), path)).otherwise(F.concat(xy, F.lit(" "), path)).alias("compact"),
    )


# Compiler message formats.
DIAG_PAREN = r"(?i)^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s*([A-Z0-9]+):\s*(.+)$"
DIAG_DASH = r"(?i)^(.+?):(\d+):(\d+)\s*-\s*(error|warning)\s*([A-Z]+\d+):\s*(.+)$"
DIAG_HEADER = r"(?i)^(error|warning)(?:\[([A-Z0-9_]+)\])?:\s*(.+)$"
DIAG_PLACE = r"(?i)^\s*-->\s*(.+?):(\d+):(\d+)\s*$"


def parse_diagnostics(log_lines: DataFrame, max_items: int | None = None, message_chars: int | None = None) -> DataFrame:
    """Compiler messages of build logs in three formats.

    A header line pairs with the next location line; a later header replaces an
    unpaired one.
    """
    t = tx.trim(F.col("text"))
    marked = log_lines.select(
        "log_id", "line", t.alias("t"),
        F.when(t.rlike(DIAG_PAREN), F.lit("paren")).when(t.rlike(DIAG_DASH), F.lit("dash"))
        .when(t.rlike(DIAG_HEADER), F.lit("header")).when(t.rlike(DIAG_PLACE), F.lit("place")).alias("form"),
    ).filter(F.col("form").isNotNull())
    num = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0))

    def one_line(form: str, pattern: str) -> DataFrame:
        g = [F.regexp_extract("t", pattern, i) for i in range(7)]
        return marked.filter(F.col("form") == form).select(
            "log_id", "line", g[1].alias("path"), g[2].alias("l"), g[3].alias("c"),
            F.lower(g[4]).alias("severity"), g[5].alias("code"), g[6].alias("message"),
        )

    head = F.when(
        F.col("form") == "header",
        F.struct(
            F.col("line").alias("at"),
            F.lower(F.regexp_extract("t", DIAG_HEADER, 1)).alias("severity"),
            F.regexp_extract("t", DIAG_HEADER, 2).alias("code"),
            F.regexp_extract("t", DIAG_HEADER, 3).alias("message"),
        ),
    )
    paired = (
        prefix.fill_forward(marked, ["log_id"], "line", head, "h")
        .filter("form = 'place' and h is not null")
        .groupBy("log_id", F.col("h.at").alias("at"))
        .agg(F.min_by(F.struct("line", "t", "h"), "line").alias("m"))
    )
    two_line = paired.select(
        "log_id", F.col("m.line").alias("line"),
        F.regexp_extract("m.t", DIAG_PLACE, 1).alias("path"), F.regexp_extract("m.t", DIAG_PLACE, 2).alias("l"),
        F.regexp_extract("m.t", DIAG_PLACE, 3).alias("c"), F.col("m.h.severity").alias("severity"),
        F.col("m.h.code").alias("code"), F.col("m.h.message").alias("message"),
    )
    every = one_line("paren", DIAG_PAREN).unionByName(one_line("dash", DIAG_DASH)).unionByName(two_line)
    kept = top_k(every.withColumn("log_line", F.col("line")), ["log_id"], ["log_line"], max_items)
    return kept.select(
        "log_id", "log_line", "path", num("l").alias("line"), num("c").alias("col"), "severity", "code",
        (tx.truncate(F.col("message"), message_chars) if message_chars else F.col("message")).alias("message"),
    )


def sanitize_log(log_lines: DataFrame) -> DataFrame:
    """Logs without colour codes and noise; consecutive repeats become ``line (xN)``."""
    plain = F.regexp_replace("text", r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")
    plain = F.rtrim(F.translate(plain, "│║─", "||-"), F.lit(tx.WHITESPACE))
    noise = tx.trim(plain).rlike(r"^[-|+:.]*$")
    kept = log_lines.select("log_id", "line", plain.alias("text"), noise.alias("noise")).filter("not noise").drop("noise")
    before = prefix.fill_forward(kept, ["log_id"], "line", F.col("text"), "_prev", inclusive=False)
    opens = F.when(F.col("_prev").eqNullSafe(F.col("text")), 0).otherwise(1)
    islands = prefix.running_sum(before, ["log_id"], "line", opens, "seq")
    return islands.groupBy("log_id", "seq").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("repeats")).select(
        "log_id", "seq",
        F.when(F.col("repeats") > 1, F.format_string("%s (x%d)", "text", "repeats")).otherwise(F.col("text")).alias("text"),
        "repeats",
    )


