"""Language registration and whole-corpus indexing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.operators import extract, linking
from codegraph_spark.plans.lineage import cut
from codegraph_spark.sources.scan import explode_lines


@dataclass(frozen=True)
class Language:
    """What a language brings; only symbol rules are required.

    ``usage_fn(lines)`` gives usages, ``linker(usages, symbols, resolved_imports)``
    gives references.  Missing parts fall back to lexical usages and name
    linking; ``import_rules`` without a ``resolver`` stay distinct import texts.
    """

    name: str
    extensions: tuple[str, ...]
    symbol_rules: tuple
    id_style: str = "long"
    ends: str = "brace"
    import_rules: tuple = ()
    usage_fn: Callable[[DataFrame], DataFrame] | None = None
    resolver: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    linker: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None


def resolve_crate_imports(imports: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    crates = linking.crate_table(files, manifests)
    return linking.resolve_modules(extract.expand_imports(imports), files, crates)


@dataclass
class Registry:
    languages: dict[str, Language] = field(default_factory=dict)

    def register(self, language: Language) -> "Registry":
        taken = {e.lower() for l in self.languages.values() for e in l.extensions}
        twice = taken & {e.lower() for e in language.extensions}
        if twice:
            raise ValueError(f"Extension {sorted(twice)[0]} is registered already.")
        self.languages[language.name] = language
        return self

    def extensions(self) -> dict[str, list[str]]:
        return {l.name: list(l.extensions) for l in self.languages.values()}


def register_language(registry: Registry, name: str, extensions, symbol_rules, **parts) -> Registry:
    return registry.register(Language(name, tuple(extensions), tuple(symbol_rules), **parts))


def default_registry() -> Registry:
    r = Registry()
    r.register(Language(
        "CSharp", (".cs",), tuple(extract.CSHARP_RULES),
        import_rules=tuple(x for x in extract.IMPORT_RULES if x[0] == "CSharp"), usage_fn=extract.csharp_usages,
    ))
    r.register(Language(
        "Rust", (".rs",), tuple(extract.RUST_RULES), id_style="short",
        import_rules=tuple(x for x in extract.IMPORT_RULES if x[0] == "Rust"), usage_fn=extract.rust_usages,
        resolver=resolve_crate_imports, linker=linking.link_ranked,
    ))
    return r


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    file_imports: DataFrame
    raw_imports: DataFrame
    usages: DataFrame


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_language(files: DataFrame, registry: Registry) -> DataFrame:
    """Files of registered extensions with their language."""
    ext = tx.extension(F.col("file_path"))
    lang = F.lit(None).cast("string")
    for l in registry.languages.values():
        lang = F.when(ext.isin(*[e.lower() for e in l.extensions]), F.lit(l.name)).otherwise(lang)
    return files.drop("language").withColumn("language", lang).filter(F.col("language").isNotNull())


def extract_corpus(files: DataFrame, registry: Registry, known_files: DataFrame | None = None, manifest_files: DataFrame | None = None):
    """(symbols, raw imports, resolved imports, usages) of ``files(repo_name, file_path, content)`` alone.

    ``known_files`` and ``manifest_files`` are what imports may resolve to; they
    default to ``files``.
    """
    sources = with_language(files, registry)
    known = with_language(known_files if known_files is not None else files, registry)
    lines = explode_lines(sources)
    manifests = extract.parse_manifests(manifest_files if manifest_files is not None else files)
    symbols, raws, resolved, usages = [], [], [], []
    for l in registry.languages.values():
        mine = lines.filter(F.col("language") == l.name)
        symbols.append(extract.extract_symbols(mine, l.symbol_rules, ":" if l.id_style == "short" else "::", l.ends))
        raw = extract.extract_imports(mine, l.import_rules) if l.import_rules else mine.select(
            "repo_name", "file_path", "language", "line", F.col("text").alias("import")
        ).limit(0)
        raws.append(raw)
        if l.resolver:
            resolved.append(l.resolver(raw, known.filter(F.col("language") == l.name).select("repo_name", "file_path"), manifests))
        else:
            resolved.append(raw.select("repo_name", F.col("file_path").alias("from_file"), F.col("import").alias("to_file")).distinct())
        usages.append((l.usage_fn or extract.lexical_usages)(mine).withColumn("language", F.lit(l.name)))
    return _union(symbols), _union(raws), _union(resolved), _union(usages)


def link_own(usages: DataFrame, symbols: DataFrame, file_imports: DataFrame, registry: Registry) -> tuple[DataFrame | None, DataFrame]:
    """(references from the languages' own linkers, usages that are linked by name): a file whose own linker yields nothing is one of the latter."""
    refs, named = [], []
    for l in registry.languages.values():
        mine = usages.filter(F.col("language") == l.name).drop("language")
        if l.linker:
            ranked = cut(l.linker(mine, symbols, file_imports))
            answered = ranked.select("repo_name", F.col("in_file").alias("file_path")).distinct()
            refs.append(ranked)
            mine = mine.join(answered, ["repo_name", "file_path"], "left_anti")
        named.append(mine)
    return (_union(refs) if refs else None), _union(named)


def link_corpus(usages: DataFrame, symbols: DataFrame, file_imports: DataFrame, registry: Registry) -> DataFrame:
    """References of ``usages``; a file whose own linker yields nothing is linked by name."""
    own, named = link_own(usages, symbols, file_imports, registry)
    by_name = linking.link_lexical(named, symbols)
    return by_name if own is None else own.unionByName(by_name)


def index_corpus(files: DataFrame, registry: Registry | None = None) -> Index:
    """All index tables of ``files(repo_name, file_path, content)``.

    The text is read once per extraction: symbols, imports and usages are
    written tables that linking joins.
    """
    registry = registry or default_registry()
    symbols, raw, file_imports, usages = (cut(df) for df in extract_corpus(files, registry))
    refs = link_corpus(usages, symbols, file_imports, registry)
    nodes = linking.build_file_nodes(with_language(files, registry), symbols, file_imports)
    return Index(nodes, symbols, refs, file_imports, raw, usages)
