"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The symbol kinds and languages of the data model.
SYMBOL_KINDS = (
    "Class", "Interface", "Method", "Property", "Field", "Enum",
    "Function", "Struct", "Trait", "TraitImpl", "Module", "Unknown",
)
EDGE_TYPES = ("contains", "imports", "references", "callers", "implements")
DEFAULT_EXCLUDES = ("bin", "obj", "node_modules", ".git")

PROJECTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("exclude_paths", T.ArrayType(T.StringType())),
])
FILES = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
])
LINES = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
SYMBOLS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("signature", T.StringType()),
])
REFS = T.StructType([
    T.StructField("symbol_id", T.StringType()),
    T.StructField("in_file", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("context", T.StringType()),
])
FILE_IMPORTS = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("from_file", T.StringType()),
    T.StructField("to_file", T.StringType()),
])
COMMITS = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("author_date_utc", T.TimestampType()),
    T.StructField("subject", T.StringType()),
])
COMMIT_FILES = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("prev_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("inserted", T.IntegerType()),
    T.StructField("deleted", T.IntegerType()),
])
TASKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("note", T.StringType()),
])
BENCH_RESULTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("fixture", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("is_workflow", T.BooleanType()),
    T.StructField("baseline_count", T.IntegerType()),
    T.StructField("our_count", T.IntegerType()),
    T.StructField("coverage_percent", T.DoubleType()),
    T.StructField("extra", T.IntegerType()),
    T.StructField("baseline_ms", T.LongType()),
    T.StructField("our_ms", T.LongType()),
    T.StructField("baseline_tokens", T.IntegerType()),
    T.StructField("our_tokens", T.IntegerType()),
    T.StructField("hybrid_tokens", T.IntegerType()),
    T.StructField("baseline_calls", T.IntegerType()),
    T.StructField("our_calls", T.IntegerType()),
    T.StructField("hybrid_calls", T.IntegerType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("notes", T.StringType()),
    T.StructField("trace_json", T.StringType()),
])


def optional(df: DataFrame, name: str, default):
    """The column ``name`` of ``df`` when it has one, else a literal default."""
    if name in df.columns:
        return F.col(name)
    return default if hasattr(default, "_jc") else F.lit(default)


def check_kinds(kinds) -> list[str]:
    """Validate kinds ignoring case; an unknown kind is an error."""
    by_lower = {k.lower(): k for k in SYMBOL_KINDS}
    unknown = [k for k in kinds if k.lower() not in by_lower]
    if unknown:
        raise ValueError(f"Unknown kind '{unknown[0]}'.")
    return [by_lower[k.lower()] for k in kinds]
