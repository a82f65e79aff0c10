"""Reading corpora and configuration, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegraph_spark import schemas
from codegraph_spark.functions import text as tx

LANGUAGE_EXTENSIONS = {"CSharp": [".cs"], "Rust": [".rs"]}


def scan_files(spark: SparkSession, root: str, extensions, excludes=schemas.DEFAULT_EXCLUDES, repo_name: str | None = None) -> DataFrame:
    """Files below ``root`` with one of the extensions, outside the excluded folders."""
    names = ",".join(f"*{e}" for e in sorted(extensions))
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + names + "}")
        .load(root)
    )
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = raw.select(
        F.lit(repo_name).cast("string").alias("repo_name"),
        path.alias("file_path"),
        F.decode("content", "UTF-8").alias("content"),
        F.col("modificationTime").alias("modified_at"),
    )
    dropped = F.array(*[F.lit(x) for x in excludes]) if excludes else F.lit(None)
    return files.filter(~tx.is_excluded(F.col("file_path"), dropped)) if excludes else files


def should_index(files: DataFrame, extensions, ignores=()) -> DataFrame:
    """Files with a known extension that match none of the ignore patterns."""
    keep = tx.extension(F.col("file_path")).isin(*[e.lower() for e in extensions])
    for pattern in ignores:
        keep = keep & ~F.col("file_path").rlike(pattern)
    return files.filter(keep)


def exclude_paths(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Drop files inside a folder their project excludes."""
    rules = projects.select(F.col("name").alias("repo_name"), "exclude_paths")
    return (
        files.join(rules, "repo_name", "left")
        .filter(~tx.is_excluded(F.col("file_path"), F.col("exclude_paths")))
        .drop("exclude_paths")
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of every file, from 1; a final line break opens no line."""
    keep = [c for c in ("repo_name", "file_path", "language") if c in files.columns]
    return files.select(*keep, F.posexplode(tx.lines_of(F.col("content"))).alias("line", "text")).withColumn(
        "line", F.col("line") + 1
    )


def language_table(spark: SparkSession, languages: dict | None = None) -> DataFrame:
    rows = [(ext.lower(), lang) for lang, exts in (languages or LANGUAGE_EXTENSIONS).items() for ext in exts]
    return spark.createDataFrame(rows, "ext string, language string")


def assign_language(files: DataFrame, lang_map: DataFrame) -> DataFrame:
    """Language by extension, ignoring case; files of other extensions drop out."""
    return (
        files.drop("language")
        .withColumn("_ext", tx.extension(F.col("file_path")))
        .join(lang_map.select(F.lower("ext").alias("_ext"), "language"), "_ext")
        .drop("_ext")
    )


def read_task_pack(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("tasks", T.ArrayType(schemas.TASKS)),
    ])
    tasks = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .json(path)
        .select(F.col("name").alias("pack"), "repo", F.explode("tasks").alias("t"))
        .select("pack", "repo", "t.*")
        .withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    )
    if tasks.isEmpty():
        raise ValueError(f"Task pack has no tasks: {path}")
    return tasks


def read_projects(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """Projects of a JSON configuration (below ``section``); names are unique ignoring case."""
    repo = T.StructType([
        T.StructField("Name", T.StringType()),
        T.StructField("Path", T.StringType()),
        T.StructField("Languages", T.ArrayType(T.StringType())),
        T.StructField("ExcludePaths", T.ArrayType(T.StringType())),
    ])
    conf = T.StructType([T.StructField("Repos", T.ArrayType(repo))])
    if section:
        conf = T.StructType([T.StructField(section, conf)])
    default = F.array(*[F.lit(x) for x in schemas.DEFAULT_EXCLUDES])
    projects = (
        spark.read.schema(conf)
        .option("multiLine", "true")
        .json(path)
        .select(F.explode(f"{section}.Repos" if section else "Repos").alias("r"))
        .select(
            F.col("r.Name").alias("name"),
            F.col("r.Path").alias("path"),
            F.coalesce("r.Languages", F.array().cast("array<string>")).alias("languages"),
            F.coalesce("r.ExcludePaths", default).alias("exclude_paths"),
        )
    )
    twice = projects.groupBy(F.lower("name").alias("name")).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"Project '{twice[0]}' is configured twice.")
    return projects


# Columns of the exported result file, in order.
EXPORT_COLUMNS = (
    "scenario", "fixture", "temperature", "is_workflow", "passed", "baseline_count", "our_count", "coverage_percent",
    "extra", "baseline_ms", "our_ms", "baseline_tokens", "our_tokens", "hybrid_tokens", "baseline_calls", "our_calls",
    "hybrid_calls", "notes",
)


def export_rows(results: DataFrame) -> DataFrame:
    """Result rows shaped for export: the pass flag and coverage with two decimals."""
    shaped = results.withColumn("passed", F.coalesce("success", F.col("coverage_percent") >= 100.0)).withColumn(
        "coverage_percent", F.format_string("%.2f", F.col("coverage_percent"))
    )
    return shaped.select(*EXPORT_COLUMNS)


def export_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        export_rows(results).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    elif fmt == "json":
        results.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"Unknown export format '{fmt}'.")


def append_run(results: DataFrame, run_meta: DataFrame, path: str) -> None:
    """Append runs with their results, mode rows and step rows below ``path``.

    Tables are partitioned by run; readers merge schemas, so columns may be
    added over time.  Appending the same run twice rewrites that run only.
    """
    from codegraph_spark.operators import runs

    def put(df: DataFrame, table: str) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{path}/{table}")
        )

    put(run_meta, "bench_runs")
    put(results, "bench_results")
    put(runs.unpivot_modes(results), "bench_modes")
    put(runs.explode_trace(results), "bench_steps")


def read_runs(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{table}").withColumn("run_id", F.col("run_id").cast("string"))


def content_manifest(files: DataFrame, req: DataFrame) -> DataFrame:
    """Per requested file, in request order: path, path bytes, content bytes, sha256; ``repo`` in the request names the repo."""
    from codegraph_spark.operators.edits import at_path

    asked = req.filter(~tx.is_blank(F.col("path"))).withColumn("file_path", F.col("path"))
    return at_path(files.select("repo_name", "file_path", "content"), asked).select(
        "query_id",
        "pos",
        "repo_name",
        "path",
        F.octet_length("path").alias("path_bytes"),
        F.octet_length("content").alias("byte_length"),
        F.sha2("content", 256).alias("sha256"),
    )


def read_git_log(log_lines: DataFrame) -> DataFrame:
    """Unit-separated log text to commits; lines of fewer than four fields drop out."""
    p = F.split("line_text", "\u001f", -1)
    repo = schemas.optional(log_lines, "repo_name", None)
    return log_lines.filter(F.size(p) >= 4).select(
        repo.cast("string").alias("repo_name"),
        p[0].alias("commit_id"),
        p[2].alias("author_name"),
        tx.parse_time(p[1]).alias("author_date_utc"),
        p[3].alias("subject"),
    )


