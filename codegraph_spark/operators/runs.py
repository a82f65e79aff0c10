"""Summaries, telemetry and benchmark-run analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegraph_spark.functions import text as tx
from codegraph_spark.operators.ranked import LINE_GRAMS
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.substring import contains_join
from codegraph_spark.plans.topk import top_k


def project_summary(files: DataFrame) -> DataFrame:
    """Files and symbols per (repo, language), with a total row per repo (null language)."""
    return files.groupingSets([[F.col("repo_name"), F.col("language")], [F.col("repo_name")]], "repo_name", "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("symbol_count").cast("long").alias("symbols")
    )


# What a registered language can do.
CAPABILITIES = ("symbols", "imports", "usages", "references")


def project_listing(projects: DataFrame, lang_map: DataFrame) -> DataFrame:
    """Projects with their languages and the extensions those languages bring."""
    langs = projects.select("name", "path", F.explode_outer("languages").alias("language"))
    ext = lang_map.select(F.lower("language").alias("_l"), "ext")
    return langs.withColumn("_l", F.lower("language")).join(ext, "_l", "left").groupBy("name", "path").agg(
        F.sort_array(F.collect_set("language")).alias("languages"), F.sort_array(F.collect_set("ext")).alias("extensions")
    )


def telemetry_totals(events: DataFrame) -> DataFrame:
    """Totals and rates; the rates are 0 when there are no events."""
    agg = events.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.coalesce(F.sum(F.col("is_empty").cast("int")), F.lit(0)).alias("empty_results"),
        F.coalesce(F.sum(F.col("used_fallback").cast("int")), F.lit(0)).alias("fallback_count"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total_queries").cast("double")), F.lit(0.0))
    return agg.withColumn("empty_rate", rate("empty_results")).withColumn("fallback_rate", rate("fallback_count"))


RECENT_SHOWN = 100


def telemetry_recent(events: DataFrame, shown: int = RECENT_SHOWN) -> DataFrame:
    """The newest ``shown`` events."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(shown)


def telemetry_snapshot(events: DataFrame):
    return telemetry_totals(events), telemetry_recent(events)


def latency_stats(events: DataFrame, keys=("endpoint", "mode"), quantile: float = 0.95) -> DataFrame:
    """Count, mean, nearest-rank quantile and empty rate per case.

    The quantile never sorts a whole case in one task: whole-millisecond counts
    find the bucket of the rank, value counts inside that bucket find the value.
    """
    keys = list(keys)
    base = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("latency_ms").alias("mean_ms"),
        F.avg(F.col("is_empty").cast("double")).alias("empty_rate"),
    )
    from pyspark.sql.window import Window

    ms = events.select(*keys, F.floor("latency_ms").alias("ms"), "latency_ms")
    upto = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    target = F.ceil(F.col("n") * F.lit(quantile))
    buckets = ms.groupBy(*keys, "ms").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto("ms")))
    at = (
        buckets.join(base.select(*keys, "n"), keys)
        .filter((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target))
        .select(*keys, "ms", (target - (F.col("upto") - F.col("c"))).alias("need"))
    )
    values = ms.join(at, [*keys, "ms"]).groupBy(*keys, "need", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    q = (
        values.withColumn("upto", F.sum("c").over(upto("latency_ms")))
        .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        .select(*keys, F.col("latency_ms").alias("p95_ms"))
    )
    return base.join(q, keys)


def passed() -> Column:
    """Explicit success, else full coverage."""
    return F.coalesce("success", F.col("coverage_percent") >= 100.0)


AVERAGED = ("baseline_count", "our_count", "extra", "our_ms", "baseline_ms", "baseline_tokens", "our_tokens", "hybrid_tokens", "baseline_calls", "our_calls", "hybrid_calls")


def average_repeats(results: DataFrame) -> DataFrame:
    """One row per scenario, fixture, workflow flag and temperature; counts rounded half to even.

    A measure is null unless some repeat has it; repeats without it count as 0.
    """
    def mean(c):
        present = F.count(c) > 0
        return F.when(present, F.bround(F.avg(F.coalesce(c, F.lit(0)).cast("double"))).cast("long")).alias(c)

    return results.groupBy("scenario", "fixture", "is_workflow", "temperature").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.avg("coverage_percent").alias("coverage_percent"),
        *[mean(c) for c in AVERAGED],
        F.when(F.count("success") > 0, F.bool_and(F.coalesce("success", F.lit(False)))).alias("success"),
    ).withColumn("notes", F.concat(F.lit("avg of "), F.col("repeats").cast("string")))


def coverage(baseline: DataFrame, ours: DataFrame, key: str = "fixture", token: str = "token") -> DataFrame:
    """Share of the baseline tokens we hold per fixture; an empty baseline is 100 %."""
    b = baseline.select(key, token).distinct().withColumn("_b", F.lit(1))
    o = ours.select(key, token).distinct().withColumn("_o", F.lit(1))
    # one pass over the union of both sets instead of an anti join and two counts
    both = b.withColumn("_o", F.lit(0)).unionByName(o.withColumn("_b", F.lit(0)))
    per = both.groupBy(key, token).agg(F.max("_b").alias("b"), F.max("_o").alias("o"))
    agg = per.groupBy(key).agg(
        F.sum("b").alias("baseline_count"), F.sum("o").alias("our_count"), F.sum(F.col("b") * (1 - F.col("o"))).alias("missed")
    )
    return agg.select(
        key, "baseline_count", "our_count", "missed",
        F.when(F.col("baseline_count") == 0, 100.0).otherwise((F.col("baseline_count") - F.col("missed")) / F.col("baseline_count") * 100.0).alias("coverage_percent"),
        (F.col("our_count") - F.col("baseline_count")).alias("extra"),
    )


def count_coverage(expected: DataFrame, actual: DataFrame, key: str = "fixture") -> DataFrame:
    """Count form: the smaller over the larger count, so over-resolution is penalised too."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("baseline_count"))
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("our_count"))
    j = e.join(a, key, "full").fillna(0, ["baseline_count", "our_count"])
    hi, lo = F.greatest("baseline_count", "our_count"), F.least("baseline_count", "our_count")
    return j.withColumn("coverage_percent", F.when(hi == 0, 100.0).otherwise(lo / hi * 100.0))


def symbol_coverage(truth: DataFrame, symbols: DataFrame, key: str = "fixture") -> DataFrame:
    """Share of the true (name, kind) pairs the symbols hold, per fixture."""
    have = symbols.select(key, "name", "kind").distinct().withColumn("_hit", F.lit(1))
    return truth.join(have, [key, "name", "kind"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("baseline_count"),
        F.count("_hit").alias("covered"),
        (F.count("_hit") / F.count(F.lit(1)) * 100.0).alias("coverage_percent"),
    )


CANDIDATES = 5
SPAN_RADIUS = 4


def compare_workflows(lines: DataFrame, symbols: DataFrame, tasks: DataFrame) -> DataFrame:
    """Broad text scan against resolve plus a focused span, for all tasks at once.

    ``tasks(task_id, query, expected_path, expected_evidence)``.
    """
    line_cost = tx.est_tokens(F.col("text"))
    # every task reads the same corpus, so its total is computed once and joined per repo
    total = lines.agg(F.sum(line_cost).alias("scan_tokens"))
    hits = contains_join(lines, "text", tasks, "query", ["file_path", "line"], LINE_GRAMS, repeated=False)
    first = hits.groupBy("task_id").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("file_path", "line")).alias("first"))
    picked = first.select("task_id", F.col("first.file_path").alias("file_path")).join(tasks.select("task_id", "expected_evidence"), "task_id")
    whole = (
        lines.join(picked, "file_path")
        .groupBy("task_id")
        .agg(
            F.greatest(F.lit(1), F.floor((F.sum(F.length("text")) + F.count(F.lit(1)) - 1) / 4)).alias("read_tokens"),
            F.max(F.contains("text", "expected_evidence")).alias("seen"),
        )
    )
    scan = total.first()["scan_tokens"] or 0
    base = tasks.join(first, "task_id", "left").join(whole, "task_id", "left").select(
        "task_id", "query", "expected_path", "expected_evidence",
        F.coalesce("hits", F.lit(0)).alias("baseline_count"),
        (F.lit(scan) + F.coalesce("read_tokens", F.lit(0))).cast("long").alias("baseline_tokens"),
        F.when(F.col("hits") > 0, 2).otherwise(1).alias("baseline_calls"),
        (F.coalesce(F.lower("first.file_path") == F.lower("expected_path"), F.lit(False)) & F.coalesce("seen", F.lit(False))).alias("baseline_success"),
        F.col("first.file_path").alias("text_file"), F.col("first.line").alias("text_line"),
    )
    named = contains_join(symbols.select("id", "name", "file_path", "line_start"), "name", tasks, "query", ["id"])
    points = tx.score("resolve", F.col("name"), F.lit(""), F.col("file_path"), F.col("query"), F.array(F.col("query")))
    best = top_k(named.withColumn("score", points), ["task_id"], [F.col("score").desc(), "file_path", "line_start", "id"], CANDIDATES)
    payload = F.concat_ws("|", "name", "file_path", F.col("line_start").cast("string"))
    resolved = best.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("our_count"),
        F.greatest(F.lit(1), F.floor((F.sum(F.length(payload)) + F.count(F.lit(1)) - 1) / 4)).alias("payload_tokens"),
        F.min_by(F.struct("file_path", F.col("line_start").alias("line")), "rank").alias("sel"),
    )
    chosen = base.join(resolved, "task_id", "left").withColumn(
        "sel_file", F.coalesce("sel.file_path", "text_file")
    ).withColumn("sel_line", F.coalesce("sel.line", "text_line"))
    spots = chosen.filter("sel_file is not null").select(
        "task_id", "expected_evidence", F.col("sel_file").alias("file_path"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("sel_line") - SPAN_RADIUS), F.col("sel_line") + SPAN_RADIUS)).alias("line"),
    )
    span = spots.join(lines.select("file_path", "line", "text"), ["file_path", "line"]).groupBy("task_id").agg(
        F.greatest(F.lit(1), F.floor((F.sum(F.length("text")) + F.count(F.lit(1)) - 1) / 4)).alias("span_tokens"),
        F.max(F.contains("text", "expected_evidence")).alias("our_seen"),
    )
    success = F.coalesce(F.lower("sel_file") == F.lower("expected_path"), F.lit(False)) & F.coalesce("our_seen", F.lit(False))
    return chosen.join(span, "task_id", "left").select(
        "task_id", F.col("query").alias("scenario"), F.col("expected_path").alias("fixture"),
        F.col("baseline_count").cast("long").alias("baseline_count"), "baseline_tokens", "baseline_calls", "baseline_success",
        F.coalesce("our_count", F.lit(0)).cast("long").alias("our_count"),
        (F.coalesce("payload_tokens", F.lit(1)) + F.coalesce("span_tokens", F.lit(0))).cast("long").alias("our_tokens"),
        (F.lit(1) + F.when(F.col("our_count").isNull(), 1).otherwise(0) + F.when(F.col("sel_file").isNotNull(), 1).otherwise(0)).alias("our_calls"),
        success.alias("success"),
    )


HASH = r"(?i)^[0-9a-f]{7,40}$"


def evaluate_history(baseline: DataFrame, compact: DataFrame, check_hash: bool = True) -> DataFrame:
    """Compact answers against broad ones per task: quality and the hybrid outcome.

    ``baseline(task_id, kind, lines array<string>)`` and ``compact(task_id, answer)``.
    """
    j = baseline.join(compact, "task_id", "left")
    head = F.get("lines", F.lit(0))
    same = F.coalesce(F.lower(head) == F.lower("answer"), F.lit(False))
    valid = F.coalesce(F.col("answer").rlike(HASH), F.lit(False)) if check_hash else F.lit(True)
    ok = (
        F.when((F.size("lines") <= 0) | F.col("answer").isNull(), F.lit(False))
        .when(F.col("kind").isin("history_latest_touch", "history_first_touch"), same & valid)
        .when(F.col("kind") == "history_touch_count", F.coalesce(F.expr("try_cast(answer as int)") == F.size("lines"), F.lit(False)))
        .otherwise(same)
    )
    fallback = F.when(F.col("kind") == "history_touch_count", F.size("lines").cast("string")).otherwise(F.coalesce(head, F.lit("")))
    return j.select(
        "task_id", "kind", ok.alias("success"),
        F.when(ok, F.col("answer")).otherwise(fallback).alias("hybrid_answer"),
        F.when(ok, 1).otherwise(2).alias("hybrid_calls"),
        F.size("lines").alias("baseline_count"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.coalesce(F.sum(passed().cast("int")), F.lit(0)).alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("coverage_percent"), F.lit(0.0)).alias("avg_coverage"),
        F.coalesce(F.avg("extra"), F.lit(0.0)).alias("avg_extra"),
    )


HISTORY_KIND = r"^(history_[a-z_]+)"


def with_track(results: DataFrame) -> DataFrame:
    """``track`` history or core, from the task kind (a column, else the notes)."""
    kind = F.regexp_extract(F.coalesce("notes", F.lit("")), HISTORY_KIND, 1)
    return results.withColumn("track", F.when(kind == "", F.lit("core")).otherwise(F.lit("history")))


def token_wins(results: DataFrame) -> DataFrame:
    """Token wins, quality passes and mean token saving of workflow rows per track and temperature."""
    w = with_track(results.filter("is_workflow"))
    won = passed() & (F.coalesce("our_tokens", F.lit(2**31 - 1)) <= F.coalesce("baseline_tokens", F.lit(0)))
    return w.groupBy("track", "temperature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(won.cast("int")).alias("wins"),
        F.sum(passed().cast("int")).alias("quality"),
        F.avg(F.coalesce("baseline_tokens", F.lit(0)) - F.coalesce("our_tokens", F.lit(0))).alias("avg_token_delta"),
    )


def result_label() -> Column:
    delta = F.coalesce("baseline_tokens", F.lit(0)) - F.coalesce("our_tokens", F.lit(0))
    return F.when(~passed(), F.lit("miss")).when(delta >= 0, F.lit("win")).otherwise(F.lit("quality-only"))


def unpivot_modes(results: DataFrame) -> DataFrame:
    """One row per classic, compact and hybrid; hybrid takes compact values where it has none."""
    def mode(name, tokens, calls, ms):
        return F.struct(
            F.lit(name).alias("mode"), tokens.cast("long").alias("tokens"), calls.cast("long").alias("calls"), ms.cast("long").alias("elapsed_ms")
        )

    rows = F.array(
        mode("classic", F.col("baseline_tokens"), F.col("baseline_calls"), F.col("baseline_ms")),
        mode("compact", F.col("our_tokens"), F.col("our_calls"), F.col("our_ms")),
        mode("hybrid", F.coalesce("hybrid_tokens", "our_tokens"), F.coalesce("hybrid_calls", "our_calls"), F.col("our_ms")),
    )
    extra = [c for c in ("event_id",) if c in results.columns]
    return results.select("run_id", "scenario", "fixture", *extra, passed().alias("success"), "notes", F.explode(rows).alias("m")).select(
        "run_id", "scenario", "fixture", *extra, "m.*", "success", "notes"
    )


TRACE = T.StructType([
    T.StructField("modes", T.ArrayType(T.StructType([
        T.StructField("mode", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("tokens", T.IntegerType()),
        T.StructField("elapsedMs", T.LongType()),
        T.StructField("usedFallback", T.BooleanType()),
    ]))),
])


def explode_trace(results: DataFrame) -> DataFrame:
    """Numbered step rows of the traces; malformed JSON gives none."""
    return results.select(
        "run_id", "scenario", "fixture", F.posexplode(F.from_json("trace_json", TRACE)["modes"]).alias("_pos", "m")
    ).select(
        "run_id", "scenario", "fixture",
        (F.col("_pos") + 1).alias("step_no"),
        F.coalesce("m.mode", F.lit("unknown")).alias("mode"),
        F.lit("git").alias("operation"),
        F.col("m.input").alias("input"), F.col("m.output").alias("output"), F.col("m.tokens").alias("tokens"), F.col("m.elapsedMs").alias("elapsed_ms"),
        F.lit("ok").alias("status"),
        F.when(F.col("m.usedFallback"), F.lit("fallback")).otherwise(F.lit("")).alias("notes"),
    )


def _tokens():
    return tuple(F.coalesce(c, F.lit(0)) for c in ("baseline_tokens", "our_tokens", "hybrid_tokens"))


def flaky_scenarios(results: DataFrame) -> DataFrame:
    """Scenarios of two or more rows whose pass flag or sign of the best delta varies."""
    return results.groupBy(F.lower("scenario").alias("_k")).agg(
        F.min("scenario").alias("scenario"),
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct(passed()).alias("pass_states"),
        F.count_distinct(F.signum(tx.best_delta(*_tokens()).cast("double"))).alias("delta_signs"),
    ).filter("runs >= 2 and (pass_states > 1 or delta_signs > 1)").drop("_k")


def scenario_flags(rows: DataFrame) -> DataFrame:
    """Deltas, savings, regression, winner, review and the displayed outcome of each row."""
    classic, compact, hybrid = _tokens()
    d = rows.withColumn("passed", passed()).withColumn("compact_delta", classic - compact).withColumn("hybrid_delta", classic - hybrid)
    d = d.withColumn("best_delta", F.greatest("compact_delta", "hybrid_delta"))
    d = d.withColumn("savings_pct", tx.savings_pct(classic, compact, hybrid))
    d = d.withColumn("regression", (F.col("compact_delta") < 0) | (F.col("hybrid_delta") < 0))
    return (
        d.withColumn("winner", F.col("passed") & (F.col("best_delta") > 0))
        .withColumn("needs_review", ~F.col("passed") | F.col("regression") | (compact <= 0))
        .withColumn(
            "outcome",
            F.when(~F.col("passed"), F.lit("FAIL")).when(F.col("regression"), F.lit("REG")).when(F.col("best_delta") <= 0, F.lit("WARN")).otherwise(F.lit("PASS")),
        )
    )


def mode_notes(modes: DataFrame, flagged: DataFrame) -> DataFrame:
    """A short remark per mode row: broad or narrow output, saved tokens, regression, fallback."""
    n = F.size(F.filter(F.split("output", r"[\r\n]+"), lambda s: s != ""))
    key = ["run_id", "scenario", "fixture"]
    used = tx.icontains(F.coalesce("input", F.lit("")), F.lit("fallback")) | tx.icontains(F.coalesce("notes", F.lit("")), F.lit("fallback"))
    return modes.join(flagged.select(*key, "compact_delta"), key).withColumn(
        "remark",
        F.when((F.col("mode") == "classic") & (n > 1), F.lit("Broad output"))
        .when(F.col("mode") == "classic", F.lit("Narrow output"))
        .when((F.col("mode") == "compact") & (F.col("compact_delta") > 0), F.lit("Saved tokens"))
        .when((F.col("mode") == "compact") & (F.col("compact_delta") < 0), F.lit("Regression"))
        .when((F.col("mode") == "hybrid") & used, F.lit("Fallback used"))
        .when(F.col("mode") == "hybrid", F.lit("Fallback not needed"))
        .otherwise(F.col("notes")),
    )


def _mentions(text: Column, *words: str) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def tooling(notes: Column, kind: Column, scenario: Column) -> Column:
    v = F.lower(F.concat_ws(" ", F.coalesce(notes, F.lit("")), F.coalesce(kind, F.lit("")), scenario))
    return (
        F.when(_mentions(v, "grep", "search"), F.lit("Search / Grep"))
        .when(_mentions(v, "symbol", "resolve"), F.lit("Resolve / Symbol"))
        .when(_mentions(v, "workflow", "e2e"), F.lit("Workflow / E2E"))
        .otherwise(F.lit("History / Git"))
    )


def goal(tool: Column, kind: Column, scenario: Column) -> Column:
    v = F.lower(F.concat_ws(" ", F.coalesce(kind, F.lit("")), scenario))
    return (
        F.when(_mentions(v, "latency"), F.lit("Latency"))
        .when(_mentions(v, "determin"), F.lit("Determinism"))
        .when(_mentions(v, "correct"), F.lit("Correctness"))
        .when(tool == "Resolve / Symbol", F.lit("Correctness"))
        .otherwise(F.lit("Token Savings"))
    )


def scenario_language(fixture: Column, scenario: Column) -> Column:
    v = F.lower(F.concat_ws(" ", fixture, scenario))
    return F.when(_mentions(v, ".cs", "csharp"), F.lit("CSharp")).when(_mentions(v, ".rs", "rust", "cargo"), F.lit("Rust")).otherwise(F.lit("Mixed"))


def humanize(scenario: Column) -> Column:
    t = tx.trim(F.translate(scenario, "._", "  "))
    return F.when(F.length(t) == 0, scenario).otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1_000_000)))


def scenario_title(kind: Column, fixture: Column, scenario: Column) -> Column:
    name = tx.basename(fixture)
    label = F.when(tx.is_blank(name), scenario).otherwise(name)
    return (
        F.when(kind == "history_latest_touch", F.concat(F.lit("Latest touch for "), label))
        .when(kind == "history_first_touch", F.concat(F.lit("First touch for "), label))
        .when(kind == "history_touch_count", F.concat(F.lit("Touch count for "), label))
        .otherwise(humanize(scenario))
    )


def classify_scenarios(results: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Tooling, goal, language and title of each row; ``catalog(id, title, kind, note)`` adds task facts."""
    d = results
    if catalog is not None:
        c = catalog.select(F.lower("id").alias("_k"), F.col("title").alias("_title"), F.col("kind").alias("kind"), F.col("note").alias("_note"))
        d = d.withColumn("_k", F.lower("scenario")).join(c, "_k", "left").drop("_k")
        d = d.withColumn("notes", F.concat_ws(" | ", F.nullif("notes", F.lit("")), F.nullif("_note", F.lit(""))))
    else:
        d = d.withColumn("_title", F.lit(None).cast("string")).withColumn("kind", F.lit("")).withColumn("_note", F.lit(None).cast("string"))
    kind = F.coalesce("kind", F.lit(""))
    return (
        d.withColumn("kind", kind)
        .withColumn("tooling", tooling(F.col("notes"), F.col("kind"), F.col("scenario")))
        .withColumn("goal", goal(F.col("tooling"), F.col("kind"), F.col("scenario")))
        .withColumn("language", scenario_language(F.col("fixture"), F.col("scenario")))
        .withColumn("title", F.coalesce("_title", scenario_title(F.col("kind"), F.col("fixture"), F.col("scenario"))))
        .drop("_title", "_note")
    )


def latest_run(runs: DataFrame, results: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Rows of the newest run, classified, with the task catalogue joined in."""
    newest = runs.agg(F.max(F.struct("created_at", "run_id")).alias("m")).select(F.col("m.run_id").alias("run_id"))
    return classify_scenarios(results.join(newest, "run_id", "left_semi"), tasks)


HISTORY_ROWS = 20


def scenario_history(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The last 20 runs of each scenario with best delta and savings."""
    classic, compact, hybrid = _tokens()
    j = results.join(runs.select("run_id", "created_at"), "run_id")
    tie = [F.col("event_id")] if "event_id" in results.columns else [F.col("fixture")]
    kept = top_k(j, ["scenario"], [F.col("created_at").desc(), F.col("run_id").desc(), *tie], HISTORY_ROWS)
    return kept.select(
        "scenario", "rank", "created_at", tx.short_run(F.col("run_id")).alias("run"), passed().alias("passed"),
        classic.alias("classic"), compact.alias("compact"), hybrid.alias("hybrid"),
        tx.best_delta(classic, compact, hybrid).alias("best_delta"),
        tx.savings_pct(classic, compact, hybrid).alias("savings_pct"),
    )


MANY_FILES = 20
HIGH_BUDGET = 2200


def quality_guard(files: DataFrame, req: DataFrame, changed: DataFrame) -> DataFrame:
    """Warnings per request: high budget, many changed files, changed files not indexed.

    ``req(query_id, token_budget)``, ``changed(query_id, path)``.
    """
    known = files.select(F.lower("file_path").alias("_p")).distinct()
    c = changed.withColumn("_p", F.lower("path"))
    n = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    missing = c.join(known, "_p", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("missing"))
    budget = F.when(F.coalesce("token_budget", F.lit(0)) <= 0, 1200).otherwise(F.col("token_budget"))
    warnings = F.array_compact(F.array(
        F.when(budget > HIGH_BUDGET, F.lit("Token budget is high; prefer compact/balanced retrieval for iteration.")),
        F.when(F.col("n") > MANY_FILES, F.lit("Large changed file set; run scoped diagnostics and test-map first.")),
        F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" changed file(s) are not indexed yet."))),
    ))
    return req.join(n, "query_id", "left").join(missing, "query_id", "left").select(
        "query_id", F.posexplode(warnings).alias("pos", "warning")
    )


def dict_encode(df: DataFrame, cols, key: str = "query_id"):
    """(dictionary, rows): string columns replaced by their index in a sorted dictionary per result.

    Values are distinct ignoring case and indexed from 0 in that order.  A
    result is a bounded answer, so its dictionary is small.
    """
    dictionary, rows = None, df
    for c in cols:
        values = df.groupBy(key, F.lower(c).alias("_v")).agg(F.min(c).alias("value"))
        from pyspark.sql.window import Window

        indexed = values.withColumn("idx", (F.row_number().over(Window.partitionBy(key).orderBy("_v")) - 1))
        rows = rows.withColumn("_v", F.lower(c)).join(indexed.select(key, "_v", F.col("idx").alias("_idx")), [key, "_v"], "left").drop("_v", c).withColumnRenamed("_idx", c)
        part = indexed.select(key, F.lit(c).alias("dict"), "idx", "value")
        dictionary = part if dictionary is None else dictionary.unionByName(part)
    return dictionary, rows


def dict_encode_tables(tables: dict[str, tuple[DataFrame, dict[str, str]]], key: str = "query_id"):
    """(dictionary, tables): like ``dict_encode`` with dictionaries that several tables of an answer share.

    ``tables`` holds, by name, rows and the dictionary of each column to encode: the ids of nodes and both ends of edges, say, stand in one.
    """
    from pyspark.sql.window import Window

    values = None
    for df, columns in tables.values():
        for c, name in columns.items():
            part = df.select(key, F.lit(name).alias("dict"), F.lower(c).alias("_v"), F.col(c).alias("value")).filter(F.col(c).isNotNull())
            values = part if values is None else values.unionByName(part)
    distinct = values.groupBy(key, "dict", "_v").agg(F.min("value").alias("value"))
    indexed = cut(distinct.withColumn("idx", F.row_number().over(Window.partitionBy(key, "dict").orderBy("_v")) - 1))
    encoded = {}
    for name, (df, columns) in tables.items():
        for c, of in columns.items():
            at = indexed.filter(F.col("dict") == of).select(key, "_v", F.col("idx").alias("_idx"))
            df = df.withColumn("_v", F.lower(c)).join(at, [key, "_v"], "left").drop("_v", c).withColumnRenamed("_idx", c)
        encoded[name] = df
    return indexed.drop("_v"), encoded


def dict_decode(df: DataFrame, dictionary: DataFrame, columns: dict[str, str], key: str = "query_id") -> DataFrame:
    """The values back in the place of their indexes."""
    for c, of in columns.items():
        at = dictionary.filter(F.col("dict") == of).select(key, F.col("idx").alias(c), F.col("value").alias("_value"))
        df = df.join(at, [key, c], "left").drop(c).withColumnRenamed("_value", c)
    return df


def category_tags(flaky: Column) -> Column:
    """Every category a flagged and classified row belongs to."""
    return F.array_compact(F.array(
        F.concat(F.lit("goal:"), "goal"), F.concat(F.lit("tooling:"), "tooling"), F.concat(F.lit("language:"), "language"), F.lit("all"),
        F.when(F.col("winner"), F.lit("smart:winners")),
        F.when(F.col("regression"), F.lit("smart:regressions")),
        F.when(flaky, F.lit("smart:flaky")),
        F.when(F.col("needs_review"), F.lit("smart:review")),
    ))


def with_flaky(rows: DataFrame, flaky: DataFrame) -> DataFrame:
    f = flaky.select(F.lower("scenario").alias("_k"), F.lit(True).alias("flaky"))
    return rows.withColumn("_k", F.lower("scenario")).join(f, "_k", "left").drop("_k").fillna(False, ["flaky"])


def category_counts(rows: DataFrame, flaky: DataFrame) -> DataFrame:
    """Rows per category tag with pass count, mean savings and regressions."""
    return with_flaky(rows, flaky).withColumn("tag", F.explode(category_tags(F.col("flaky")))).groupBy("tag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("passed").cast("int")).alias("passed"),
        F.avg("savings_pct").alias("avg_savings"),
        F.sum(F.col("regression").cast("int")).alias("regressions"),
    )


def filter_scenarios(rows: DataFrame, flaky: DataFrame, tag: str = "all", search: str = "", ordered: bool = True) -> DataFrame:
    """Rows of a category whose text holds the search, regressions first, then best delta and title."""
    tagged = with_flaky(rows, flaky).filter(F.array_contains(category_tags(F.col("flaky")), tag))
    if search.strip():
        hay = F.concat_ws(" ", "scenario", "title", "fixture", "tooling", "goal", "language")
        tagged = tagged.filter(tx.icontains(hay, F.lit(search.strip())))
    if not ordered:
        return tagged
    return tagged.orderBy(F.col("regression").desc(), F.col("best_delta").desc(), F.lower("title"), F.lower("scenario"))


def subset_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = ids.select(F.lower("id").alias("_k")).distinct()
    return tasks.withColumn("_k", F.lower("id")).join(chosen, "_k", "left_semi").drop("_k")


def hotspots(files: DataFrame, symbols: DataFrame, file_imports: DataFrame) -> DataFrame:
    """Symbols and import in-degree per file and per folder level."""
    s = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))
    i = file_imports.select("from_file", "to_file").distinct().groupBy(F.col("to_file").alias("file_path")).agg(F.count(F.lit(1)).alias("imported_by"))
    per = files.select("file_path").distinct().join(s, "file_path", "left").join(i, "file_path", "left").fillna(0, ["symbols", "imported_by"])
    parts = F.split("file_path", "/")
    levels = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return per.withColumn("path", F.explode(levels)).groupBy("path").agg(
        F.max(F.col("path") == F.col("file_path")).alias("is_file"),
        F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.sum("imported_by").alias("imported_by"),
    )


def scenario_detail(modes: DataFrame, steps: DataFrame, req: DataFrame):
    """Mode rows (classic, compact, hybrid) and numbered steps of the requested (run, scenario, fixture)."""
    key = ["run_id", "scenario", "fixture"]
    asked = req.select(*key).distinct()
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    num = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    place = F.when(F.col("mode") == "classic", 0).when(F.col("mode") == "compact", 1).otherwise(2)
    m = modes.join(asked, key, "left_semi")
    for c in ("input", "output"):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast("string"))
    m = m.select(*key, place.alias("pos"), "mode", text("input"), text("output"), num("tokens"), num("calls"), num("elapsed_ms"), "success", text("notes"))
    s = steps.join(asked, key, "left_semi").select(
        *key, "step_no", "mode", "operation", num("tokens"), num("elapsed_ms"), "status", text("input"), text("output"), text("notes")
    )
    return m, s


