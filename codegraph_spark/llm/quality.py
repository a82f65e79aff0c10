"""Quality rules with robust multivariate outliers.

Counts per document are transformed to a statistic vector. Per language and source, the minimum covariance determinant gives a centre
and a covariance that outliers do not bend: from several starts, the rows nearest to the current estimate (``SUBSET`` of them) give the
next one, and the start that ends with the least determinant counts. Documents whose squared Mahalanobis distance, scaled so that its
median is that of a chi-squared variable, exceeds ``CUTOFF`` are rejected, like those that fail the base rules.

Groups with fewer than ``MIN_GROUP`` texts are pooled by language, then altogether; where that stays small, the estimate of the whole language
judges them, then that of all rows. Only a table with fewer texts than that altogether is left to the base rules. Copies of a text count once
in the estimates. These are sums and quantile sketches per group, so a group may hold any share of the rows.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources are values like any other;
documents that fail the base rules take no part in the estimates and have no distance; repeated rows are judged each; other columns do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.llm.small import beside
from codegraph_spark.plans.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: a line with a word, from its start; every character is looked at once
LINE = r"(?<![^\n])[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words in repeated 3-word windows
MIN_GROUP = 50
SUBSET = 0.75
STEPS = 3
CUTOFF = 80.0
LEAST_SCALE = 0.2  # varied groups have 0.22 and more; without it, near copies that fill half a group would make its other texts outliers
ACCURACY = 10_000  # of the quantile sketches
# Medians of the chi-squared distribution with 1 to 8 degrees of freedom.
CHI2_MEDIAN = [0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481, 6.3458, 7.3441]
#: statistic and the least standard deviation that it is given
FEATURES = [("log_words", 0.3), ("log_length", 0.05), ("symbols", 0.1), ("dup_lines", 0.2), ("repeats", 0.15)]


def counts(docs: DataFrame) -> DataFrame:
    """``row`` (the input row as a struct), the base counts, ``n_lines`` (lines with a word), ``text_hash`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), text.alias("body"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    n = F.size("words")
    b = a.select(
        "row", "text_hash",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_extract_all("body", F.lit(LINE), F.lit(0)).alias("lines"),
        F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))).alias("windows"),
    )
    c = b.select(
        "row", "text_hash", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"),
    )
    numbered = F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), F.size("windows") - 1).alias("i"))
    d = c.withColumn("windows", F.when(F.col("windows").isNotNull(), F.sort_array(numbered)))
    neighbours = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    n = F.size("windows") - 1
    twice = F.flatten(F.array_compact(F.zip_with(F.slice("windows", 1, n), F.slice("windows", 2, n), neighbours)))
    e = d.withColumn("windows", F.sort_array(F.array_distinct(twice)))
    m = F.size("windows")
    gaps = F.zip_with(F.slice("windows", 1, F.greatest(m - 1, F.lit(0))), F.slice("windows", 2, F.greatest(m - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(3)))
    repeated = F.when(F.col("windows").isNull() | (m < 1), 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    out = e.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "n_lines", "text_hash")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed statistic vector of a row with counts; ratios by their root, sizes by their logarithm."""
    some = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [
        F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        some("n_symbols", "word_chars"), some("n_dup_lines", "n_lines"), some("n_repeat_words", "n_words"),
    ]
    return [v.cast("double").alias(name) for v, (name, _) in zip(values, FEATURES, strict=True)]


def grouped(rows: DataFrame, language: str, source: str, min_group: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``g``, once for every group whose estimate they belong to, and the group that judges each language and source.

    That is the pair itself; where it is small, the pool of the language's small ones, then of all still small ones; where that is small too,
    all rows of the language, then all rows. It is null only where there are fewer than ``min_group`` rows altogether.
    """
    sizes = rows.groupBy(language, source).agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    by_language = Window.partitionBy(language)
    sizes = sizes.withColumn("small", F.col("n") < min_group).withColumn("pool", F.sum(F.when(F.col("small"), F.col("n"))).over(by_language))
    sizes = sizes.withColumn("lost", F.col("small") & (F.col("pool") < min_group)).withColumn("total", F.sum("n").over(by_language))
    sizes = sizes.withColumn("rare", F.col("lost") & (F.col("total") < min_group)).withColumn("lends", F.max(F.col("lost") & ~F.col("rare")).over(by_language))
    sizes = cut(sizes)
    lost_n, rare_n, all_n = sizes.agg(F.sum(F.when(F.col("lost"), F.col("n"))), F.sum(F.when(F.col("rare"), F.col("n"))), F.sum("n")).first()
    pooled = (lost_n or 0) >= min_group
    whole, everything = F.to_json(F.array(name(language), F.lit("*"))), F.when(F.lit((all_n or 0) >= min_group), F.lit('["*","*"]'))
    own = F.when(~F.col("small"), F.to_json(F.array(name(language), name(source)))).when(~F.col("lost"), F.to_json(F.array(name(language))))
    own = own.when(F.lit(pooled), F.lit("[]"))
    fits = F.array(own, F.when(F.col("lends") & F.lit(not pooled), whole), F.when(F.lit(bool(rare_n) and not pooled), everything))
    g = F.coalesce(own, F.when(~F.col("rare"), whole), everything)
    place = cut(sizes.select(F.col(language).alias("_l"), F.col(source).alias("_s"), g.alias("g"), F.array_compact(fits).alias("fits")))
    keys = beside(place.select("_l", "_s", "fits"))
    met = rows.join(keys, rows[language].eqNullSafe(keys["_l"]) & rows[source].eqNullSafe(keys["_s"])).drop("_l", "_s")
    return met.select(*rows.columns, F.explode("fits").alias("g")), place.select("_l", "_s", "g")


def _estimate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, lower Cholesky factor of the covariance and log-determinant per group, from the rows given."""
    names = [f for f, _ in FEATURES]
    p = len(names)
    moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(names)]
    moments += [F.coalesce(F.covar_samp(names[i], names[j]), F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*by).agg(*moments)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            if i == j:
                floor = F.lit(FEATURES[i][1] ** 2)
                out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest + floor, floor)))
            else:
                out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0))
    return cut(out.select(*by, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], det.alias("log_det")))


def _distance(rows: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to their group's estimate."""
    out = rows.join(beside(estimate), by)
    for i, (f, _) in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(FEATURES))), F.lit(0.0))
    return out.select(*rows.columns, "log_det", d2.alias("d2"))


def _nearest(rows: DataFrame, by: list[str], subset: float) -> DataFrame:
    """The rows of every group with a distance up to its ``subset`` quantile."""
    edge = cut(rows.groupBy(*by).agg(F.percentile_approx("d2", subset, ACCURACY).alias("edge")))
    return rows.join(beside(edge), by).where("d2 <= edge").drop("edge", "d2", "log_det")


def robust_estimates(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``g``, with ``scale``: what squared distances are divided by.

    Starts: rows near the medians in all statistics, near them in all but the size, and a half drawn by hash.
    """
    names = [f for f, _ in FEATURES]
    centre = cut(rows.groupBy("g").agg(*[F.percentile_approx(f, 0.5, ACCURACY).alias(f"med{i}") for i, f in enumerate(names)]))
    off = rows.join(beside(centre), "g").select(*rows.columns, *[F.abs(F.col(f) - F.col(f"med{i}")).alias(f"dev{i}") for i, f in enumerate(names)])
    spread = cut(off.groupBy("g").agg(*[F.percentile_approx(f"dev{i}", 0.5, ACCURACY).alias(f"mad{i}") for i in range(len(names))]))
    z2 = [F.pow(F.col(f"dev{i}") / (1.4826 * F.col(f"mad{i}") + F.lit(floor)), 2) for i, (_, floor) in enumerate(FEATURES)]
    drawn = F.pmod(F.xxhash64(*names), F.lit(1 << 20)).cast("double")
    starts = F.array(sum(z2, F.lit(0.0)), sum(z2[1:], F.lit(0.0)), drawn)
    started = off.join(beside(spread), "g").select("g", *names, F.posexplode(starts).alias("start", "d2")).withColumn("log_det", F.lit(0.0))
    by = ["g", "start"]
    near = _nearest(cut(started), by, subset)
    all_rows = rows.select("g", *names, F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("start"))
    for _ in range(steps):
        estimate = _estimate(near, by)
        near = _nearest(_distance(all_rows, estimate, by), by, subset)
    estimate = _estimate(near, by)
    columns = [c for c in estimate.columns if c not in by]
    best = cut(estimate.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("e")).select("g", "e.*"))
    middle = _distance(rows, best, ["g"]).groupBy("g").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("middle"))
    scale = F.greatest(F.col("middle") / CHI2_MEDIAN[len(FEATURES) - 1], F.lit(LEAST_SCALE))
    return cut(best.join(middle, "g").withColumn("scale", scale).drop("middle"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, ``distance`` (scaled, squared; null where not tested) and kept, one row per document."""
    base = counts(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("row")[language].alias("language"), F.col("row")[source].alias("source"), F.col("*")).drop("row")
    base = cut(base.select("*", *statistics()))
    names = [f for f, _ in FEATURES]
    # a text that was copied says no more about its group than one copy
    once = base.where(~F.col("base_failed")).groupBy("language", "source", "text_hash").agg(F.min(F.struct(*names)).alias("s"))
    fit, place = grouped(cut(once.select("language", "source", "s.*")), "language", "source", min_group)
    estimates = robust_estimates(cut(fit.select("g", *names)))
    known = beside(cut(place.join(estimates, "g")))
    met = base.join(known, base["language"].eqNullSafe(known["_l"]) & base["source"].eqNullSafe(known["_s"]) & ~base["base_failed"], "left")
    for i, (f, _) in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))
        met = met.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(FEATURES))), F.lit(0.0))
    out = met.withColumn("distance", d2 / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
