"""Line deduplication with a log-template tree.

A line is parsed to a fixed depth: its token count and its leading tokens, with tokens that hold digits or an at sign masked, lead
to a leaf. Within a leaf the most frequent token of every position makes the leaf's pattern; lines that agree with it in enough positions
are one template whose other positions are variable fields, and any other line is a template by itself. A template that recurs in
``min_docs`` documents is dropped from all of them but the first (least ``doc_id``), where it stays.

With ``split``, the lines of a leaf that do not fit are divided by their token at the position where the tokens differ and concentrate
most, and each part gets its own pattern, until no part with lines enough for ``min_docs`` documents is left: rarer templates beside a
frequent one are found too. With ``short``, lines below ``min_tokens`` that hold a letter recur as they stand (digits unmasked). The
query ``op3_line_dedup`` is bound to its SQL and uses neither; the pipeline uses both.

Only hashes of all lines are shuffled; tokens travel once per distinct line, and only for leaves in which several documents have different
lines.

Defined results: null texts stay null and have no lines; without ``short``, lines with fewer than ``min_tokens`` tokens never go; a text may become empty but
its row stays; rows equal in ``doc_id`` and text are one document; null ``doc_id`` sorts last; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.plans.lineage import cut

DEPTH = 3  # leading tokens on the way to a leaf
MIN_TOKENS = 5
MIN_DOCS = 3
SIMILARITY = 0.8
VARIABLE = r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+"
SPACES = " \t\r\x0b\x0c"


def normal(line: Column) -> Column:
    """A line with single spaces between its tokens, those with a digit or an at sign as ``<*>``; most lines need neither pattern."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.contains(line, F.lit("  "))
    for c in SPACES[1:]:
        odd = odd | F.contains(line, F.lit(c))
    even = F.when(odd, F.regexp_replace(F.btrim(line, F.lit(SPACES)), r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    return F.when(line.rlike("[0-9@]"), F.regexp_replace(even, VARIABLE, "<*>")).otherwise(even)


def line_keys(docs: DataFrame, depth: int, min_tokens: int, short: bool = False) -> DataFrame:
    """doc_id, text_hash, line_no, leaf and line (hash of the normal form) of every line that is long enough, or ``short`` with a letter."""
    # outer: else Spark would split the text twice to leave out empty arrays
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "text_hash", "line_no", normal(F.col("raw")).alias("m"), *([F.btrim("raw", F.lit(SPACES)).alias("bare")] if short else []))
    n_tokens = F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "))) + 1
    lines = lines.withColumn("n_tokens", n_tokens)
    leaf, line = F.xxhash64("n_tokens", F.substring_index("m", " ", depth)), F.xxhash64("m")
    long = F.col("n_tokens") >= min_tokens
    if short:
        # a leaf of its own for every short line
        leaf, line = F.when(long, leaf).otherwise(F.xxhash64(F.lit("short"), "bare")), F.when(long, line).otherwise(F.xxhash64("bare"))
        long = long | F.col("bare").rlike(r"\p{L}")
    return lines.where(long & (F.col("m") != "")).select("doc_id", "text_hash", "line_no", leaf.alias("leaf"), line.alias("line"))


def _fits(lines: DataFrame, by: str, similarity: float) -> DataFrame:
    """``lines`` with ``fits``: whether the most frequent tokens of their group agree with enough of theirs."""
    votes = lines.select(by, "weight", F.posexplode("tokens").alias("at", "token")).groupBy(by, "at", "token").agg(F.sum("weight").alias("n"))
    top = votes.groupBy(by, "at").agg(F.max(F.struct("n", "token"))["token"].alias("token"))
    pattern = top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("pattern"))
    agree = F.aggregate(F.zip_with("tokens", "pattern", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return lines.join(pattern, by).select(*lines.columns, (agree >= similarity * F.size("tokens")).alias("fits"))


def split_templates(rest: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """leaf, line, template of the lines of ``rest`` (leaf, line, weight, tokens: what fits no pattern of its leaf) that fit one of a part of it."""
    found, rest = [], rest.withColumn("part", F.col("leaf"))
    while True:
        votes = rest.select("part", "weight", F.posexplode("tokens").alias("at", "token")).groupBy("part", "at", "token").agg(F.sum("weight").cast("double").alias("n"))
        spots = votes.groupBy("part", "at").agg(F.sum(F.col("n") * F.col("n")).alias("mass"), F.count(F.lit(1)).alias("n_tokens")).where("n_tokens > 1")
        spot = spots.groupBy("part").agg(F.max_by("at", F.struct("mass", -F.col("at"))).alias("at"))
        parts = rest.join(spot, "part").withColumn("part", F.xxhash64("part", "at", F.get("tokens", F.col("at")))).drop("at")
        parts = cut(parts)
        # a single line is a template by itself already
        several = parts.groupBy("part").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("n_lines")).where((F.col("n") >= min_docs) & (F.col("n_lines") > 1))
        judged = cut(_fits(parts.join(several.select("part"), "part", "left_semi"), "part", similarity))
        if judged.isEmpty():
            break
        found.append(judged.where("fits").select("leaf", "line", F.xxhash64("part").alias("template")))
        rest = judged.where("not fits").drop("fits")
    out = rest.select("leaf", "line", F.col("part").alias("template")).limit(0)
    for f in found:
        out = out.union(f)
    return out


def templates(docs: DataFrame, keys: DataFrame, similarity: float, split: bool = False, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf, line, template of the lines whose leaf several documents reach."""
    doc = F.struct("doc_id", "text_hash")
    leaves = keys.groupBy("leaf").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.min("line").alias("line"), F.max("line").alias("other"))
    shared = cut(leaves.where(~F.col("a").eqNullSafe(F.col("b"))).select("leaf", "line", (F.col("line") != F.col("other")).alias("several")))
    # one document per distinct line hands its tokens over; a leaf of one line needs none
    distinct = keys.join(shared.where("several").select("leaf"), "leaf", "left_semi").groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "text_hash", "line_no")).alias("at")
    )
    wanted = distinct.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash")).agg(
        F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "leaf", "line", "weight")).alias("wanted")
    )
    wanted = cut(wanted)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    met = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    handed = met.select(F.split("text", "\n").alias("lines"), "wanted").select("lines", F.explode("wanted").alias("w"))
    tokens = F.split(normal(F.get("lines", F.col("w.line_no"))), " ")
    open_lines = cut(handed.select("w.leaf", "w.line", "w.weight", tokens.alias("tokens")).dropDuplicates(["leaf", "line"]))
    judged = _fits(open_lines, "leaf", similarity)
    alone = shared.where("not several").select("leaf", "line", F.lit(True).alias("fits"))
    template = F.when(F.col("fits"), F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", "line"))
    if not split:
        return judged.select("leaf", "line", "fits").union(alone).select("leaf", "line", template.alias("template"))
    judged = cut(judged)
    more = split_templates(judged.where("not fits").drop("fits"), similarity, min_docs).withColumnRenamed("template", "own")
    first = judged.select("leaf", "line", "fits").union(alone)
    return first.join(more, ["leaf", "line"], "left").select("leaf", "line", F.coalesce("own", template).alias("template"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, split: bool = False, short: bool = False) -> DataFrame:
    """doc_id, text_hash and ``dropped`` (ascending line numbers from 0) of the documents that lose lines."""
    keys = cut(line_keys(docs, depth, min_tokens, short))
    of_line = cut(templates(docs, keys, similarity, split, min_docs))
    met = cut(keys.join(of_line, ["leaf", "line"]).select("doc_id", "text_hash", "line_no", "template"))
    per_doc = met.groupBy("template", "doc_id", "text_hash").agg(F.lit(1).alias("one"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    recurring = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min(order).alias("first")).where(F.col("n_docs") >= min_docs)
    recurring = cut(recurring.select("template", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = met.join(recurring, "template").where(~stays)
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, split: bool = False, short: bool = False) -> DataFrame:
    """Columns ``row`` (the input row as a struct), ``kept_text``, ``n_lines`` and ``n_dropped``. The text column is ``text``."""
    gone = cut(dropped_lines(docs, depth, min_tokens, min_docs, similarity, split, short)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_h"))
    met = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    split = met.select("row", "dropped", F.split("row.text", "\n").alias("lines"))
    # one flag per line up to the last dropped one: false for each line passed over, then true
    passed = lambda x, i: x - F.coalesce(F.get(F.col("dropped"), i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("dropped", lambda x, i: F.concat(F.array_repeat(F.lit(False), passed(x, i)), F.array(F.lit(True)))))
    flagged = split.select("row", "lines", "dropped", flags.alias("flags"))
    left = F.filter("lines", lambda line, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False)))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return flagged.select("row", text.alias("kept_text"), size("lines").alias("n_lines"), size("dropped").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text`` and ``n_chars``, where there is one, counted anew."""
    out = drop_recurring(docs, **parameters)
    replaced = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in docs.columns])
