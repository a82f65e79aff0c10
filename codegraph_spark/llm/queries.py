"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph_spark.llm import ann, bpe, chat, decontam, langid, licenses, linedups, merkle, mixing, oracles, quality, simhash, token_counts, trie

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048
MIX_SHARE = 0.6
MIX_EPOCHS = 2
MIX_WEIGHTS = {"domain": {"short": 1.0, "long": 2.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain():
    """Sources with one digit and with two: the two domains of the example tree."""
    return F.when(F.length("source") <= 4, "short").otherwise("long")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(exact, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(exact).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedups.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("kept_text").alias("text"), "n_lines", "n_dropped")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(chat.examples(talks.unionByName(extra)))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return out.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain(), MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS).select("doc_id", F.col("epoch").cast("long").alias("epoch"), "domain", "language", "source", "n_tokens")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    given = F.when(chosen, merkle.leaf_hash(*altered)).alias("given")
    trees = merkle.manifest(table(spark, sf_dir, "documents"), F.col("lang"), ["doc_id"], merkle.leaf_hash(*fields), ["doc_id", given])
    found = merkle.proofs(*trees)
    found = found.select("keep.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.coalesce("keep.given", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.trie(*trie.branched(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_license_scan, op3_line_dedup, op4_simhash_dedup, op5_bpe, op6_chat_format, op7_nearest, op8_token_count, op9_mix_sources, op10_quality,
        op11_merkle, op12_prefix_trie, op13_decontaminate,
    )
}
ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.license_scan(),
    "op3_line_dedup": oracles.line_dedup(),
    "op6_chat_format": oracles.chat_format(),
    "op9_mix_sources": oracles.mix_sources(MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS),
    "op11_merkle": oracles.merkle(),
    "op12_prefix_trie": oracles.prefix_trie(),
    "op13_decontaminate": oracles.decontaminate(decontam.WINDOW),
}
