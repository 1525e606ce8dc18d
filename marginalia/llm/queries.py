"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import warc
from marginalia.llm.common import new_path, table
from marginalia.llm.conversations import conversation_key, damaged, repair, transcript_hashes
from marginalia.llm.decontaminate import leaks
from marginalia.llm.fill_middle import fill_in_middle, restore
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.minhash import minhash_duplicates
from marginalia.llm.mixing import mix_sources
from marginalia.llm.ngram_join import ngram_join, ngram_links
from marginalia.llm.quality import quality_rules
from marginalia.llm.sharding import ring_shards
from marginalia.llm.substring_dedup import substring_dedup
from marginalia.llm.token_counts import token_counts
from marginalia.llm.toxicity import fit, toxicity

#: The public vocabulary that op7 counts with, by its name in the tokenizers package.
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = ring_shards(table(spark, sf_dir, "documents"), shards=40)
    return shards.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "start", "hamming", F.round("similarity", 9).alias("similarity"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_bundles(table(spark, sf_dir, "pages"), path)
    return warc.read_bundles(spark, path)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)
    return joined.select("row.doc_id", "n_shingles", "component_id")


def ngram_links_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_links(table(spark, sf_dir, "documents"), n=3, percent=90)
    return linked.select("row.doc_id", "n_shingles", "n_links")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), public_tokenizers.path(TOKENIZER))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"), length=35)
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    weights = fit(docs, labels.filter(fold != 0))
    scored = toxicity(docs, weights).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    turns, found = repair(damaged(given))
    every = given.select("conv_id").distinct().withColumn("conv", conversation_key())
    joined = every.join(found.drop("conv_id"), "conv", "left").join(transcript_hashes(turns), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)
    return found.select("row.doc_id", "n_shingles", "component_id", "kept")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    restored = restore(fill_in_middle(table(spark, sf_dir, "documents"), seed=1))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return restored.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "ngram_links": ngram_links_of_documents,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash": op12_minhash,
    "op13_fill_middle": op13_fill_middle,
}
