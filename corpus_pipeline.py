"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them back for the next.

In all stages documents may have null ids, texts, languages and sources, texts of any length, equal ids and rows, and further
columns of any names, which stay; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, saved, table
from marginalia.llm.decontaminate import decontaminate
from marginalia.llm.mixing import mix_sources
from marginalia.llm.ngram_join import one_of_each
from marginalia.llm.quality import reject_outliers
from marginalia.llm.sharding import ring_shards

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within the outlier cutoff of their language and source.

    Null and empty texts fail the base rule; equal texts of one language and source share their verdict.
    """
    return reject_outliers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8: that of the smallest doc_id (null last), then of the least text hash.

    Texts without words are in no class and all stay; of rows that repeat id and text one stays.
    """
    return one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; texts without words hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts without words have size 0 and are taken with their source's complete epochs; rows equal in id and text are taken as any other.
    """
    mixed = mix_sources(docs, tuple(docs.columns))
    return mixed.filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it; these columns get underscores before their names where documents have such columns."""
    shard, slot = fresh(docs, "shard", "slot")
    return ring_shards(docs, tuple(docs.columns), shards=SHARDS).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: Estimates by iteration and shingle joins are not expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
