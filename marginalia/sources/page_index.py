"""Page indexes: a little-endian header, JSON metadata and the offsets of the printed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.binary import bound, uint_le
from marginalia.functions.text import utf8
from marginalia.sources.files import read_files

#: Fixed values of the format: the shortest file, the bytes searched for the opening brace, the bound under which the first word is a count.
SHORTEST, SEARCHED, COUNT_BOUND = 8, 256, 100_000


def decode_page_indexes(files: DataFrame) -> DataFrame:
    """(asin, content_guid, page_count, page_offsets, source_file) of ``files`` (path, content) of 8 bytes or more."""
    brace = f"locate('{{', decode(substring(content, 9, cast(least(data_at - 8, {SEARCHED}) as int)), 'ISO-8859-1'))"
    json_bytes = F.expr(f"case when version in (1, 2) and data_at < length(content) and data_at > 8 then substring(content, cast(8 + greatest({brace}, 1) as int), cast(data_at - 7 - greatest({brace}, 1) as int)) end")
    head = F.from_json(F.regexp_replace(utf8(json_bytes), "\\x00+\\z", ""), "asin string, contentGuid string, pageCount bigint")
    first = f"case when data_at + 4 <= length(content) then {uint_le('content', 'cast(data_at + 1 as int)', 4)} end"
    # One struct is bound, so that neither the bytes nor the offset are computed again for every page.
    numbers = f"transform(case when s.n > 0 then sequence(0, cast(s.n - 1 as int)) else cast(array() as array<int>) end, i -> {uint_le('s.c', 's.at + 1 + 4 * i', 4)})"
    offsets = bound("named_struct('c', content, 'at', cast(at as int), 'n', n)", "s", numbers)
    return (
        files.filter(F.length("content") >= SHORTEST)
        .select("path", "content", F.expr(uint_le("content", "1", 4)).alias("version"), F.expr(uint_le("content", "5", 4)).alias("data_at"))
        .withColumns({"head": head, "first": F.expr(first)})
        .withColumn("counted", F.coalesce(F.col("first") < COUNT_BOUND, F.lit(False)))
        .withColumn("at", F.col("data_at") + F.when(F.col("counted"), 4).otherwise(0))
        .withColumn("n", F.greatest(F.lit(0), F.floor((F.length("content") - F.col("at")) / 4)))
        .select(
            F.coalesce("head.asin", F.lit("")).alias("asin"),
            F.coalesce("head.contentGuid", F.lit("")).alias("content_guid"),
            F.coalesce(F.nullif(F.col("head.pageCount"), F.lit(0)), F.when(F.col("counted"), F.col("first")), F.lit(0)).cast("bigint").alias("page_count"),
            F.expr(offsets).alias("page_offsets"),
            F.col("path").alias("source_file"),
        )
    )


def page_offsets(indexes: DataFrame) -> DataFrame:
    """One row per printed page: (source_file, asin, page, char_offset), pages counted from 1.

    The outer form of explode: before the inner one Spark filters by the array's size, and so decodes every file twice.
    """
    return indexes.select("source_file", "asin", F.posexplode_outer("page_offsets").alias("i", "char_offset")).filter("i is not null").select("source_file", "asin", (F.col("i") + 1).alias("page"), "char_offset")


def read_page_indexes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_page_indexes(read_files(spark, path, "*.[aA][pP][nN][xX]"))
