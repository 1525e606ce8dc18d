"""The readers as streams of new files; decoding is stateless, so the batch plans run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import from_uri, local_path
from marginalia.sources.clippings import SEPARATOR, parse_entries
from marginalia.sources.corpus import decode_all

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_clippings(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of clippings text as its files arrive; a stream has no numbers for the entries of a split, so rec_ord is null."""
    entries = spark.readStream.option("lineSep", SEPARATOR).text(path)
    source = local_path(from_uri(F.col("_metadata.file_path")))
    place = F.lpad(F.col("_metadata.file_block_start").cast("string"), 16, "0")
    return parse_entries(entries.select("value", source.alias("source_file"), F.concat_ws("#", source, place).alias("file_ord"), F.lit(None).cast("bigint").alias("rec_ord")))


def stream_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of yjr, yjf and mbp files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[yY][jJ][rR],[yY][jJ][fF],[mM][bB][pP]}").load(path)
    return decode_all(files.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "content"))
