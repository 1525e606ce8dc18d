"""Table schemas of the annotation engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The exported columns, in export order (fixed values).
EXPORT_COLUMNS = ("book_title", "author", "clip_type", "page", "location_start", "location_end", "added_date", "content", "source_file")
#: Kinds of annotations (fixed values).
CLIP_TYPES = ("highlight", "note", "bookmark", "last_position")

ANNOTATIONS = T.StructType(
    [
        T.StructField("book_title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("clip_type", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("location_start", T.LongType()),
        T.StructField("location_end", T.LongType()),
        T.StructField("added_date", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("added_ts", T.TimestampType()),
        T.StructField("sidecar_dir", T.StringType()),
        T.StructField("file_ord", T.StringType()),
        T.StructField("kind_ord", T.IntegerType()),
        T.StructField("rec_ord", T.LongType()),
    ]
)
PAGE_INDEXES = "asin string, content_guid string, page_count bigint, page_offsets array<bigint>, source_file string"
QUARANTINE = "source_file string, format string, reason string"


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ANNOTATIONS; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOTATIONS))
