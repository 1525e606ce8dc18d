"""The export order: by date text, then by file, kind and place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.sources.storage import saved

#: The column of a stored export that grows along the order; the bits below those of the range it stands in.
PLACE, RANGE_BITS = "place", 33


def order_keys() -> list[Column]:
    """Date texts compare as text: spelled-out dates come after all numeric ones, missing ones first."""
    return [F.coalesce("added_date", F.lit("")), F.col("file_ord"), F.col("kind_ord"), F.col("rec_ord")]


def order_key() -> Column:
    """The same order as one struct, for use in aggregates."""
    return F.struct(F.coalesce("added_date", F.lit("")).alias("date"), "file_ord", "kind_ord", "rec_ord")


def keys_of(annotations: DataFrame) -> list[Column]:
    """The columns that order ``annotations``: the place in a stored export, else ``order_keys``."""
    return [F.col(PLACE)] if PLACE in annotations.columns else order_keys()


def key_of(annotations: DataFrame) -> Column:
    return F.col(PLACE) if PLACE in annotations.columns else order_key()


def order_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.orderBy(*keys_of(annotations))


def stored_export(annotations: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(``annotations`` in export order with their place, written once; total, shown and books (approximate) of the rows written).

    All exports of the stored rows share this sort: their ranges are those of the place, and no sink computes the annotations again.
    The numbers are observed while the rows are written.
    """
    seen = Observation()
    counted = (F.count("*").alias("total"), F.count_if(F.col("clip_type") != "last_position").alias("shown"), F.approx_count_distinct("book_title").alias("books"))
    rows = saved(annotations.orderBy(*order_keys()).withColumn(PLACE, F.monotonically_increasing_id()).observe(seen, *counted), "export")
    return rows, seen.get
