"""Counts over annotations and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.enrich import needs_text


def ingest_totals(annotations: DataFrame, indexes: DataFrame) -> DataFrame:
    """(source, n): how many annotations and page indexes there are."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return count(annotations, "annotations").unionByName(count(indexes, "page_indexes"))


def fill_metrics(before: DataFrame, after: DataFrame, key: str = "event_id", group: str = "sidecar_dir") -> DataFrame:
    """Per group: n, reported (the count as exports report it: rows that end other than in a tag, less the rows that
    had no tag before) and filled (rows whose content really changed)."""
    was = before.select(F.col(key).alias("_k"), F.col("content").alias("_was"), needs_text().alias("_needs"))
    tagged = F.startswith("_was", F.lit("["))
    done = (F.col("content") != "") & ~F.endswith("content", F.lit("]"))
    joined = after.join(was, after[key] == was["_k"])
    return joined.groupBy(group).agg(
        F.count("*").alias("n"),
        (F.count_if(done) - (F.count("*") - F.count_if(tagged))).alias("reported"),
        F.count_if(F.col("_needs") & ~F.col("content").eqNullSafe(F.col("_was"))).alias("filled"),
    )


def page_coverage(annotations: DataFrame, page_map: DataFrame, location_map: DataFrame) -> DataFrame:
    """Per book: n, paged (rows with a page), first_page and last_page of its map, locations."""
    at = F.struct("char_offset", "ordinal")
    maps = page_map.groupBy("book_id").agg(F.min_by("label", at).alias("first_page"), F.max_by("label", at).alias("last_page"))
    places = location_map.groupBy("book_id").agg(F.count("*").alias("locations"))
    return annotations.groupBy("book_id").agg(F.count("*").alias("n"), F.count("page").alias("paged")).join(maps, "book_id", "left").join(places, "book_id", "left")
