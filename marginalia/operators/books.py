"""Book tables: text from chunks, the assembled place of every chunk, page map from navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along_book() -> WindowSpec:
    return Window.partitionBy("book_id").orderBy("pid", "ordinal")


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """``chunks`` (book_id, ordinal, pid, length, text) that have text, with gap (missing characters before), start and end.

    gap looks at the previous chunk's end only; start and end are places in the assembled text, where later text is
    never cut for an overlap but moves on.
    """
    order = along_book()
    before = F.coalesce(F.lag(F.col("pid") + F.col("length")).over(order), F.lit(0))
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        chunks.filter("text is not null and text <> ''")
        .withColumn("_n", F.length("text"))  # below the windows, so that they carry texts only where these are asked for
        .withColumn("gap", F.greatest(F.lit(0), F.col("pid") - before).cast("bigint"))
        .withColumn("end", F.sum(F.col("gap") + F.col("_n")).over(until))
        .withColumn("start", F.col("end") - F.col("_n"))
        .drop("_n")
    )


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_gaps`` with n: the chunk's number in its book, from 1 without gaps. (pid, ordinal) is a chunk's own in its book."""
    return chunk_gaps(chunks).withColumn("n", F.row_number().over(along_book()))


def assemble_text(chunks: DataFrame) -> DataFrame:
    """(book_id, text): chunks in order, gaps filled with spaces. One book per row: for books that fit in a row."""
    piece = F.struct("start", "ordinal", F.concat(F.repeat(F.lit(" "), F.col("gap").cast("int")), "text").alias("piece"))
    return chunk_gaps(chunks).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "").alias("text"))


def page_map_from_nav(nav: DataFrame, positions: DataFrame) -> DataFrame:
    """(book_id, ordinal, label, char_offset) from ``nav`` (book_id, containers) and ``positions`` (book_id, element_id, base).

    containers: array of (type, entries), entries: array of (label, element_id, offset). Only page lists count; entries
    without a label or a position are dropped; ordinal is the stable order by offset.
    """
    entries = (
        nav.select("book_id", F.posexplode("containers").alias("c", "container"))
        .filter("container.type = 'page_list'")
        .select("book_id", "c", F.posexplode("container.entries").alias("e", "entry"))
        .select("book_id", "c", "e", "entry.label", "entry.element_id", F.coalesce("entry.offset", F.lit(0)).alias("offset"))
        .filter("label <> ''")
    )
    order = Window.partitionBy("book_id").orderBy("char_offset", "c", "e")
    return (
        entries.join(positions, ["book_id", "element_id"])
        .withColumn("char_offset", F.col("base") + F.col("offset"))
        .filter("char_offset is not null")
        .select("book_id", (F.row_number().over(order) - 1).alias("ordinal"), "label", "char_offset")
    )
