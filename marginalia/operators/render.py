"""Rendered exports as tables: pruned JSON rows, CSV rows, Markdown documents, lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.order import PLACE, RANGE_BITS, key_of, keys_of, order_key, order_keys
from marginalia.schema import EXPORT_COLUMNS
from marginalia.sources.storage import saved

#: Fixed values of the text export.
RULE = "=" * 60


def shown() -> Column:
    """Last positions are left out of rendered exports."""
    return F.col("clip_type") != "last_position"


def pruned(annotations: DataFrame) -> DataFrame:
    """The export columns with empty strings as nulls, which JSON writing leaves out."""
    kinds = dict(annotations.dtypes)
    return annotations.select(*(F.nullif(c, F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in EXPORT_COLUMNS))


def json_rows(annotations: DataFrame) -> DataFrame:
    """(json): one object per annotation, without absent fields."""
    return pruned(annotations).select(F.to_json(F.struct(*EXPORT_COLUMNS)).alias("json"))


def csv_rows(annotations: DataFrame) -> DataFrame:
    """The export columns in export order."""
    return annotations.select(*EXPORT_COLUMNS)


def manifest(annotations: DataFrame, indexes: DataFrame) -> DataFrame:
    """(total_clippings, page_indexes, exported_at)."""
    total = annotations.agg(F.count("*").alias("total_clippings")).withColumn("one", F.lit(1))
    pages = indexes.agg(F.count("*").alias("page_indexes")).withColumn("one", F.lit(1))
    return total.join(pages, "one").select("total_clippings", "page_indexes", F.current_timestamp().alias("exported_at"))


def manifest_row(spark: SparkSession, total: int, indexes: int) -> DataFrame:
    """The same from counts that are known."""
    return spark.range(1).select(F.lit(total).cast("bigint").alias("total_clippings"), F.lit(indexes).cast("bigint").alias("page_indexes"), F.current_timestamp().alias("exported_at"))


def _given(c: str) -> Column:
    """True for a number that is neither null nor 0, and for a text that is neither null nor empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0") == F.lit(False)


def _location(dash: str) -> Column:
    return F.when(_given("location_start"), F.concat(F.col("location_start").cast("string"), F.when(_given("location_end"), F.concat(F.lit(dash), F.col("location_end").cast("string"))).otherwise("")))


def markdown_lines() -> Column:
    """The lines of one annotation, as one text that ends with a blank line."""
    date = F.when(F.coalesce("added_date", F.lit("")) != "", F.col("added_date"))
    meta = F.concat_ws(" | ", F.when(_given("page"), F.concat(F.lit("p. "), F.col("page").cast("string"))), F.concat(F.lit("loc. "), _location("–")), date)
    content = F.coalesce("content", F.lit(""))
    quoted = F.concat(F.lit("> "), content, F.when(meta != "", F.concat(F.lit("\n> *— "), meta, F.lit("*"))).otherwise(""), F.lit("\n"))
    note = F.concat(F.lit("**Note** ("), meta, F.lit("): "), content, F.lit("\n"))
    mark = F.concat(F.lit("*Bookmark* ("), meta, F.lit(")"), F.when(content != "", F.concat(F.lit(": "), content)).otherwise(""), F.lit("\n"))
    return F.when(F.col("clip_type") == "highlight", quoted).when(F.col("clip_type") == "note", note).when(F.col("clip_type") == "bookmark", mark).otherwise("")


def _heading() -> Column:
    return F.concat(F.lit("## "), "book_title", F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("  \n*"), "author", F.lit("*"))).otherwise(""), F.lit("\n"))


def render_markdown(annotations: DataFrame) -> DataFrame:
    """(book_title, first_seen, document): one Markdown section per book, for books whose annotations fit in a row.

    The author is that of the book's first row; a book with last positions only still has its heading.
    """
    line = F.when(shown(), markdown_lines())
    author = F.min_by("author", order_key())
    return (
        annotations.withColumn("_line", line)
        .groupBy("book_title")
        .agg(F.min(order_key()).alias("first_seen"), author.alias("author"), F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct(order_key().alias("at"), F.col("_line").alias("line"))))).alias("rows"))
        .select("book_title", "first_seen", F.concat(_heading(), F.when(F.size("rows") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).otherwise("")).alias("document"))
    )


def markdown_rows(annotations: DataFrame) -> DataFrame:
    """(first_seen, book_title, at, block): the same sections as one row for each heading and each annotation, in the order of the first three.

    Every block ends with a blank line once it is a line of a text file. No book is put together.
    """
    key = key_of(annotations)
    heads = saved(annotations.groupBy("book_title").agg(F.min(key).alias("first_seen"), F.min_by("author", key).alias("author")), "headings")
    lines = annotations.filter(shown()).select(F.col("book_title").alias("_title"), key.alias("at"), markdown_lines().alias("block"))
    placed = lines.join(heads, F.col("_title").eqNullSafe(F.col("book_title"))).select("first_seen", "book_title", "at", "block")
    return heads.select("first_seen", "book_title", F.lit(None).cast(placed.schema["at"].dataType).alias("at"), _heading().alias("block")).unionByName(placed)


def text_runs(annotations: DataFrame) -> DataFrame:
    """Shown annotations with run (1, 2, ... along the export order, a new one whenever the title changes), run_author and opens_run.

    The order runs over all books, so the rows are sorted once, by ranges of equal size, and written. Changes are found
    within the ranges, and each range hands on three things: its first and last title, its number of changes, and the author with whom
    its last run opened. A scan over these, one row per range, gives each range the run and the author that it goes on with;
    a run of many ranges is never brought together.
    """
    keys, key = keys_of(annotations), key_of(annotations)
    if PLACE in annotations.columns:  # sorted and stored already
        rows = annotations.filter(shown()).withColumn("_range", F.shiftright(PLACE, RANGE_BITS))
    else:
        rows = saved(annotations.filter(shown()).orderBy(*order_keys()).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*keys)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(inside) == 1
    rows = rows.withColumns({"_first": first, "_new": F.when(first, F.lit(False)).otherwise(~F.col("book_title").eqNullSafe(F.lag("book_title").over(inside)))})
    opened = F.when(F.col("_first") | F.col("_new"), F.struct("author"))  # a struct, as the author may be null
    rows = rows.withColumns({"_n": F.sum(F.col("_new").cast("bigint")).over(until), "_opened": F.last(opened, ignorenulls=True).over(until)})
    ranges = rows.groupBy("_range").agg(
        F.min_by("book_title", key).alias("head"),
        F.max_by("book_title", key).alias("tail"),
        F.max("_n").alias("n"),
        F.min_by("_opened", key).alias("head_author"),
        F.max_by("_opened", key).alias("tail_author"),
    )
    whole = Window.partitionBy(F.lit(0)).orderBy("_range")
    opens = F.lag(F.lit(1)).over(whole).isNull() | ~F.col("head").eqNullSafe(F.lag("tail").over(whole))
    ranges = ranges.withColumn("_opens", opens)
    base = F.sum(F.col("_opens").cast("bigint") + F.col("n")).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    handed_on = F.last(F.when(F.col("_opens") | (F.col("n") > 0), F.col("tail_author")), ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_range", "_opens", base.alias("_base"), F.when(F.col("_opens"), F.col("head_author")).otherwise(handed_on).alias("_goes_on"))
    author = F.when(F.col("_n") == 0, F.col("_goes_on")).otherwise(F.col("_opened"))
    runs = rows.join(F.broadcast(ranges), "_range")  # a row per range
    runs = runs.withColumns({"run": F.col("_base") + F.col("_n"), "opens_run": F.col("_new") | (F.col("_first") & F.col("_opens")), "run_author": author["author"]})
    return runs.drop("_range", "_first", "_new", "_opened", "_n", "_opens", "_base", "_goes_on")


def text_block() -> Column:
    """The lines of one annotation of ``text_runs``, with its run's header where it opens one."""
    author = F.when(F.coalesce("run_author", F.lit("")) != "", F.concat(F.lit("by "), "run_author", F.lit("\n"))).otherwise("")
    head = F.when(F.col("opens_run"), F.concat(F.lit(RULE + "\n"), "book_title", F.lit("\n"), author, F.lit(RULE + "\n\n"))).otherwise("")
    page = F.when(_given("page"), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("  "))).otherwise("")
    place = F.coalesce(F.concat(F.lit("Loc "), _location("-")), F.lit(""))
    date = F.when(F.coalesce("added_date", F.lit("")) != "", F.concat(F.lit("  ("), "added_date", F.lit(")"))).otherwise("")
    where = F.concat(page, place, date)
    tag = F.when(where != "", F.concat(F.lit("["), F.upper("clip_type"), F.lit("] "), F.trim(where), F.lit("\n"))).otherwise("")
    content = F.when(F.coalesce("content", F.lit("")) != "", F.concat("content", F.lit("\n"))).otherwise("")
    return F.concat(head, tag, content)


def render_text(annotations: DataFrame) -> DataFrame:
    """(order key, run, block): the text export, one block per annotation in export order; each block ends with a blank line."""
    return text_runs(annotations).select(key_of(annotations).alias("at"), "run", text_block().alias("block"))
