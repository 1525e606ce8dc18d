"""The registered queries of the annotation operators, over the shared tables. Their oracles are in ``oracles``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia import sinks
from marginalia.functions.text import lines
from marginalia.operators import books, enrich, flow, metrics, order, render
from marginalia.oracles import ORACLES
from marginalia.plans import fixtures
from marginalia.schema import EXPORT_COLUMNS
from marginalia.sources import clippings, corpus, page_index, plain_text, sidecar, sidecar_splits, typed
from marginalia.sources import files as files_of
from marginalia.sources.storage import new_path, qualified

#: An annotation's columns as the decoding queries return them.
DECODED = ("book_title", "clip_type", "location_start", "location_end", "added_date", "content")


def resolved_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.annotations(spark, sf_dir)
    done = enrich.enrich(rows, fixtures.chunks(spark, sf_dir), fixtures.page_map(spark, sf_dir), fixtures.location_map(spark, sf_dir), salts=4)
    return done.select("event_id", "book_title", "author", "clip_type", "page", "location_start", "location_end", "added_date", "content")


def span_text_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.resolve_text_simple(fixtures.annotations(spark, sf_dir), fixtures.books(spark, sf_dir)).select("event_id", "content")


def span_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.resolve_text(fixtures.annotations(spark, sf_dir), fixtures.chunks(spark, sf_dir)).select("event_id", "content")


def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.assemble_text(fixtures.chunks(spark, sf_dir))


def chunk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.chunk_gaps(fixtures.chunks(spark, sf_dir)).select("book_id", "ordinal", "gap", "start", "end")


def _text_books(spark: SparkSession, books_table: DataFrame, size: int) -> DataFrame:
    """The chunks of books that were written as text files, with their numbers as book_id."""
    root = new_path(spark, "texts")
    fixtures.write_files(fixtures.text_files(books_table), qualified(spark, root))
    found, _ = plain_text.read_books(spark, root, size=size)
    return found.withColumn("book_id", F.regexp_extract("book_id", r"Book (\d+)\.txt\z", 1).cast("bigint"))


def plain_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as text files with line ends and byte order marks of all kinds, read in splits as chunks of 300 characters."""
    return _text_books(spark, fixtures.books(spark, sf_dir), 300).withColumnRenamed("ordinal", "k")


def span_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of spans from books that are text files."""
    books_table = fixtures.books(spark, sf_dir)
    return enrich.resolve_text(fixtures.annotations(spark, sf_dir), plain_text.numbered(_text_books(spark, books_table, plain_text.SIZE))).select("event_id", "content")


def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.assign_places(fixtures.annotations(spark, sf_dir), fixtures.page_map(spark, sf_dir), None).select("event_id", "page")


def location_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.assign_places(fixtures.annotations(spark, sf_dir), None, fixtures.location_map(spark, sf_dir)).select("event_id", "location_start", "location_end")


def page_map_from_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.page_map_from_nav(*fixtures.navigation(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.clippings_entries(fixtures.annotations(spark, sf_dir))


def clippings_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = clippings.parse_entries(_entries(spark, sf_dir))
    return parsed.select(F.col("rec_ord").alias("event_id"), "book_title", "author", "clip_type", "page", "location_start", "location_end", "content", "source_file")


def title_author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clippings.parse_entries(_entries(spark, sf_dir)).groupBy("book_title", "author").agg(F.count("*").alias("n"))


def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = clippings.parse_entries(_entries(spark, sf_dir))
    return parsed.select(F.col("rec_ord").alias("event_id"), "page", "location_start", "location_end", "added_ts")


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clippings.entry_lines(_entries(spark, sf_dir)).select(F.col("rec_ord").alias("event_id"), F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


def sidecar_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sidecar.decode_annotations(fixtures.sidecar_files(fixtures.annotations(spark, sf_dir)))
    return found.select(*DECODED, "source_file")


def sidecar_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose payloads hold whole records: both are found, and each is read to its own end."""
    found = sidecar.decode_annotations(fixtures.nested_files(fixtures.annotations(spark, sf_dir)))
    return found.select("clip_type", "location_start", "location_end", F.substring("content", 1, 4).alias("opening"), F.length("content").alias("n_chars"), "source_file")


def sidecar_splits_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested notes and the last positions, written as files and read in splits: records that hold others go over several pieces."""
    rows, root = fixtures.annotations(spark, sf_dir), new_path(spark, "sidecars")
    for files in (fixtures.nested_files(rows), fixtures.position_files(rows)):
        fixtures.write_files(files, qualified(spark, root))
    files = files_of.listing(spark, root)
    found = sidecar_splits.read_split_annotations(spark, root, files).unionByName(sidecar_splits.read_split_positions(spark, root, files))
    return found.select("clip_type", "location_start", "location_end", F.length("content").alias("n_chars"), "added_date", F.substring_index("source_file", "/library/", -1).alias("source_file"))


def last_position_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar.decode_last_positions(fixtures.position_files(fixtures.annotations(spark, sf_dir))).select(*DECODED, "source_file")


def typed_record_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures.configure(spark)
    return typed.decode_records(fixtures.typed_files(fixtures.annotations(spark, sf_dir))).select(*DECODED, "source_file")


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_index.decode_page_indexes(fixtures.index_files(fixtures.page_map(spark, sf_dir)))


def page_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexes(spark, sf_dir).select("asin", "content_guid", "page_count", F.size("page_offsets").alias("n_offsets"), "source_file")


def page_index_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_index.page_offsets(_indexes(spark, sf_dir))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.typed_files(fixtures.annotations(spark, sf_dir)).unionByName(fixtures.index_files(fixtures.page_map(spark, sf_dir)))
    return corpus.quarantine(files)


def corpus_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("path", corpus.route(F.col("path")).alias("format"))


def book_title_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.titles(fixtures.files(spark, sf_dir))


def nearest_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.files(spark, sf_dir).select("path", corpus.sidecar_dir(F.col("path")).alias("sidecar_dir"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.files(spark, sf_dir)
    return enrich.pair_books(corpus.sidecar_folders(files), files)


def book_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def book_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.annotations(spark, sf_dir).withColumn("sidecar_dir", F.when(F.col("event_id") % 3 != 0, F.col("sidecar_dir")))
    return enrich.with_book(rows, _pairs(spark, sf_dir), "/library/one.kfx").select("event_id", "book_file")


def paired_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_book(fixtures.annotations(spark, sf_dir), _pairs(spark, sf_dir)).select("event_id", "sidecar_dir", "book_file")


def union_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures.configure(spark)
    rows = fixtures.annotations(spark, sf_dir)
    files = fixtures.sidecar_files(rows).unionByName(fixtures.position_files(rows)).unionByName(fixtures.typed_files(rows))
    return corpus.decode_all(files).groupBy("clip_type", corpus.route(F.col("source_file")).alias("format")).agg(F.count("*").alias("n"), F.sum("location_start").alias("starts"))


def ordered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.annotations(spark, sf_dir)
    return order.order_annotations(rows).select("event_id", "added_date", "file_ord", "kind_ord", "rec_ord")


def fill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.annotations(spark, sf_dir)
    return metrics.fill_metrics(rows, enrich.resolve_text(rows, fixtures.chunks(spark, sf_dir)))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.page_map(spark, sf_dir)
    return metrics.page_coverage(enrich.assign_places(fixtures.annotations(spark, sf_dir), pages, None), pages, fixtures.location_map(spark, sf_dir))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ingest_totals(fixtures.annotations(spark, sf_dir), _indexes(spark, sf_dir))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.assign_places(fixtures.annotations(spark, sf_dir), fixtures.page_map(spark, sf_dir), fixtures.location_map(spark, sf_dir))


def corpus_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all formats written to the shared folder, scanned, paired with their books and enriched."""
    rows, root = fixtures.annotations(spark, sf_dir), new_path(spark, "corpus")
    books = fixtures.book_files(rows)
    files = [fixtures.sidecar_files(rows), fixtures.position_files(rows), fixtures.clippings_files(rows), books.select("path", "content")]
    for each in files:
        fixtures.write_files(each, qualified(spark, root))
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    where = files_of.list_files(spark, root).withColumn("name", F.substring_index("path", "/library/", -1))
    named = books.select("book_id", F.substring_index("path", "/library/", -1).alias("name")).join(where, "name").select("book_id", F.col("path").alias("book_file"))
    keyed = lambda df, only: df.filter(only).join(named, "book_id").withColumn("book_id", F.col("book_file")).drop("book_file")
    tables = keyed(fixtures.chunks(spark, sf_dir), "true"), keyed(fixtures.page_map(spark, sf_dir), "book_id % 3 = 1"), keyed(fixtures.location_map(spark, sf_dir), "book_id % 3 = 1")
    found, _, _ = flow.annotate_corpus(spark, root, *tables)
    return found.select(*EXPORT_COLUMNS).withColumn("source_file", F.substring_index("source_file", "/library/", -1))


def corpus_text_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of sidecars, book files and their texts, some of them unreadable: annotated from nothing but the tree, with the quarantine as further rows."""
    rows, root = fixtures.annotations(spark, sf_dir), new_path(spark, "corpus")
    texts = fixtures.text_files(fixtures.books(spark, sf_dir))
    for files in (fixtures.sidecar_files(rows), fixtures.book_files(rows), texts, fixtures.wrong_text_sums(texts)):
        fixtures.write_files(files, qualified(spark, root))
    found, _, failed = flow.annotate_corpus(spark, root, None, None, None, pages=False)
    columns = ("book_title", "clip_type", "location_start", "location_end", "added_date", "content")
    refused = failed.select(*(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns[:-1]), F.col("reason").alias("content"), "source_file")
    return found.select(*columns, "source_file").unionByName(refused).withColumn("source_file", F.substring_index("source_file", "/library/", -1))


def corpus_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every file of a tree in all formats, some of them unreadable: one scan, by file."""
    fixtures.configure(spark)
    rows, root = fixtures.annotations(spark, sf_dir), new_path(spark, "corpus")
    for files in (fixtures.sidecar_files(rows), fixtures.position_files(rows), fixtures.typed_files(rows), fixtures.index_files(fixtures.page_map(spark, sf_dir)), fixtures.clippings_files(rows)):
        fixtures.write_files(files, qualified(spark, root))
        fixtures.write_files(fixtures.wrong_sums(files), qualified(spark, root))
    found, indexes, failed = corpus.scan_corpus(spark, root)
    known = lambda df, outcome, n: df.select("source_file", corpus.route(F.col("source_file")).alias("format"), F.lit(outcome).alias("outcome"), n.cast("bigint").alias("n"))
    each = known(found.groupBy("source_file").agg(F.count("*").alias("c")), "annotations", F.col("c")).unionByName(known(indexes, "page_indexes", F.size("page_offsets")))
    every = each.unionByName(failed.select("source_file", "format", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("n")))
    return every.select(F.substring_index("source_file", "/library/", -1).alias("file"), "format", "outcome", "n")


def json_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_rows(_export(spark, sf_dir))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.csv_rows(_export(spark, sf_dir))


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_markdown(_export(spark, sf_dir)).select("book_title", F.col("first_seen.date").alias("first_date"), "document")


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.text_runs(_export(spark, sf_dir)).select("event_id", "run", "opens_run", "run_author")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_text(_export(spark, sf_dir)).select(F.col("at.rec_ord").alias("event_id"), F.size(lines(F.col("block"))).alias("n_lines"), "block")


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.manifest(_export(spark, sf_dir), _indexes(spark, sf_dir)).select("total_clippings", "page_indexes")


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    sinks.write_json(_export(spark, sf_dir), _indexes(spark, sf_dir), path)
    return spark.read.text(f"{path}/annotations").select(F.col("value").alias("json"))


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _export(spark, sf_dir), new_path(spark, "csv")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.select(*EXPORT_COLUMNS).schema).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def markdown_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "markdown")
    sinks.write_markdown(_export(spark, sf_dir), path)
    return _lines_of(spark, path)


def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    sinks.write_text(_export(spark, sf_dir), path)
    return _lines_of(spark, path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the lines of a folder's part files, counted from 1 along the files' names. A part file is a row for the time being."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    files = files.select("file", F.slice("lines", 1, F.size("lines") - 1).alias("lines"))  # the last line break ends the last line
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.size("lines").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per file
    return files.join(F.broadcast(starts), "file").select("start", F.posexplode("lines").alias("i", "line")).select((F.col("start") + F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def all_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all exports but CSV in the order of their files, from one sort, and what was counted while they were written."""
    path = new_path(spark, "all")
    seen = sinks.write_all(_export(spark, sf_dir), _indexes(spark, sf_dir), path)
    kept = {"json": "json/annotations", "markdown": "markdown", "text": "text"}
    parts = [_numbered_lines(spark, f"{path}/{folder}").select(F.lit(name).alias("sink"), "line_no", "line") for name, folder in kept.items()]
    counts = spark.read.schema("total_clippings bigint, page_indexes bigint").json(f"{path}/json/manifest")
    parts.append(counts.select(F.lit("manifest").alias("sink"), F.lit(1).cast("bigint").alias("line_no"), F.concat_ws(" ", "total_clippings", "page_indexes", F.lit(seen["total"]), F.lit(seen["shown"])).alias("line")))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        resolved_annotations,
        span_text_simple,
        span_text_chunks,
        plain_text_chunks,
        span_text_files,
        assembled_text,
        chunk_gaps,
        page_asof,
        location_rank,
        page_map_from_nav,
        clippings_text_parse,
        title_author_split,
        metadata_parse,
        entry_lines,
        sidecar_decode,
        sidecar_nested,
        sidecar_splits_decode,
        last_position_decode,
        typed_record_decode,
        page_index_decode,
        page_index_offsets,
        quarantine,
        corpus_routing,
        book_title_from_path,
        nearest_sidecar,
        book_pairing,
        book_override,
        paired_annotations,
        union_formats,
        ordered_annotations,
        fill_metrics,
        page_coverage,
        ingest_totals,
        json_pruned,
        csv_rows,
        markdown_docs,
        text_runs,
        text_blocks,
        export_manifest,
        corpus_flow,
        corpus_text_books,
        corpus_outcomes,
        json_sink,
        csv_sink,
        markdown_sink,
        text_sink,
        all_sinks,
    )
}

__all__ = ["ORACLES", "QUERIES"]
