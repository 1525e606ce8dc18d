"""From a folder of annotation files and book tables to enriched annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import suffix
from marginalia.operators.enrich import assign_places, pair_books, popular_books, resolve_text, with_book
from marginalia.schema import conform
from marginalia.sources.corpus import failed_files, file_route, route, scan_corpus
from marginalia.sources.files import listed as listed_files
from marginalia.sources.files import listing
from marginalia.sources.plain_text import read_books
from marginalia.sources.storage import saved

#: A list of up to so many popular books is broadcast.
POPULAR_ROWS = 100_000


def annotate(annotations: DataFrame, files: DataFrame, chunks: DataFrame | None, page_map: DataFrame | None, location_map: DataFrame | None, override: str | None = None, text: bool = True, pages: bool = True) -> DataFrame:
    """``annotations`` with text, pages and locations from the book that is paired with their sidecar folder.

    ``files`` (path) holds the book files, the book tables name them as book_id. Everything in a sidecar folder counts, so
    locations of clippings text there are taken for offsets too. Annotations without a paired book, and whatever a book has no
    table for, stay as they are. Without ``text`` no ``chunks`` are needed, without ``pages`` no maps. ``override`` is the book of all groups (of all annotations where there is no sidecar folder).

    The paired annotations of each book are counted first, so that chunks, pages and locations of popular books are looked up in several streams.
    """
    folders = annotations.filter("sidecar_dir is not null").select(F.col("sidecar_dir").alias("dir")).distinct()
    rows = with_book(annotations, pair_books(folders, files), override)
    offsets = {"book_id": F.col("book_file"), "char_start": F.col("location_start"), "char_end": F.col("location_end")}
    paired = rows.filter("book_file is not null").withColumns(offsets | {"place": F.struct("source_file", "file_ord", "kind_ord", "rec_ord")})
    popular = saved(popular_books(paired), "popular")
    if popular.count() <= POPULAR_ROWS:
        popular = F.broadcast(popular)
    if text:
        paired = resolve_text(paired, chunks, "place", popular=popular)
    if pages:
        paired = assign_places(paired, page_map, location_map, "place", sparse=True, popular=popular)
    return conform(paired).unionByName(conform(rows.filter("book_file is null")))


def text_chunks(spark: SparkSession, path: str, listed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, unread) of the books below ``path`` that have a text file beside them, of the same folder and stem; they are named by the book file.

    ``listed`` (path, length) and the ``listing`` ``files`` hold all files. Clippings texts are no books, and texts without a book file beside them belong to none;
    they are read for whether they can be. Each text is read once: chunks are written to the shared folder, and what has none there is unread.
    """
    texts = listed.filter((F.lower(suffix(F.col("path"))) == ".txt") & route(F.col("path")).isNull())
    of_texts = files.filter((F.lower(suffix(F.col("file_name"))) == ".txt") & file_route().isNull())
    pairs = saved(pair_books(texts.select(F.col("path").alias("dir")), listed.select("path")).filter("book_file is not null"), "pairs")
    paired = pairs.select(F.col("dir").alias("path"))
    of = lambda df, how: df.join(paired, "path", how)
    found, _ = read_books(spark, path, listed=of(texts, "left_semi"), files=of(of_texts, "left_semi"))
    chunks = saved(found.join(pairs, found["book_id"] == pairs["dir"]).select(F.col("book_file").alias("book_id"), "ordinal", "pid", "length", "text", "dir"), "chunks")
    unread = of(texts, "left_semi").filter("length > 0").select("path").join(chunks.select(F.col("dir").alias("path")).distinct(), "path", "left_anti")
    _, alone = read_books(spark, path, listed=of(texts, "left_anti"), files=of(of_texts, "left_anti"))
    return chunks.drop("dir"), unread.unionByName(alone)


def annotate_corpus(spark: SparkSession, path: str, chunks: DataFrame | None, page_map: DataFrame | None, location_map: DataFrame | None, override: str | None = None, text: bool = True, pages: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, page indexes, quarantine) of all files below ``path``, with the annotations of ``annotate``.

    Without ``chunks``, books are read from the text files beside them (``text_chunks``); those that can't be read are in the quarantine.
    Decoded annotations are written to the shared folder, so that files are decoded once, however often the rows are used.
    """
    files = listing(spark, path)
    listed = saved(listed_files(files), "listed")
    annotations, indexes, failed = scan_corpus(spark, path, listed, files=files)
    annotations = saved(annotations, "scanned")
    if chunks is None and text:
        chunks, unread = text_chunks(spark, path, listed, files)
        failed = failed.unionByName(failed_files(unread))
    return annotate(annotations, listed.select("path"), chunks, page_map, location_map, override, text, pages), indexes, failed
