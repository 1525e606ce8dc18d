"""Enrichment of annotations from book tables: paired book, text of the span, printed page, reader location.

Annotations carry char_start and char_end, character offsets in the book; the reader's locations are new columns, so
the steps are free of order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.paths import parent, stem, suffix
from marginalia.functions.text import collapse
from marginalia.operators.books import numbered_chunks

#: Book files that pair with a sidecar folder, best first (fixed values).
BOOK_SUFFIXES = (".kfx", ".azw3", ".mobi", ".epub", ".azw", ".prc")
#: Starts and ends of a book in one stream of the lookups of chunks, pages and locations; books with more are dealt to several.
PER_STREAM = 100_000


def pair_books(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``folders`` (dir) with book_file: of the ``files`` (path) beside it with its stem, the best by suffix; null if none."""
    rank = F.array_position(F.array(*map(F.lit, BOOK_SUFFIXES)), suffix(F.col("path")))
    books = files.select("path", parent(F.col("path")).alias("_parent"), stem(F.col("path")).alias("_stem"), rank.alias("_rank")).filter("_rank > 0").groupBy("_parent", "_stem").agg(F.min_by("path", "_rank").alias("book_file"))
    mine = folders.withColumns({"_parent": parent(F.col("dir")), "_stem": stem(F.col("dir"))})
    return mine.join(books, ["_parent", "_stem"], "left").drop("_parent", "_stem")


def with_book(annotations: DataFrame, pairs: DataFrame, override: str | None = None) -> DataFrame:
    """``annotations`` with book_file: that of their sidecar folder in ``pairs`` (dir, book_file), or ``override``.

    An override holds for all sidecar groups; where there is no sidecar folder at all, for all annotations.
    """
    if override is None:
        return annotations.join(pairs.select(F.col("dir").alias("sidecar_dir"), "book_file"), "sidecar_dir", "left")
    any_group = annotations.agg(F.max(F.col("sidecar_dir").isNotNull()).alias("_any"))
    one = annotations.withColumn("_one", F.lit(1)).join(F.broadcast(any_group.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return one.withColumn("book_file", F.when(F.col("sidecar_dir").isNotNull() | ~F.coalesce("_any", F.lit(False)), F.lit(override))).drop("_any")


def needs_text() -> Column:
    """True for rows whose content is missing or a tag, and that have a start."""
    return ((F.coalesce("content", F.lit("")) == "") | F.startswith("content", F.lit("["))) & F.col("char_start").isNotNull()


def filled(snippet: Column) -> Column:
    """The content with a leading closed tag kept before a snippet; unchanged for an empty one."""
    tag = F.nullif(F.regexp_extract("content", r"\A(\[[^\]]+\])", 1), F.lit(""))
    return F.when(F.coalesce(snippet, F.lit("")) != "", F.concat_ws(" ", tag, snippet)).otherwise(F.col("content"))


def _end() -> Column:
    """The end of the span; a missing or zero end makes it empty."""
    return F.coalesce(F.nullif("char_end", F.lit(0)), "char_start")


def resolve_text_simple(annotations: DataFrame, books: DataFrame) -> DataFrame:
    """``annotations`` with content filled from ``books`` (book_id, text): for books that fit in a row."""
    joined = annotations.join(books.select("book_id", F.col("text").alias("_text")), "book_id", "left")
    cut = F.when(needs_text() & (F.col("char_start") < F.length("_text")), F.substring("_text", (F.col("char_start") + 1).cast("int"), F.greatest(F.lit(0), F.least(_end(), F.length("_text")) - F.col("char_start")).cast("int")))
    return joined.withColumn("content", filled(collapse(cut))).drop("_text")


def _dealing(popular: DataFrame | None, salts: int) -> tuple[Callable[[DataFrame, str], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Two ways to give rows (book_id) a salt, the stream of their book: to one stream by the hash of a key, or to all of them.

    ``popular`` (book_id, streams) says how many streams its books have; all others have ``salts``.
    """
    if popular is not None:
        known = lambda df: df.join(popular.select("book_id", F.col("streams").alias("_streams")), "book_id", "left")
        streams = F.coalesce("_streams", F.lit(salts))
    else:
        known, streams = (lambda df: df), F.lit(salts)
    one = lambda df, key: known(df).withColumn("salt", F.pmod(F.xxhash64(key), streams).cast("int"))
    every = lambda df: known(df).withColumn("salt", F.explode(F.sequence(F.lit(0), streams - 1)))
    return one, every


def touched_chunks(spans: DataFrame, numbered: DataFrame, salts: int = 1, popular: DataFrame | None = None) -> DataFrame:
    """``spans`` (_key, book_id, _s, _e) with n, one row for each chunk of ``numbered`` that a span touches.

    Chunks and the gaps before them cover a book without overlap, so a span touches those from the one that holds its first
    character to the one that holds its last. Both are looked up as numbers, by a running last value along one stream of chunk
    starts and span ends per book; no text is in it. An end beyond the book is in its last chunk. ``popular`` and ``salts``
    deal spans to streams as in ``assign_places``; popular books' chunk starts are copied, their texts are not.
    """
    one, every = _dealing(popular, salts)
    columns = ("book_id", "salt", "pos", "side", "n", "to", "_key", "_s", "_e")
    key = spans.schema["_key"].dataType
    none = {"side": "int", "n": "int", "to": "bigint", "_s": "bigint", "_e": "bigint"}
    row = lambda df, **own: df.select(*(own.get(c, F.lit(None).cast(none.get(c, key)) if c in none or c == "_key" else F.col(c)).alias(c) for c in columns))
    starts = row(every(numbered), pos=(F.col("start") - F.col("gap")).cast("bigint"), n=F.col("n"), to=F.col("end").cast("bigint"))
    given = {c: F.col(c) for c in ("_key", "_s", "_e", "side")}
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_s").alias("pos")), F.struct(F.lit(1).alias("side"), (F.col("_e") - 1).alias("pos")))).alias("at")
    probes = one(spans, "_key").select("book_id", "salt", "_key", "_s", "_e", sides).select("*", "at.side", "at.pos")
    along = Window.partitionBy("book_id", "salt").orderBy("pos", F.asc_nulls_first("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(row(probes, **given)).withColumns({c: F.last(c, ignorenulls=True).over(along) for c in ("n", "to")}).filter("side is not null")
    first = F.when(F.col("side") == 0, F.coalesce(F.when(F.col("to") > F.col("pos"), F.col("n")).otherwise(F.col("n") + 1), F.lit(1)))
    reach = found.groupBy("_key", "book_id", "_s", "_e").agg(F.max(first).alias("_first"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("_last"))
    return reach.filter("_first <= _last").select("_key", "book_id", "_s", "_e", F.explode(F.sequence("_first", "_last")).alias("n"))


def resolve_text(annotations: DataFrame, chunks: DataFrame, key: str = "event_id", salts: int = 1, popular: DataFrame | None = None) -> DataFrame:
    """As ``resolve_text_simple``, from chunks and without ever assembling a book.

    An interval join by numbers: ``touched_chunks`` finds the chunks of each span, which then meet by (book, number), so only
    the chunks that a span touches are moved, once for each, and a popular book is dealt over its chunks. ``key`` identifies
    an annotation. Spans may end anywhere beyond their book. Chunks with a column n are numbered already (``numbered_chunks``).
    """
    spans = annotations.filter(needs_text() & (_end() > F.col("char_start")) & F.col("book_id").isNotNull()).select(F.col(key).alias("_key"), "book_id", F.col("char_start").cast("bigint").alias("_s"), _end().cast("bigint").alias("_e"))
    numbered = chunks if "n" in chunks.columns else numbered_chunks(chunks)
    at = numbered.select("book_id", "n", "gap", "text", F.col("start").alias("_at"), F.col("end").alias("_to"))
    met = touched_chunks(spans, numbered, salts, popular).join(at, ["book_id", "n"])
    lead = F.when((F.col("_s") < F.col("_at")) & (F.col("gap") > 0), F.lit(" ")).otherwise("")
    lo, hi = F.greatest("_s", "_at") - F.col("_at"), F.least("_e", "_to") - F.col("_at")
    piece = F.concat(lead, F.substring("text", (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")))
    snippets = met.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))), lambda x: x["p"]), "").alias("_snippet"))
    joined = annotations.join(snippets, annotations[key] == snippets["_key"], "left")
    return joined.withColumn("content", F.when(needs_text(), filled(collapse(F.col("_snippet")))).otherwise(F.col("content"))).select(*annotations.columns)


def popular_books(annotations: DataFrame, per_stream: int = PER_STREAM) -> DataFrame:
    """(book_id, streams) of the books with more than ``per_stream`` starts and ends in ``annotations``: how many streams they are dealt to.

    One row at most for every ``per_stream`` of those.
    """
    ends = F.count("char_start") + F.count("char_end")
    counts = annotations.groupBy("book_id").agg(F.ceil(ends / per_stream).cast("int").alias("streams"))
    return counts.filter("book_id is not null and streams > 1")


def assign_places(annotations: DataFrame, page_map: DataFrame | None, location_map: DataFrame | None, key: str = "event_id", salts: int = 1, sparse: bool = False, popular: DataFrame | None = None) -> DataFrame:
    """``annotations`` with page (as-of lookup) and location_start, location_end (rank lookup).

    ``page_map`` (book_id, ordinal, label, char_offset): the last page at or before the start, if page is null; a label that
    is no whole number, or a start before the first page, leaves it null. ``location_map`` (book_id, location,
    char_offset): how many locations begin at or before an offset, at least 1; an end equal to the start becomes null. With
    no location map the offsets themselves are returned, and with ``sparse`` also for books that have no entry in it.

    Map entries and the annotations' starts and ends are one stream per book, sorted once; a running last value and a
    running count answer both lookups. ``popular`` (book_id, streams) deals the annotations of its books to so many streams, each with its
    copy of their maps; ``salts`` is the number of streams of all other books.
    """
    one, every = _dealing(popular, salts)
    blank = {"kind": F.lit(0), "ordinal": F.lit(0).cast("bigint"), "label": F.lit(None).cast("string"), "_id": F.lit(None).cast(annotations.schema[key].dataType), "side": F.lit(None).cast("string"), "located": F.lit(None).cast("boolean")}
    row = lambda df, **own: df.select("book_id", "salt", *(own.get(c, blank.get(c)).alias(c) for c in ("pos", "kind", "ordinal", "label", "_id", "side", "located")))
    parts = []
    if page_map is not None:
        parts.append(row(every(page_map), pos=F.col("char_offset").cast("bigint"), ordinal=F.col("ordinal").cast("bigint"), label=F.col("label")))
    if location_map is not None:
        parts.append(row(every(location_map), pos=F.col("char_offset").cast("bigint"), kind=F.lit(1), ordinal=F.col("location").cast("bigint")))
        if sparse:
            parts.append(row(every(location_map.select("book_id").distinct()), pos=F.lit(-(2**63)), located=F.lit(True)))
    probes = one(annotations, key)
    for side in ("start", "end"):
        parts.append(row(probes.filter(f"char_{side} is not null"), pos=F.col(f"char_{side}").cast("bigint"), kind=F.lit(2), _id=F.col(key), side=F.lit(side)))
    along = Window.partitionBy("book_id", "salt").orderBy("pos", "kind", "ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        reduce(DataFrame.unionByName, parts)
        .withColumn("label", F.last("label", ignorenulls=True).over(along))
        .withColumn("rank", F.count(F.when(F.col("kind") == 1, 1)).over(along))
        .withColumn("located", F.max("located").over(along))
        .filter("kind = 2")
        .groupBy("_id")
        .agg(
            F.max(F.when(F.col("side") == "start", F.col("label"))).alias("_label"),
            F.max(F.when(F.col("side") == "start", F.greatest("rank", F.lit(1)))).alias("_start"),
            F.max(F.when(F.col("side") == "end", F.greatest("rank", F.lit(1)))).alias("_end"),
            F.max("located").alias("_located"),
        )
    )
    number = F.when(F.trim("_label").rlike(r"\A[+-]?[0-9]+\z"), F.trim("_label").try_cast("int"))
    page = F.coalesce(F.col("page"), number) if "page" in annotations.columns else number
    out = annotations.join(found, annotations[key] == found["_id"], "left").withColumn("page", page)
    if location_map is None:
        out = out.withColumns({"location_start": F.col("char_start"), "location_end": F.col("char_end")})
    else:
        known = F.coalesce("_located", F.lit(False)) if sparse else F.lit(True)
        out = out.withColumns({"location_start": F.when(known, F.col("_start")).otherwise(F.col("char_start")), "location_end": F.when(known, F.nullif("_end", "_start")).otherwise(F.col("char_end"))})
    return out.drop("_id", "_label", "_start", "_end", "_located")


def enrich(annotations: DataFrame, chunks: DataFrame, page_map: DataFrame, location_map: DataFrame, key: str = "event_id", text: bool = True, pages: bool = True, salts: int = 1) -> DataFrame:
    """Text, pages and locations; without ``pages`` neither pages nor locations are looked up."""
    out = resolve_text(annotations, chunks, key, salts) if text else annotations
    return assign_places(out, page_map if pages else None, location_map if pages else None, key, salts)

