"""Clippings text: one file of all entries that a device has written, cut by a line of equal signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import from_uri, local_path, sidecar_dir
from marginalia.functions.text import LINE_BREAK, SPACE, absent_if_empty, is_blank, parsed_time, rstrip, strip
from marginalia.schema import conform
from marginalia.sources.files import by_name, contents, cut, listing, short

#: Fixed values of the format: the separator, and the kinds that follow "- Your".
SEPARATOR = "=========="
KINDS = ("highlight", "note", "bookmark")
_OPENING = rf"(?iU)-\s+your\s+({'|'.join(KINDS)})"


def _words(field: Column, most: int = -1) -> Column:
    """The words of a field; the last of ``most`` holds the rest. A blank field has one empty word."""
    return F.split(strip(field), rf"(?U){SPACE}+", most)


def _word(words: Column, i: int) -> Column:
    return F.coalesce(F.get(words, F.lit(i)), F.lit(""))


def _is(words: Column, i: int, label: str) -> Column:
    return F.lower(_word(words, i)) == label


def _digits(word: Column) -> Column:
    """The digits that a word begins with; null for none."""
    return absent_if_empty(F.regexp_extract(word, r"(?U)\A\d+", 0))


def metadata(meta: Column) -> dict[str, Column]:
    """The fields of a metadata line: kind (empty without an opening), page, start, end and date.

    The line is cut at its bars. The first field holds the kind and where it stands, the next one the location, the last one, with
    all bars in it, the date. A field with anything left over hides those after it; a place other than a page number hides none.
    """
    fields = F.split(F.get(F.split(meta, _OPENING, 2), F.lit(1)), r"\|")
    place = F.get(fields, F.lit(0))
    where = _words(place)
    apart = place.rlike(rf"(?U)\A{SPACE}")
    number = F.when(apart & _is(where, 0, "on") & _is(where, 1, "page"), _digits(_word(where, 2)))
    only_page = (F.size(where) == 3) & (_word(where, 2) == number)
    somewhere = apart & _is(where, 0, "on") & ((F.size(where) > 1) | place.rlike(rf"(?U){SPACE}{{2}}\z"))
    goes_on = is_blank(place) | F.when(number.isNotNull(), only_page).otherwise(somewhere)

    located = _words(F.get(fields, F.lit(1)))
    span = _word(located, 1)
    first = F.when(goes_on & _is(located, 0, "location"), _digits(span))
    after = F.substring(span, F.length(first) + 1, F.length(span))
    last = F.when(F.startswith(after, F.lit("-")), _digits(F.substring(after, F.lit(2), F.length(after))))
    used_up = (F.size(located) == 2) & (after == F.coalesce(F.concat(F.lit("-"), last), F.lit("")))

    rest = F.when(first.isNull(), F.slice(fields, F.lit(2), F.size(fields))).when(used_up, F.slice(fields, F.lit(3), F.size(fields)))
    added = _words(F.array_join(rest, "|"), 3)
    date = F.when(goes_on & _is(added, 0, "added") & _is(added, 1, "on"), absent_if_empty(_word(added, 2)))
    return {"kind": F.lower(F.regexp_extract(meta, _OPENING, 1)), "page": number, "start": first, "end": last, "date": date}


def title_and_author(line: Column) -> tuple[Column, Column]:
    """(title, author) of a title line: the author stands in brackets at the end, after a blank and without a closing bracket in it."""
    inside = F.when(F.endswith(line, F.lit(")")), F.left(line, F.length(line) - 1))
    tail = F.substring_index(inside, ")", -1)
    cut = F.split(tail, rf"(?U){SPACE}\(", 2)
    title = F.concat(F.left(inside, F.length(inside) - F.length(tail)), F.get(cut, F.lit(0)))
    named = (_word(cut, 1) != "") & ~is_blank(title)
    return F.when(named, strip(title)).otherwise(line), F.when(named, strip(F.get(cut, F.lit(1)))).otherwise("")


def entry_lines(entries: DataFrame) -> DataFrame:
    """``entries`` (value, ...) with its lines; entries of fewer than two lines are dropped."""
    cut = F.transform(F.split(strip(F.make_valid_utf8("value")), LINE_BREAK), rstrip)
    return entries.withColumn("lines", cut).filter(F.size("lines") >= 2)


def parse_entries(entries: DataFrame) -> DataFrame:
    """Annotations of ``entries`` (value, source_file, file_ord, rec_ord); entries without a metadata line are dropped.

    Stateless: the same plan runs over a batch and over a stream of files.
    """
    title_line, meta = strip(F.regexp_replace(F.get("lines", F.lit(0)), "\\A\ufeff+", "")), strip(F.get("lines", F.lit(1)))
    text = F.array_join(F.filter(F.slice("lines", F.lit(3), F.size("lines")), lambda x: ~is_blank(x)), " ")
    found = entry_lines(entries).withColumns({"title_line": title_line, "meta": meta}).filter(F.col("meta").rlike(_OPENING))
    found = found.withColumn("m", F.struct(*(c.alias(name) for name, c in metadata(F.col("meta")).items())))
    title, author = title_and_author(F.col("title_line"))
    date = F.col("m.date")
    return conform(
        found.select(
            title.alias("book_title"),
            author.alias("author"),
            F.col("m.kind").alias("clip_type"),
            F.col("m.page").try_cast("int").alias("page"),
            F.col("m.start").try_cast("bigint").alias("location_start"),
            F.col("m.end").try_cast("bigint").alias("location_end"),
            date.alias("added_date"),
            strip(text).alias("content"),
            "source_file",
            parsed_time(date).alias("added_ts"),
            sidecar_dir(F.col("source_file")).alias("sidecar_dir"),
            "file_ord",
            F.lit(0).alias("kind_ord"),
            "rec_ord",
        )
    )


def read_entries(spark: SparkSession, path: str | list[str], glob: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """(value, source_file, file_ord, rec_ord, n_bytes) of text files or folders; files that are shorter than a split are rows and are cut there, longer ones are read in splits.

    file_ord is the path and the place of the split in its file, rec_ord grows within a split, n_bytes is the entry's size with its separator.
    A file that can't be read, or not to its end, gives what comes before, if anything; ``unread_files`` finds it.
    ``files``: the ``listing`` of them, where it has been listed already.
    """
    files, most = listing(spark, path, glob) if files is None else files, short(spark)
    rows = cut(contents(files.filter(F.col("file_size") <= most)), SEPARATOR.encode()).select(F.col("piece").cast("string").alias("value"), F.col("path").alias("source_file"), F.lit(0).cast("bigint").alias("split"), F.col("i").alias("rec_ord"))
    longer = files.filter(F.col("file_size") > most)
    if not longer.select("path").isEmpty():
        rows = rows.unionByName(_split_entries(spark, *by_name(longer, path, glob), most))
    place = F.lpad(F.col("split").cast("string"), 16, "0")
    size = (F.octet_length("value") + len(SEPARATOR)).cast("bigint")
    return rows.select("value", "source_file", F.concat_ws("#", "source_file", place).alias("file_ord"), "rec_ord", size.alias("n_bytes"))


def _split_entries(spark: SparkSession, path: str | list[str], glob: str | None, longer: int) -> DataFrame:
    """(value, source_file, split, rec_ord) of the files of more than ``longer`` bytes, from their splits."""
    reader = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(path).filter(F.col("_metadata.file_size") > longer)
    return rows.select("value", local_path(from_uri(F.col("_metadata.file_path"))).alias("source_file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("rec_ord"))


#: Bytes of a byte order mark, which the reader takes off; no entry is as short.
MARK = 3


def unread_files(listed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path) of those files in ``listed`` (path, length) of which fewer bytes are in ``entries`` than they have.

    The splits of a file are read by different tasks, any of which may fail, so what was read is added up by file.
    """
    read = entries.groupBy(F.col("source_file").alias("path")).agg(F.sum("n_bytes").alias("n"))
    return listed.join(read, "path", "left").filter(F.coalesce("n", F.lit(0)) < F.col("length") - MARK).select("path")


def read_clippings_text(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    return parse_entries(read_entries(spark, path, glob))
