"""Books as plain text: files of any length, read in splits, as the chunks that spans are resolved from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.paths import from_uri, local_path
from marginalia.sources.files import by_name, contents, listing, short
from marginalia.sources.files import listed as listed_files

TEXT = "*.[tT][xX][tT]"
#: Characters of a chunk.
SIZE = 1024
#: Bytes of a byte order mark, which the reader of lines takes off and a book's text keeps as its first character.
MARK = 3
#: What names a split.
SPLIT = ["book_id", "split"]


def read_lines(spark: SparkSession, path: str | list[str], glob: str = TEXT, longer: int = -1) -> DataFrame:
    """(book_id, split, rec_ord, n_bytes, returned, line) of text files of more than ``longer`` bytes: book_id is the path, split the place of the split in its file.

    rec_ord grows within a split, n_bytes counts a line's bytes with its line feed. A line's last character is its line break,
    a carriage return alone or before a line feed is one too, and bytes that aren't UTF-8 become U+FFFD. The last line of a
    file has a line break here, whether it ends in one or not; returned says that a carriage return stood before it.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.text(path).filter(F.col("_metadata.file_size") > longer).select(
        local_path(from_uri(F.col("_metadata.file_path"))).alias("book_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("rec_ord"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        F.endswith("value", F.lit("\r")).alias("returned"),
        F.make_valid_utf8("value").alias("line"),
    )
    return rows.withColumn("line", F.concat(F.translate(F.regexp_replace("line", r"\r\z", ""), "\r", "\n"), F.lit("\n")))


def split_starts(lines: DataFrame) -> DataFrame:
    """(book_id, split, base, total, n_bytes): how many characters of its book stand before a split of ``lines``; characters and bytes of the whole book.

    One row for each split: numbers only, summed where the lines are read.
    """
    sums = lines.groupBy(*SPLIT).agg(F.sum(F.length("line")).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    book = Window.partitionBy("book_id")
    return sums.select(*SPLIT, (F.sum("n").over(book.orderBy("split")) - F.col("n")).alias("base"), F.sum("n").over(book).alias("total"), F.sum("n_bytes").over(book).alias("n_bytes"))


def _pieces(size: int) -> Column:
    """``line``, which begins at character ``at``, cut at the multiples of ``size`` characters."""
    room = (size - F.col("at") % size).cast("int")
    rest = F.regexp_extract_all(F.substr("line", room + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length("line") <= room, F.array("line")).otherwise(F.concat(F.array(F.substr("line", F.lit(1), room)), rest))


def read_books(spark: SparkSession, path: str | list[str], glob: str = TEXT, size: int = SIZE, listed: DataFrame | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, unread) of the text files below ``path``, each a book: chunks (book_id, ordinal, pid, length, text) of ``size`` characters, the last one of what is left.

    Files that are shorter than a split are rows and are cut there (``short_books``), longer ones are read in splits (``long_books``);
    the chunks are the same.

    Files read to less than their end are in unread (path), and none of their chunks is returned; so is a file of a byte order mark
    alone. Empty files are books without chunks. ``listed`` (path, length): the files, where they have been listed already, and
    ``files`` the ``listing`` of them.
    """
    files, most = listing(spark, path, glob) if files is None else files, short(spark)
    listed = listed_files(files) if listed is None else listed
    chunks, unread = short_books(files.filter(F.col("file_size") <= most), size, listed.filter(F.col("length") <= most))
    longer = listed.filter(F.col("length") > most)
    if longer.isEmpty():
        return chunks, unread
    more, more_unread = long_books(spark, *by_name(files.filter(F.col("file_size") > most), path, glob), size, longer, most)
    return chunks.unionByName(more), unread.unionByName(more_unread)


def short_books(files: DataFrame, size: int, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_books``, of ``files`` of a ``listing`` that are rows; nothing is shuffled but paths."""
    files = contents(files)
    mark = F.lit("\ufeff".encode())
    text = F.translate(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    whole = files.filter((F.length("content") > 0) & (F.col("content") != mark))
    cut = whole.select(F.col("path").alias("book_id"), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("i", "text"))
    chunks = cut.select("book_id", F.col("i").cast("bigint").alias("ordinal"), (F.col("i").cast("bigint") * size).alias("pid"), F.length("text").cast("bigint").alias("length"), "text")
    return chunks, listed.filter("length > 0").join(whole.select("path"), "path", "left_anti").select("path")


def long_books(spark: SparkSession, path: str | list[str], glob: str, size: int, listed: DataFrame, longer: int = -1) -> tuple[DataFrame, DataFrame]:
    """As ``read_books``, of the files of more than ``longer`` bytes, all of which are in ``listed`` (path, length).

    A file is read in splits by several tasks. Lines are measured first, a prefix sum over a book's splits says how many characters
    stand before each, and a running sum within a split where each line begins; then lines are cut at the multiples of ``size`` and
    the pieces of a chunk put together. No book is ever a row or a task, and a hot one is dealt over its splits and chunks. A line has
    to fit in a row.
    """
    lines = read_lines(spark, path, glob, longer)
    listed = listed.select(F.col("path").alias("book_id"), F.col("length").alias("file_bytes"))
    # What a file has beyond its lines: -1 where the last line has no line feed, 3 more where there is a byte order mark.
    over = F.col("file_bytes") - F.col("n_bytes")
    splits = split_starts(lines).join(listed, "book_id").select(*SPLIT, "base", "total", over.alias("over"))
    read = splits.filter(F.col("over").between(-1, MARK) & (F.col("over") != 1))
    unread = listed.filter("file_bytes > 0").join(read.select("book_id").distinct(), "book_id", "left_anti").select(F.col("book_id").alias("path"))

    before = Window.partitionBy(*SPLIT).orderBy("rec_ord")
    placed = lines.drop("n_bytes").withColumn("at", F.sum(F.length("line")).over(before) - F.length("line")).join(read, SPLIT).withColumn("at", F.col("at") + F.col("base"))
    marked, open_end = F.col("over") >= MARK - 1, F.col("over").isin(-1, MARK - 1) & ~F.col("returned")
    last = F.col("at") + F.length("line") == F.col("total")
    line = F.when(open_end & last, F.substr("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    # A byte order mark is the first character, and all others come after it.
    line = F.when(marked & (F.col("at") == 0), F.concat(F.lit("\ufeff"), line)).otherwise(line)
    at = F.when(marked & (F.col("at") > 0), F.col("at") + 1).otherwise(F.col("at"))
    pieces = placed.select("book_id", at.alias("at"), line.alias("line")).select("book_id", "at", F.posexplode(_pieces(size)).alias("i", "piece"))
    ordinal = (F.floor(F.col("at") / size) + F.col("i")).cast("bigint")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    chunks = pieces.select("book_id", ordinal.alias("ordinal"), "at", "piece").groupBy("book_id", "ordinal").agg(text.alias("text"))
    return chunks.select("book_id", "ordinal", (F.col("ordinal") * size).alias("pid"), F.length("text").cast("bigint").alias("length"), "text"), unread


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` of ``read_books`` as ``operators.books.numbered_chunks`` gives them, without a window: they have no gaps, and each begins at its pid."""
    return chunks.withColumns({"gap": F.lit(0).cast("bigint"), "end": F.col("pid") + F.col("length"), "start": F.col("pid"), "n": (F.col("ordinal") + 1).cast("int")})
