"""Annotation tables derived from the shared tables: books are documents, annotations are events.

The rules are in FIXTURES.md; every table grows with ``documents`` or ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"click": "highlight", "view": "highlight", "purchase": "note", "signup": "bookmark"}
COLORS = ("yellow", "pink", "dark_blue")
CHUNK, PAGE, LOCATION = 200, 500, 50


def configure(spark: SparkSession) -> None:
    """Session settings that the readers rely on: bad UTF-16 becomes U+FFFD instead of an error."""
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, text, author)."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("author"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per event, with the book's id, title, author and length."""
    events = _table(spark, sf_dir, "events")
    size = _table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n_docs"), F.lit(1).alias("one"))
    kind: Column = F.lit("last_position")
    for event, clip in TYPES.items():
        kind = F.when(F.col("event_type") == event, clip).otherwise(kind)
    color = F.element_at(F.array(*map(F.lit, COLORS)), (F.col("user_id") % 3 + 1).cast("int"))
    about = books(spark, sf_dir).select("book_id", "author", F.length("text").cast("bigint").alias("n_chars"))
    return (
        events.withColumn("one", F.lit(1))
        .join(F.broadcast(size), "one")
        .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "props", (F.col("event_id") % F.col("n_docs")).alias("book_id"), kind.alias("clip_type"), color.alias("color"))
        .join(about, "book_id")
        .withColumn("char_start", (F.col("event_id") * 7919) % (F.col("n_chars") + 20))
        .select(
            "event_id",
            "book_id",
            F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("book_title"),
            "author",
            "clip_type",
            F.lit(None).cast("int").alias("page"),
            "char_start",
            F.when(F.col("clip_type") == "highlight", F.col("char_start") + F.get_json_object("props", "$.k").cast("bigint")).alias("char_end"),
            F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("added_date"),
            F.when(F.col("clip_type") == "note", F.concat(F.lit("note "), F.col("event_id").cast("string"))).when(F.col("clip_type") == "last_position", "").otherwise(F.concat(F.lit("["), "color", F.lit("]"))).alias("content"),
            "color",
            F.concat(F.lit("/library/"), "author", F.lit("/Book "), F.col("book_id").cast("string"), F.lit(".sdr/a.yjr")).alias("source_file"),
            F.concat(F.lit("/library/"), "author", F.lit("/Book "), F.col("book_id").cast("string"), F.lit(".sdr")).alias("sidecar_dir"),
            F.concat(F.lit("/library/"), "author", F.lit("/Book "), F.col("book_id").cast("string"), F.lit(".sdr/a.yjr")).alias("file_ord"),
            F.when(F.col("clip_type") == "highlight", 0).when(F.col("clip_type") == "bookmark", 1).when(F.col("clip_type") == "note", 2).otherwise(3).alias("kind_ord"),
            F.col("event_id").alias("rec_ord"),
            (F.unix_millis("ts")).alias("ms"),
        )
    )


def _every(df: DataFrame, step: int) -> DataFrame:
    """One row per ``step`` characters of every book's text: ordinal from 0, at."""
    n = F.greatest(F.ceil(F.length("text") / step), F.lit(1)).cast("int")
    return df.select("book_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal")).withColumn("at", (F.col("ordinal") * step).cast("bigint"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, ordinal, pid, length, text): slices of the text, some left out."""
    cut = F.substring("text", (F.col("at") + 1).cast("int"), F.lit(CHUNK))
    return _every(books(spark, sf_dir), CHUNK).filter("(book_id + ordinal) % 13 <> 0").select("book_id", "ordinal", F.col("at").alias("pid"), F.length(cut).cast("bigint").alias("length"), cut.alias("text"))


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, ordinal, label, char_offset): with roman labels and offsets that tie."""
    label = F.when(F.col("ordinal") % 9 == 8, "ix").otherwise((F.col("ordinal") + 1).cast("string"))
    return _every(books(spark, sf_dir), PAGE).select("book_id", "ordinal", label.alias("label"), F.when(F.col("ordinal") % 25 == 24, F.col("at") - PAGE).otherwise(F.col("at")).alias("char_offset"))


def location_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, location, char_offset)."""
    return _every(books(spark, sf_dir), LOCATION).select("book_id", (F.col("ordinal") + 1).alias("location"), F.col("at").alias("char_offset"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): a sidecar folder per book with a yjr file, for every second one a mbp file, beside it book files by doc_id % 7; stray text files."""
    base = F.concat(F.lit("/library/"), F.coalesce("author", F.lit("none")), F.lit("/Book "), F.col("book_id").cast("string"))
    suffixes = F.array(*map(F.lit, (".kfx", ".azw3", ".mobi", ".epub", ".azw", ".prc")))
    picked = F.filter(suffixes, lambda s, i: (F.col("book_id") + i * i) % 7 < 2)
    return books(spark, sf_dir).select(
        F.explode(
            F.concat(
                F.array(F.concat(base, F.lit(".sdr/a.yjr"))),
                F.when(F.col("book_id") % 2 == 0, F.array(F.concat(base, F.lit(".sdr/sub/b.MBP")))).otherwise(F.array(F.concat(base, F.lit(".apnx")))),
                F.when(F.col("book_id") % 5 == 0, F.array(F.concat(base, F.lit("/My Clippings.txt")), F.concat(base, F.lit("/notes.txt")))).otherwise(F.array(F.concat(base, F.lit("/old clippings.TXT")))),
                F.transform(picked, lambda s: F.concat(base, s)),
            )
        ).alias("path")
    )


# Files in the wire formats, one per book, encoded from the annotations above.


def _be(value: Column, n: int) -> Column:
    """A number as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def _le(value: Column) -> Column:
    """A number as four little-endian bytes."""
    h = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _value(b: Column) -> Column:
    return F.concat(F.unhex(F.lit("03")), _be(F.length(b), 3), b)


def _joined(parts: DataFrame, path: Column) -> DataFrame:
    """(path, content): the records (book_id, event_id, record) of every book in order, in hexadecimal on the way."""
    rows = parts.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.hex("record").alias("h")))).alias("r"))
    return rows.select(path.alias("path"), F.unhex(F.array_join(F.transform("r", lambda x: x["h"]), "")).alias("content"))


def _path(name: str) -> Column:
    return F.concat(F.lit("/library/Book "), F.col("book_id").cast("string"), F.lit(f".sdr/{name}"))


def sidecar_files(rows: DataFrame) -> DataFrame:
    """(path, content): yjr files of all but the last positions in ``rows``."""
    key = F.concat(F.lit("annotation.personal."), "clip_type")
    start = _bytes(F.concat(F.lit("AT4:"), F.col("char_start").cast("string")))
    end = _bytes(F.concat(F.lit("AT4:"), F.coalesce("char_end", "char_start").cast("string")))
    payload = _bytes(F.when(F.col("clip_type") == "note", F.col("content")).otherwise(F.col("color")))
    time = F.when(F.col("added_date").isNotNull(), F.concat(F.unhex(F.lit("02")), _be(F.col("ms"), 8))).otherwise(F.unhex(F.lit("")))
    record = F.concat(F.unhex(F.lit("FE")), _be(F.length(key), 3), _bytes(key), F.unhex(F.lit("0100000007")), time, F.unhex(F.lit("0701")), _value(start), _value(end), _value(_bytes(F.lit("\x00\x01\x02\x03\x04"))), _value(payload), F.unhex(F.lit("FF")))
    return _joined(rows.filter("clip_type <> 'last_position'").select("book_id", "event_id", record.alias("record")), _path("a.yjr"))


def nested_files(rows: DataFrame) -> DataFrame:
    """(path, content): yjr files of the notes in ``rows``; each note's payload is a highlight's whole record between two words."""

    def record(kind: str, *values: Column) -> Column:
        return F.concat(F.unhex(F.lit("FE")), _be(F.lit(20 + len(kind)), 3), _bytes(F.lit(f"annotation.personal.{kind}")), *map(_value, values), F.unhex(F.lit("FF")))

    at = lambda n: _bytes(F.concat(F.lit("AT4:"), (F.col("char_start") + n).cast("string")))
    payload = F.concat(_bytes(F.lit("see ")), record("highlight", at(1), at(9)), _bytes(F.lit(" end")))
    outer = record("note", at(0), at(0), _bytes(F.lit("\x00\x01\x02\x03\x04")), payload)
    return _joined(rows.filter("clip_type = 'note'").select("book_id", "event_id", outer.alias("record")), _path("n.yjr"))


def position_files(rows: DataFrame) -> DataFrame:
    """(path, content): yjf files of the last positions in ``rows``."""
    place = _bytes(F.concat(F.lit("AT4:"), F.col("char_start").cast("string")))
    time = F.when(F.col("added_date").isNotNull(), F.concat(F.unhex(F.lit("02")), _be(F.col("ms"), 8))).otherwise(F.unhex(F.lit("")))
    record = F.concat(F.unhex(F.lit("FE")), _be(F.lit(3), 3), _bytes(F.lit("lpr")), F.unhex(F.lit("0100000002")), _value(F.unhex(F.lit("C328"))), _value(place), time, F.unhex(F.lit("FF")))
    return _joined(rows.filter("clip_type = 'last_position'").select("book_id", "event_id", record.alias("record")), _path("a.yjf"))


def typed_files(rows: DataFrame) -> DataFrame:
    """(path, content): mbp files of ``rows``; every seventh book's is a container."""
    kind = F.when(F.col("clip_type") == "last_position", 1).when(F.col("clip_type") == "bookmark", 2).when(F.col("clip_type") == "highlight", 3).otherwise(4)
    text = F.concat(_be(F.length("content"), 2), F.encode("content", "UTF-16LE"))
    none = F.unhex(F.lit(""))
    payload = F.concat(_be(F.col("char_start"), 4), F.when(F.col("clip_type").isin("highlight", "note"), _be(F.coalesce("char_end", "char_start"), 4)).otherwise(none), F.when(F.col("clip_type").isin("bookmark", "note"), text).otherwise(none))
    record = F.concat(_be(kind, 2), _be(F.length(payload), 2), payload, F.unhex(F.lit("0007000401020304")))
    joined = _joined(rows.select("book_id", "event_id", record.alias("record")), _path("b.mbp"))
    number = F.regexp_extract("path", r"Book (\d+)", 1).cast("bigint")
    return joined.select("path", F.when(number % 7 == 3, F.concat(_bytes(F.lit("BOOKMOBI")), "content")).otherwise(F.concat(F.unhex(F.lit("0001")), "content")).alias("content"))


def index_files(pages: DataFrame) -> DataFrame:
    """(path, content): apnx files of ``pages`` (book_id, ordinal, char_offset); every eleventh book's is too short."""
    rows = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.hex(_le(F.col("char_offset"))).alias("h")))).alias("r"))
    count = F.when(F.col("book_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"pageCount":'), F.size("r").cast("string")))
    head = _bytes(F.concat(F.lit('{"asin":"B'), F.col("book_id").cast("string"), F.lit('","contentGuid":"g'), (F.col("book_id") * 7).cast("string"), F.lit('"'), count, F.lit("}")))
    body = F.unhex(F.concat(F.hex(_le(F.size("r"))), F.array_join(F.transform("r", lambda x: x["h"]), "")))
    content = F.concat(_le(F.lit(1)), _le(F.length(head) + 8), head, body)
    return rows.select(_path("c.apnx").alias("path"), F.when(F.col("book_id") % 11 == 5, F.unhex(F.lit("01000000"))).otherwise(content).alias("content"))


def clippings_entries(rows: DataFrame) -> DataFrame:
    """(value, source_file, file_ord, rec_ord): one entry of clippings text per annotation but last positions."""
    kind = F.initcap("clip_type")
    page = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" on page "), (F.col("char_start") % 900 + 1).cast("string"))).otherwise("")
    end = F.when(F.col("char_end").isNotNull(), F.concat(F.lit("-"), F.col("char_end").cast("string"))).otherwise("")
    date = F.when(F.col("added_date").isNotNull(), F.concat(F.lit(" | Added on Monday, "), F.date_format(F.to_timestamp("added_date"), "MMMM d, yyyy h:mm:ss a"))).otherwise("")
    author = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit(" ("), "author", F.lit(")")))
    value = F.concat(F.lit("\n"), "book_title", author, F.lit("\n- Your "), kind, page, F.lit(" | Location "), F.col("char_start").cast("string"), end, date, F.lit("\n\n"), "content", F.lit("  \n\nline "), F.col("event_id").cast("string"), F.lit("\n"))
    path = F.concat(F.lit("/library/"), "author", F.lit("/My Clippings.txt"))
    return rows.filter("clip_type <> 'last_position'").select(value.alias("value"), path.alias("source_file"), path.alias("file_ord"), F.col("event_id").alias("rec_ord"))


def navigation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nav, positions): the page map as nested navigation with other containers, empty labels and unknown elements."""
    pages = page_map(spark, sf_dir)
    entry = F.struct(F.when(F.col("ordinal") % 10 == 7, "").otherwise(F.col("label")).alias("label"), (F.col("ordinal") + F.when(F.col("ordinal") % 12 == 5, 100000).otherwise(0)).cast("bigint").alias("element_id"), (F.col("char_offset") % 3).alias("offset"))
    entries = pages.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    nav = entries.select("book_id", F.array(F.struct(F.lit("toc").alias("type"), "entries"), F.struct(F.lit("page_list").alias("type"), "entries")).alias("containers"))
    return nav, pages.select("book_id", F.col("ordinal").cast("bigint").alias("element_id"), (F.col("char_offset") - F.col("char_offset") % 3).alias("base"))


def clippings_files(rows: DataFrame) -> DataFrame:
    """(path, content): clippings text of the highlights of some books: of every tenth in its sidecar folder, of others beside all folders."""
    marks = rows.filter("clip_type = 'highlight' and book_id % 10 < 2")
    entry = F.hex(_bytes(F.concat("value", F.lit("=========="))))
    entries = clippings_entries(marks).select(F.col("rec_ord").alias("event_id"), entry.alias("h")).join(marks.select("event_id", "book_id"), "event_id")
    joined = entries.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "h"))).alias("r"))
    path = F.when(F.col("book_id") % 10 == 0, _path("My Clippings.txt")).otherwise(F.concat(F.lit("/library/clippings "), F.col("book_id").cast("string"), F.lit(".txt")))
    return joined.select(path.alias("path"), F.unhex(F.array_join(F.transform("r", lambda x: x["h"]), "")).alias("content"))


def book_files(rows: DataFrame) -> DataFrame:
    """(book_id, path, content): a book file (of one byte) for two of three books, .kfx or .azw3."""
    suffix = F.when(F.col("book_id") % 3 == 1, ".kfx").otherwise(".azw3")
    path = F.concat(F.lit("/library/Book "), F.col("book_id").cast("string"), suffix)
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism  # a row is short, and its file takes as long as others
    return rows.select("book_id").filter("book_id % 3 <> 0").distinct().repartition(spread, "book_id").select("book_id", path.alias("path"), F.lit(b"\x00").alias("content"))


def text_files(books: DataFrame) -> DataFrame:
    """(path, content): the texts of ``books`` (book_id, text) as files; of every four, two end their lines otherwise and two have a byte order mark."""
    ends = F.when(F.col("book_id") % 4 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("book_id") % 4 == 2, F.concat(F.replace("text", F.lit("\n"), F.lit("\r")), F.lit("\r"))).otherwise(F.col("text"))
    mark = F.when(F.col("book_id") % 4 >= 2, F.lit("\ufeff")).otherwise("")
    path = F.concat(F.lit("/library/Book "), F.col("book_id").cast("string"), F.lit(".txt"))
    return books.filter("text <> ''").select(path.alias("path"), _bytes(F.concat(mark, ends)).alias("content"))


def _wrong(files: DataFrame, hit: Column) -> DataFrame:
    """(path, content): checksum files that make those of ``files`` (path) that are ``hit`` unreadable."""
    return files.filter(hit).select(F.regexp_replace("path", r"/([^/]*)\z", "/.$1.crc").alias("path"), F.concat(_bytes(F.lit("crc\x00")), _be(F.lit(512), 4), _be(F.lit(0), 4)).alias("content"))


def wrong_sums(files: DataFrame) -> DataFrame:
    """(path, content): checksum files that make some of ``files`` (path) unreadable, of every format but mbp."""
    number = F.regexp_extract("path", r"(?:Book|clippings) (\d+)", 1).cast("bigint")
    return _wrong(files, (F.endswith("path", F.lit(".yjr")) & (number % 19 == 4)) | (F.endswith("path", F.lit(".yjf")) & (number % 23 == 5)) | (F.endswith("path", F.lit(".apnx")) & (number % 29 == 3)) | (F.endswith("path", F.lit(".txt")) & (number % 30).isin(10, 21)))


def wrong_text_sums(files: DataFrame) -> DataFrame:
    """(path, content): checksum files that make the books' texts among ``files`` (path) unreadable whose number leaves 7 of 17."""
    return _wrong(files, F.regexp_extract("path", r"Book (\d+)", 1).cast("bigint") % 17 == 7)


def write_files(files: DataFrame, root: str) -> None:
    """Write ``files`` (path, content) below ``root``, a URI that the executors can open."""

    def write(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        local = root.startswith("file:")
        made = None
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                into = f"{folder}{path.as_py()}".rpartition("/")[0]
                if into != made:
                    store.create_dir(into, recursive=True)
                    made = into
                to = f"{folder}{path.as_py()}"
                with open(to, "wb") if local else store.open_output_stream(to, compression=None) as out:  # Arrow takes twice as long for a local file
                    out.write(content.as_py())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(write, "path string").count()
