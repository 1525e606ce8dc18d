"""Sidecar files of any length, read in splits: pieces between the first bytes of records, and records that span pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.paths import from_uri, local_path
from marginalia.sources.files import by_name, contents, cut, listing, named, short
from marginalia.sources.sidecar import ANNOTATION_KEYS, POSITION_KEY, annotations_of, last_positions_of, values_of
from marginalia.sources.storage import saved

#: How every record of a key under 256 bytes begins; the key's length in a byte and the key come after it.
MARK = b"\xfe\x00\x00"
#: Pieces and the records that need them meet by their place in so many bytes of a file.
BIN = 65536
#: A list of up to so many splits is broadcast to their pieces.
BROADCAST_SPLITS = 100_000
#: What names a split.
SPLIT = ["path", "split"]


def read_pieces(spark: SparkSession, path: str | list[str], glob: str, longer: int = -1, files: DataFrame | None = None) -> DataFrame:
    """(path, file_bytes, split, within, piece) of the files of more than ``longer`` bytes: what stands between two MARKs, or a MARK and an end.

    split is the place of a split in its file, within the piece's place in its split, each piece taken with a MARK behind it. A piece has to fit
    in a row, a file need not. A reader that begins inside a file begins after the first MARK there, and the one before it reads up to it.
    Files that are shorter than a split are read as rows and cut there. ``files``: the ``listing`` of ``path`` and ``glob``, where it has been listed already.
    """
    files, most = listing(spark, path, glob) if files is None else files, short(spark)
    pieces = cut(contents(files.filter(F.col("file_size") > longer).filter(F.col("file_size") <= most)), MARK).select("path", F.col("length").alias("file_bytes"), F.lit(0).cast("bigint").alias("split"), "i", "piece")
    longest = max(longer, most)
    long = files.filter(F.col("file_size") > longest)
    if not long.select("path").isEmpty():
        pieces = pieces.unionByName(_split_pieces(spark, *by_name(long, path, glob), longest))
    before = Window.partitionBy(*SPLIT).orderBy("i")
    return pieces.withColumn("within", (F.sum(_taken()).over(before) - _taken()).cast("bigint")).drop("i")


def _split_pieces(spark: SparkSession, path: str | list[str], glob: str, longer: int) -> DataFrame:
    """(path, file_bytes, split, i, piece) of the files of more than ``longer`` bytes, from their splits."""
    reader = spark.read.option("lineSep", MARK.decode("ISO-8859-1")).option("encoding", "ISO-8859-1").option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(path).filter(F.col("_metadata.file_size") > longer)
    return rows.select(
        local_path(from_uri(F.col("_metadata.file_path"))).alias("path"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("i"),
        F.col("value").cast("binary").alias("piece"),
    )


def _taken() -> Column:
    return F.octet_length("piece") + len(MARK)


def placed(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, unread): ``pieces`` as (path, end, at, piece), with their place in the file and where it ends, and the files (path) of which fewer bytes were read than they have.

    What is summed is a number for each split. The file's last piece has a MARK behind it here, whether it is there or not, and the reader
    takes a byte order mark off: so the bytes read are the file's, or three more or fewer.
    """
    sums = pieces.groupBy(*SPLIT, "file_bytes").agg(F.sum(_taken()).alias("n"))
    book = Window.partitionBy("path")
    total = F.sum("n").over(book)
    splits = sums.select(*SPLIT, (F.sum("n").over(book.orderBy("split")) - F.col("n")).alias("base"), (F.col("file_bytes") - total).alias("over"), F.least("file_bytes", total).alias("end"))
    whole = F.col("over").between(-len(MARK), len(MARK))
    splits = saved(splits, "splits")
    # Never the other way round: the pieces are decoded where they are read.
    of_whole = splits.filter(whole).drop("over")
    of_whole = F.broadcast(of_whole) if splits.count() <= BROADCAST_SPLITS else of_whole.hint("shuffle_hash")
    known = pieces.join(of_whole, SPLIT)
    return known.select("path", "end", (F.col("base") + F.col("within")).alias("at"), "piece"), splits.filter(~whole).select("path").distinct()


def split_records(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(path, rec_ord, key, body, strings, time) of the ``placed`` pieces (path, end, at, piece), as ``sidecar.records`` gives them of whole files; rec_ord is the place in the file.

    Nearly all records end in their own piece. One whose last value goes on (so one that holds a MARK) gets as many of the next bytes
    as that value needs, at least twice as many each time, until it ends or the file does: rounds grow with the logarithm of the
    longest record, and a row holds no more than twice its record and a piece.
    """
    name = F.coalesce(*(F.when(F.startswith("piece", F.lit(bytes([len(k)]) + k.encode())), F.lit(k)) for k in keys))
    begun = pieces.filter("at > 0").withColumn("key", name).filter("key is not null")
    start = F.octet_length("key") + 1
    rows = begun.select("path", "end", (F.col("at") + start).alias("at"), "key", F.expr("substring(piece, length(key) + 2)").alias("rest")).withColumn("part", F.col("rest"))
    read = saved(_read(rows), "records")
    done = [_ended(read)]
    while not read.filter(_open()).isEmpty():
        wanted = (F.greatest("v.needs", 2 * F.octet_length("part")) + len(MARK)).cast("bigint")  # so the next piece at least
        longer = read.filter(_open()).withColumn("wanted", F.least(wanted, F.col("end") - F.col("at")))
        read = saved(_read(_extended(longer, pieces)), "records")
        done.append(_ended(read))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _read(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.expr(values_of("part")))


def _open() -> Column:
    """Whether a record's last value goes on and the file does."""
    return (F.col("v.needs") > 0) & (F.col("at") + F.octet_length("part") < F.col("end"))


def _ended(read: DataFrame) -> DataFrame:
    return read.filter(~_open()).select("path", F.col("at").alias("rec_ord"), "key", F.lit(None).cast("binary").alias("body"), "v.strings", "v.time")


def _extended(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with what begins within the ``wanted`` bytes from their place on as part: joined with the pieces by bins of the file."""
    own = ["path", "end", "at", "key"]
    bins = F.sequence(F.floor(F.col("at") / BIN), F.floor((F.col("at") + F.col("wanted") - 1) / BIN))
    asked = rows.select("path", F.col("at").alias("from"), "wanted", F.explode(bins).alias("bin"))
    there = pieces.select("path", F.col("at").alias("place"), "piece", F.floor(F.col("at") / BIN).alias("bin"))
    met = asked.join(there, ["path", "bin"]).filter((F.col("place") > F.col("from")) & (F.col("place") < F.col("from") + F.col("wanted")))
    after = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: F.concat(F.lit(MARK), p["piece"]))
    joined = met.groupBy("path", F.col("from").alias("at")).agg(F.aggregate(after, F.lit(b""), lambda a, b: F.concat(a, b)).alias("after"))
    part = F.concat("rest", F.coalesce("after", F.lit(b"")))
    # Pieces are taken whole: what comes after them is a MARK, at which values end, or the file's end, and there only the file knows whether a MARK stands.
    left = F.col("end") - F.col("at")
    whole = F.substring(F.concat(part, F.lit(MARK)), F.lit(1), left.cast("int"))
    return rows.join(joined, ["path", "at"], "left").select(*own, "rest", F.when(F.col("wanted") == left, whole).otherwise(part).alias("part"))


YJR, YJF = "*.[yY][jJ][rR]", "*.[yY][jJ][fF]"


def read_split_annotations(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """Annotations of yjr files of any length; files not read to their end give none. ``files``: the ``listing`` of ``path``, where it has been listed already."""
    pieces, _ = placed(saved(read_pieces(spark, path, YJR, files=None if files is None else files.filter(named(YJR))), "pieces"))
    return annotations_of(split_records(pieces, list(ANNOTATION_KEYS)))


def read_split_positions(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """Last reading positions of yjf files of any length; files not read to their end give none. ``files`` as in ``read_split_annotations``."""
    pieces, _ = placed(saved(read_pieces(spark, path, YJF, files=None if files is None else files.filter(named(YJF))), "pieces"))
    return last_positions_of(split_records(pieces, [POSITION_KEY]))
