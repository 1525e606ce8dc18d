"""A whole tree of annotation files: routing by name, titles from sidecar folders, union of all formats, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import ancestors, name, sidecar_dir, stem, suffix
from marginalia.sources.clippings import parse_entries, read_entries, unread_files
from marginalia.sources.files import contents, listing
from marginalia.sources.files import listed as listed_files
from marginalia.sources.page_index import SHORTEST, decode_page_indexes
from marginalia.sources.sidecar import (
    ANNOTATION_KEYS,
    POSITION_KEY,
    SEGMENTS,
    annotations_of,
    decode_annotations,
    decode_last_positions,
    last_positions_of,
    segments,
)
from marginalia.sources.sidecar_splits import placed, read_pieces, split_records
from marginalia.sources.storage import saved
from marginalia.sources.typed import annotations_of as typed_annotations
from marginalia.sources.typed import decode_records, is_container
from marginalia.sources.typed import segments as typed_segments

#: The binary formats and their suffixes (fixed values).
FORMATS = {"yjr": ".yjr", "yjf": ".yjf", "mbp": ".mbp", "apnx": ".apnx"}


#: What a sidecar folder's path ends in.
SIDECAR = r"\.(?i:sdr)\z"


def route(path: Column) -> Column:
    """The format of a file by its name in any case: clippings, yjr, yjf, mbp, apnx; null for others."""
    lowered, ext = F.lower(name(path)), F.lower(suffix(path))
    found = F.when((lowered == "my clippings.txt") | ((ext == ".txt") & F.contains(lowered, F.lit("clipping"))), F.lit("clippings"))
    for kind, own in FORMATS.items():
        found = found.when(ext == own, F.lit(kind))
    return found


def file_route() -> Column:
    """``route`` of the files of a ``listing``, by the name that is known before a file is opened."""
    return route(F.col("file_name"))


def sidecar_title(folder: Column) -> Column:
    """A sidecar folder's name without .sdr in lower case; a suffix in other cases stays."""
    return F.regexp_replace(name(folder), r"\.sdr\z", "")


def sidecar_folders(files: DataFrame) -> DataFrame:
    """(dir): the nearest sidecar folder of every yjr and yjf file in ``files`` (path)."""
    return files.filter(route(F.col("path")).isin("yjr", "yjf")).select(sidecar_dir(F.col("path")).alias("dir")).filter("dir is not null").distinct()


def titles(files: DataFrame) -> DataFrame:
    """(path, book_title) of ``files`` (path): by the deepest ancestor that is a sidecar folder with yjr or yjf files, else the stem."""
    above = files.select("path", F.explode(F.filter(ancestors(F.col("path")), lambda a: a["dir"].rlike(SIDECAR))).alias("a")).select("path", "a.dir", "a.depth")
    deepest = above.join(sidecar_folders(files), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("dir"))
    return files.select("path").join(deepest, "path", "left").select("path", F.coalesce(sidecar_title(F.col("dir")), stem(F.col("path"))).alias("book_title"))


def with_titles(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """``annotations`` with the titles of their source files; clippings-text rows keep their own."""
    binary = files.filter(route(F.col("path")).isin(*FORMATS))
    named = titles(binary).withColumnRenamed("book_title", "_title")
    joined = annotations.join(named, annotations["source_file"] == named["path"], "left")
    return joined.withColumn("book_title", F.coalesce("_title", "book_title")).select(annotations.columns)


def _reason() -> Column:
    """Why a file (path, content) can't be decoded; null if it can."""
    kind = route(F.col("path"))
    return F.when((kind == "apnx") & (F.length("content") < SHORTEST), "page index too short").when((kind == "mbp") & F.expr(f"coalesce({is_container()}, false)"), "container format")


def quarantine(files: DataFrame) -> DataFrame:
    """(source_file, format, reason) of the ``files`` (path, content) that can't be decoded."""
    return files.select(F.col("path").alias("source_file"), route(F.col("path")).alias("format"), _reason().alias("reason")).filter("reason is not null")


def unreadable(listed: DataFrame, read: DataFrame) -> DataFrame:
    """(source_file, format, reason) of the files in ``listed`` (path) that are not in ``read`` (path)."""
    return failed_files(listed.select("path").join(read.select("path"), "path", "left_anti"))


def failed_files(files: DataFrame) -> DataFrame:
    """(source_file, format, reason) of ``files`` (path) that could not be read."""
    return files.select(F.col("path").alias("source_file"), route(F.col("path")).alias("format"), F.lit("unreadable").alias("reason"))


def decode_all(files: DataFrame) -> DataFrame:
    """The annotations of all binary formats in ``files`` (path, content); duplicates stay."""
    of = lambda kind: files.filter(route(F.col("path")) == kind)
    return decode_annotations(of("yjr")).unionByName(decode_last_positions(of("yjf"))).unionByName(decode_records(of("mbp")))


SIDECARS = "*.{[yY][jJ][rR],[yY][jJ][fF]}"
#: Sidecar files of more bytes are read in splits instead of rows; the records are the same.
LONG = 1 << 26
TEXT = "*.[tT][xX][tT]"
#: What becomes of a binary file: its records belong to annotations or to page indexes, or it has none, or it can't be decoded.
OUTCOMES = ("annotations", "page_indexes", "nothing", "failures")


def cut_files(files: DataFrame) -> DataFrame:
    """(path, format, reason, rec_ord, key, body, strings, time, outcome) of binary ``files`` (path, content): one row for each record, one for a file without any.

    Every format is cut in the same pass over the contents, and the values of sidecar records are read there, as one may lie inside another; all else is decoded from the rows.
    """
    kind, reason = route(F.col("path")), _reason()
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("rec_ord"), F.lit("apnx").alias("key"), F.col("content").alias("body"), F.lit(None).cast("array<binary>").alias("strings"), F.lit(None).cast("binary").alias("time")))
    cut = F.when(reason.isNotNull(), F.array().cast(SEGMENTS)).when(kind == "yjr", segments(list(ANNOTATION_KEYS))).when(kind == "yjf", segments([POSITION_KEY])).when(kind == "mbp", typed_segments()).when(kind == "apnx", whole)
    rows = files.select("path", kind.alias("format"), reason.alias("reason"), F.explode_outer(cut).alias("r"))
    outcome = F.when(F.col("reason").isNotNull(), "failures").when(F.col("r").isNull(), "nothing").when(F.col("format") == "apnx", "page_indexes").otherwise("annotations")
    return rows.select("path", "format", "reason", "r.rec_ord", "r.key", "r.body", "r.strings", "r.time", outcome.alias("outcome"))


def cut_long_files(spark: SparkSession, path: str, longer: int, files: DataFrame | None = None) -> DataFrame:
    """The rows of ``cut_files`` of the sidecar files of more than ``longer`` bytes, which are read in splits; files not read to their end have none."""
    pieces, _ = placed(saved(read_pieces(spark, path, SIDECARS, longer, files), "pieces"))
    kind = route(F.col("path"))
    found = [split_records(pieces.filter(kind == k), keys).withColumn("format", F.lit(k)) for k, keys in (("yjr", list(ANNOTATION_KEYS)), ("yjf", [POSITION_KEY]))]
    records = found[0].unionByName(found[1])
    files = pieces.select("path").distinct().select("path", route(F.col("path")).alias("format")).join(records.drop("format"), "path", "left")
    outcome = F.when(F.col("key").isNull(), "nothing").otherwise("annotations")
    return files.select("path", "format", F.lit(None).cast("string").alias("reason"), "rec_ord", "key", "body", "strings", "time", outcome.alias("outcome"))


def annotations_of_records(found: DataFrame) -> DataFrame:
    """The annotations of all formats in the rows of ``cut_files``."""
    of = lambda kind: found.filter((F.col("outcome") == "annotations") & (F.col("format") == kind))
    return annotations_of(of("yjr")).unionByName(last_positions_of(of("yjf"))).unionByName(typed_annotations(of("mbp")))


def scan_corpus(spark: SparkSession, path: str, listed: DataFrame | None = None, long: int = LONG, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, page indexes, quarantine) of all files below ``path``; files that can't be read or decoded are in the quarantine.

    Each file's content is read once: binary files are cut into records, and texts into entries, which are written to the shared
    folder by outcome. What was listed and didn't arrive, or not to its end, is unreadable: nothing of it is returned, and the scan goes on.
    ``listed`` (path, length): the files below ``path``, where they have been listed already, and ``files`` the ``listing`` of them. Sidecar files of more than ``long`` bytes
    are read in splits, others are one row each.
    """
    files = listing(spark, path) if files is None else files
    kind, listed = route(F.col("path")), saved(listed_files(files), "listed") if listed is None else listed
    binary, texts = listed.filter(kind.isin(*FORMATS)), listed.filter(kind == "clippings")
    sidecars = files.filter(file_route().isin("yjr", "yjf"))
    whole = files.filter(file_route().isin("mbp", "apnx") | file_route().isin("yjr", "yjf") & (F.col("file_size") <= long))
    cut = cut_files(contents(whole).select("path", "content"))
    if not listed.filter(kind.isin("yjr", "yjf") & (F.col("length") > long)).isEmpty():
        cut = cut.unionByName(cut_long_files(spark, path, long, sidecars))
    records = saved(cut, "records", "outcome")
    clippings = files.filter(file_route() == "clippings")
    entries = saved(read_entries(spark, path, TEXT, clippings).filter(route(F.col("source_file")) == "clippings"), "entries")
    unread = saved(unread_files(texts, entries), "unread")
    text = parse_entries(entries.join(unread, entries["source_file"] == unread["path"], "left_anti"))
    annotations = with_titles(annotations_of_records(records).unionByName(text), binary)
    indexes = decode_page_indexes(records.filter("outcome = 'page_indexes'").select("path", F.col("body").alias("content")))
    failed = records.filter("outcome = 'failures'").select(F.col("path").alias("source_file"), "format", "reason")
    return annotations, indexes, failed.unionByName(unreadable(binary, records.select("path").distinct())).unionByName(failed_files(unread))
