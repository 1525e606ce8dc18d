"""Typed annotation records: a run of (type, length, payload) in a binary file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.binary import bound, uint
from marginalia.functions.paths import sidecar_dir, stem
from marginalia.schema import conform
from marginalia.sources.files import read_files

#: Fixed values of the format: record types with their kinds and least payloads, and the magic of a container that isn't decoded.
KINDS = {1: ("last_position", 4), 2: ("bookmark", 4), 3: ("highlight", 8), 4: ("note", 8)}
CONTAINER_MAGIC = b"BOOKMOBI".hex()
#: Record places are gathered in pieces of so many before they join the list.
PIECE = 512


def is_container() -> str:
    return f"substring(content, 1, 8) = X'{CONTAINER_MAGIC}'"


def _places() -> str:
    """SQL of array<struct<kind, at, n>>: type, payload place and length of every record in ``content``."""
    size = uint("c", "s.at + 2", 2)
    place = f"named_struct('kind', cast({uint('c', 's.at', 2)} as int), 'at', s.at + 4, 'n', cast({size} as int))"
    kind = "array<struct<kind:int,at:int,n:int>>"
    step = f"""case when s.at + 3 > length(c) then s
        when size(s.piece) = {PIECE} then named_struct('at', cast(s.at + 4 + {size} as int), 'piece', array({place}), 'full', concat(s.full, array(s.piece)))
        else named_struct('at', cast(s.at + 4 + {size} as int), 'piece', concat(s.piece, array({place})), 'full', s.full) end"""
    version = "case when length(c) >= 2 and substring(c, 1, 2) in (X'0001', X'0002') then 3 else 1 end"
    start = f"named_struct('at', {version}, 'piece', cast(array() as {kind}), 'full', cast(array() as array<{kind}>))"
    fold = f"aggregate(sequence(1, greatest(cast(length(c) / 4 as int), 1)), {start}, (s, i) -> {step}, s -> concat(flatten(s.full), s.piece))"
    return bound("content", "c", f"transform({fold}, p -> named_struct('kind', p.kind, 'payload', substring(c, p.at, p.n)))")


def _string(at: int) -> str:
    """SQL of the string at byte ``at`` (from 1) of ``payload``: two bytes of count and UTF-16LE, or one and Latin-1."""
    count, short = uint("payload", str(at), 2), uint("payload", str(at), 1)
    return f"""case when {at} + 1 > length(payload) then ''
        when {at} + 1 + 2 * {count} <= length(payload) then decode(substring(payload, {at} + 2, cast(2 * {count} as int)), 'UTF-16LE')
        when {at} + {short} <= length(payload) then decode(substring(payload, {at} + 1, cast({short} as int)), 'ISO-8859-1')
        else '' end"""


def segments() -> Column:
    """The records in ``content``, as the sidecar's SEGMENTS: their types as keys, their payloads as bodies."""
    return F.transform(F.expr(_places()), lambda r, i: F.struct(i.cast("bigint").alias("rec_ord"), r["kind"].cast("string").alias("key"), r["payload"].alias("body"), F.lit(None).cast("array<binary>").alias("strings"), F.lit(None).cast("binary").alias("time")))


def annotations_of(found: DataFrame) -> DataFrame:
    """Annotations of the records (path, rec_ord, key, body) of typed-record files; other types and payloads too short for theirs are skipped.

    Unpaired surrogates need the session setting spark.sql.legacy.codingErrorAction=true to become U+FFFD.
    """
    known = " or ".join(f"kind = {k} and length(payload) >= {least}" for k, (_, least) in KINDS.items())
    clip_type = F.create_map(*(F.lit(x) for k, (name, _) in KINDS.items() for x in (k, name)))
    return conform(
        found.select("path", "rec_ord", F.col("key").cast("int").alias("kind"), F.col("body").alias("payload"))
        .filter(known)
        .select(
            stem(F.col("path")).alias("book_title"),
            F.lit("").alias("author"),
            clip_type[F.col("kind")].alias("clip_type"),
            F.expr(uint("payload", "1", 4)).alias("location_start"),
            F.expr(f"case when kind in (3, 4) then {uint('payload', '5', 4)} end").alias("location_end"),
            F.expr(f"case kind when 2 then {_string(5)} when 4 then {_string(9)} else '' end").alias("content"),
            F.col("path").alias("source_file"),
            sidecar_dir(F.col("path")).alias("sidecar_dir"),
            F.col("path").alias("file_ord"),
            F.lit(0).alias("kind_ord"),
            "rec_ord",
        )
    )


def decode_records(files: DataFrame) -> DataFrame:
    """Annotations of typed-record ``files`` (path, content); containers are left out."""
    return annotations_of(files.filter(f"not coalesce({is_container()}, false)").select("path", F.inline(segments())))


def read_typed_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_records(read_files(spark, path, "*.[mM][bB][pP]"))
