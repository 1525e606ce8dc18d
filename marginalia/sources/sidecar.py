"""Sidecar records: keyed records of tagged values in binary files, as annotations and last reading positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.binary import bound, epoch_ms, uint
from marginalia.functions.paths import sidecar_dir, stem
from marginalia.functions.text import parsed_time, strip, utf8
from marginalia.schema import conform
from marginalia.sources.files import read_files

#: Fixed values of the format: the keys with their kinds and order, the key of the last position,
#: the longest byte string, the length of the marker between position and payload.
ANNOTATION_KEYS = {"annotation.personal.highlight": ("highlight", 0), "annotation.personal.bookmark": ("bookmark", 1), "annotation.personal.note": ("note", 2)}
POSITION_KEY = "lpr"
LONGEST = 65536
MARKER = 5


def _prefix(key: str) -> bytes:
    """A record's first bytes: FE, the key's length in three bytes, the key."""
    return b"\xfe" + len(key).to_bytes(3, "big") + key.encode()


def _pattern(prefix: bytes) -> str:
    """A regular expression for ``prefix`` in the Latin-1 view, as it stands in a SQL literal."""
    return "".join(chr(c) if chr(c).isalnum() and c < 128 else f"\\\\x{c:02x}" for c in prefix)


#: What a binary file is cut into, whatever its format: the record's place, what it is, its bytes; of sidecar records, the values instead of bytes.
SEGMENTS = "array<struct<rec_ord:bigint,key:string,body:binary,strings:array<binary>,time:binary>>"


def segments(keys: list[str]) -> Column:
    """The records of ``keys`` in ``content``, wherever one begins, as SEGMENTS: with their byte strings and first time.

    A record begins at every place where its first bytes stand, also inside another's payload, and each is read to its own end.
    The content is cut at these places once; a record whose last value goes on beyond its piece (so one that holds other
    records) is read again with as many of the next pieces as that value needs, until it ends.
    """
    ahead = "(?s)(?=" + "|".join(_pattern(_prefix(k)) for k in keys) + ")"
    key = "case " + " ".join(f"when startswith(p, decode(X'{_prefix(k).hex()}', 'ISO-8859-1')) then '{k}'" for k in keys) + " end"
    found = f"filter(transform(ps, (p, i) -> named_struct('rec_ord', cast(i as bigint), 'key', {key}, 'part', p)), r -> r.key is not null)"
    own = values_of("encode(substring(r.part, length(r.key) + 5), 'ISO-8859-1')")
    before = "aggregate(slice(ps, 1, cast(r.rec_ord as int)), length(r.key) + 5, (a, p) -> a + length(p))"  # the place of the values, from 1
    again = values_of("substring(content, at, t.n + length(p))")
    later = f"""aggregate(slice(ps, cast(r.rec_ord + 2 as int), size(ps)), named_struct('n', length(r.part) - length(r.key) - 4, 'v', v),
        (t, p) -> case when t.v.needs = 0 or t.v.needs > t.n + length(p) then named_struct('n', t.n + length(p), 'v', t.v)
            else named_struct('n', t.n + length(p), 'v', {again}) end,
        t -> t.v)"""
    more = f"case when v.needs = 0 then v else {bound(before, 'at', later)} end"
    read = f"named_struct('rec_ord', r.rec_ord, 'key', r.key, 'body', cast(null as binary), 'v', {bound(own, 'v', more)})"
    flat = "named_struct('rec_ord', r.rec_ord, 'key', r.key, 'body', r.body, 'strings', r.v.strings, 'time', r.v.time)"
    return F.expr(bound(f"split(decode(content, 'ISO-8859-1'), '{ahead}')", "ps", f"transform(transform({found}, r -> {read}), r -> {flat})"))


def records(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, rec_ord, key, body, strings, time) of ``files`` (path, content)."""
    return files.select("path", F.inline(segments(keys)))


def values_of(body: str) -> str:
    """SQL of (strings, time, needs) of the bytes ``body``: byte strings and first time, folded value by value until the record ends.

    needs is 0 for a record that ends within the bytes, else how many bytes there must be for its last value to end.
    """
    n = uint("b", "s.at + 1", 3)
    state = "named_struct('at', {at}, 'done', {done}, 'strings', {strings}, 'time', {time}, 'needs', {needs})"
    go = lambda at, strings="s.strings", time="s.time": state.format(at=at, done="false", strings=strings, time=time, needs="0")
    stop = lambda needs="0": state.format(at="s.at", done="true", strings="s.strings", time="s.time", needs=f"cast({needs} as int)")
    tag = "hex(substring(b, s.at, 1))"
    step = f"""case
        when s.done or s.at > length(b) then s
        when {tag} in ('FE', 'FF') then {stop()}
        when {tag} = '01' then case when s.at + 4 > length(b) then {stop("s.at + 4")} else {go("s.at + 5")} end
        when {tag} = '02' then case when s.at + 8 > length(b) then {stop("s.at + 8")} else {go("s.at + 9", time="coalesce(s.time, substring(b, s.at + 1, 8))")} end
        when {tag} = '03' then case
            when s.at + 3 > length(b) then {stop("s.at + 3")}
            when {n} > {LONGEST} then {stop()}
            when s.at + 3 + {n} > length(b) then {stop(f"s.at + 3 + {n}")}
            else {go(f"cast(s.at + 4 + {n} as int)", strings=f"concat(s.strings, array(substring(b, s.at + 4, cast({n} as int))))")} end
        when {tag} = '07' then {go("s.at + 2")}
        else {go("s.at + 1")} end"""
    start = state.format(at="1", done="false", strings="cast(array() as array<binary>)", time="cast(null as binary)", needs="0")
    last = "s -> named_struct('strings', s.strings, 'time', s.time, 'needs', case when s.done then s.needs when s.at > length(b) + 1 then s.at - 1 else 0 end)"
    return bound(body, "b", f"aggregate(sequence(1, greatest(length(b), 1)), {start}, (s, i) -> {step}, {last})")


def _position(text: Column) -> Column:
    """The number after the last colon; null without one."""
    number = F.substring_index(text, ":", -1)
    return F.when(F.contains(text, F.lit(":")) & number.rlike(r"\A[0-9]+\z"), number.try_cast("bigint"))


def _time(value: str) -> Column:
    return F.expr(epoch_ms(value))


def annotations_of(found: DataFrame) -> DataFrame:
    """Annotations of the ``records`` of sidecar files; those of fewer than two byte strings are dropped.

    The title is the file's stem; ``corpus.with_titles`` puts the sidecar's in its place.
    """
    kinds = F.create_map(*(F.lit(x) for k, (kind, _) in ANNOTATION_KEYS.items() for x in (k, kind)))
    order = F.create_map(*(F.lit(x) for k, (_, i) in ANNOTATION_KEYS.items() for x in (k, i)))
    third, fourth = utf8(F.get("strings", F.lit(2))), utf8(F.get("strings", F.lit(3)))
    n, marked, note = F.size("strings"), F.length(F.get("strings", F.lit(2))) == MARKER, F.col("clip_type") == "note"
    payload = F.when(n >= 4, F.when(marked, fourth)).when((n == 3) & ~marked, third)
    content = F.when(note, F.coalesce(payload, F.lit(""))).otherwise("")
    content = F.when((n >= 4) & ~marked, third).otherwise(content)
    color = F.when(~note, F.coalesce(payload, F.lit(""))).otherwise("")
    start, end = _position(utf8(F.get("strings", F.lit(0)))), _position(utf8(F.get("strings", F.lit(1))))
    return conform(
        found.select("path", "rec_ord", kinds[F.col("key")].alias("clip_type"), order[F.col("key")].alias("kind_ord"), "strings", _time("time").alias("added_date"))
        .filter(n >= 2)
        .withColumns({"start": start, "end": end, "text": content, "color": color})
        .select(
            stem(F.col("path")).alias("book_title"),
            F.lit("").alias("author"),
            "clip_type",
            F.col("start").alias("location_start"),
            F.nullif("end", "start").alias("location_end"),
            "added_date",
            F.when(F.col("color") != "", strip(F.concat(F.lit("["), "color", F.lit("] "), "text"))).otherwise(F.col("text")).alias("content"),
            F.col("path").alias("source_file"),
            parsed_time(F.col("added_date")).alias("added_ts"),
            sidecar_dir(F.col("path")).alias("sidecar_dir"),
            F.col("path").alias("file_ord"),
            "kind_ord",
            "rec_ord",
        )
    )


def decode_annotations(files: DataFrame) -> DataFrame:
    """Annotations of sidecar ``files`` (path, content)."""
    return annotations_of(records(files, list(ANNOTATION_KEYS)))


def last_positions_of(found: DataFrame) -> DataFrame:
    """Last reading positions of the ``records`` of position files: the first valid UTF-8 string that ends in a colon and digits."""
    ends_in_number = lambda b: F.is_valid_utf8(b.cast("string")) & b.cast("string").rlike(r":[0-9]+\n?\z")
    position = F.get(F.filter("strings", ends_in_number), F.lit(0)).cast("string")
    return conform(
        found.select("path", "rec_ord", position.alias("position"), _time("time").alias("added_date"))
        .filter("position is not null")
        .select(
            stem(F.col("path")).alias("book_title"),
            F.lit("").alias("author"),
            F.lit("last_position").alias("clip_type"),
            _position(F.regexp_replace("position", r"\n\z", "")).alias("location_start"),
            "added_date",
            F.lit("").alias("content"),
            F.col("path").alias("source_file"),
            parsed_time(F.col("added_date")).alias("added_ts"),
            sidecar_dir(F.col("path")).alias("sidecar_dir"),
            F.col("path").alias("file_ord"),
            F.lit(0).alias("kind_ord"),
            "rec_ord",
        )
    )


def decode_last_positions(files: DataFrame) -> DataFrame:
    """Last reading positions of ``files`` (path, content)."""
    return last_positions_of(records(files, [POSITION_KEY]))


def read_sidecar_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_annotations(read_files(spark, path, "*.[yY][jJ][rR]"))


def read_last_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return decode_last_positions(read_files(spark, path, "*.[yY][jJ][fF]"))
