"""Expressions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name(path), r"(?s)(?<=.)\.[^.]+\z", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or an empty string."""
    return F.regexp_extract(name(path), r"(?s).(\.[^.]+)\z", 1)


def sidecar_dir(path: Column) -> Column:
    """The nearest ancestor whose name ends in .sdr, in any case; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"(?s)\A(.*/[^/]+\.(?i:sdr)|[^/]+\.(?i:sdr))/", 1), F.lit(""))


def ancestors(path: Column) -> Column:
    """All directories above a path, as an array of (depth, dir)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def local_path(uri: Column) -> Column:
    """A file's URI without scheme and, for local files, without the doubled slashes."""
    return F.regexp_replace(uri, r"\Afile:/+", "/")


def from_uri(uri: Column) -> Column:
    """A percent-encoded URI as text; a plus sign stands for itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
