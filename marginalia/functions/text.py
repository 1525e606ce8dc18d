"""String expressions with Unicode white space, as annotation exports need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in a regular expression: Unicode's, and the four information separators.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\R|[\x1c-\x1e]"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U){SPACE}+\z", "")


def is_blank(s: Column) -> Column:
    return ~s.rlike(rf"(?U)[^\s\x1c-\x1f]")


def collapse(s: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(s), rf"(?U){SPACE}+", " ")


def lines(s: Column) -> Column:
    return F.split(s, LINE_BREAK)


def utf8(b: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def absent_if_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def parsed_time(date: Column) -> Column:
    """The instant of an annotation's date text, in either of its formats; null for others."""
    spelled = F.regexp_replace(date, r"\A[^,]+, ", "")
    return F.coalesce(F.try_to_timestamp(date, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(spelled, F.lit("MMMM d, yyyy h:mm:ss a")))
