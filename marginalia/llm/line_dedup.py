"""Line dedup by a deletion-neighbourhood join.

Lines within one edit of each other share a variant: the line itself, or the line less
one character. All variants are hashed and joined, pairs are verified by comparing the variants themselves,
and of equal or near lines the earliest stays. One edit leaves the first or the second half of
the shorter line as it is, so only lines that share a half with another line can have a
partner; the halves cost four keys a line. These are cut into finer parts, and lines that share all but one part
with another emit the variants of that part, so that a line of n characters costs about n to the power of 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, saved, small

#: A table of up to so many rows of at most 40 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _hashes(line: str) -> tuple[Column, Column]:
    """128 bits that stand for a line."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")


def dedup_lines(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_chars: int = 12) -> DataFrame:
    """Keep of all equal or near lines of ``docs`` (doc_id, text and the columns of ``carry``) the earliest only.

    Lines are cut at newlines and ordered by doc_id (nulls last), text hash and place. A line is dropped if
    an equal one stands earlier or, for lines of ``min_chars`` characters or more, one within edit distance 1. Lines without
    words stay. Everything is judged on the input, not on what is left.

    Returns row (a struct of ``carry``), n_lines (lines with words), n_dropped and kept (the text without dropped lines).
    A null text has no lines and an empty kept text; rows that repeat both id and text are one document and
    return the same result; an empty table gives an empty result.
    """
    slim = docs.select(F.struct(*carry).alias("row"), "doc_id", F.xxhash64("text").alias("th"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    found = slim.select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "line")).filter(_has_word(F.col("line"))).withColumn("len", F.length("line"))
    keys = F.when(F.col("len") >= min_chars - 1, _part_keys(2)).otherwise(F.array().cast("array<bigint>"))
    each = saved(found.select("doc_id", "th", "pos", *_hashes("line"), (F.col("len") >= min_chars).alias("long"), keys.alias("keys")), "each")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "pos")
    lines = saved(each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("long").alias("long")), "lines")
    keyed = each.select("h1", F.explode("keys").alias("key"))
    shared = saved(_met(keyed, "key"), "halves")
    near = saved(keyed.join(small(shared, BROADCAST_ROWS), "key").select("h1").distinct(), "near")
    # The text of a line is taken from the document in which it stands first.
    wanted = saved(lines.filter("long").join(small(near, BROADCAST_ROWS), "h1").select("h1", "h2", F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t"), F.col("first.pos").alias("_p")), "wanted")
    there = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(small(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    candidates = saved(there.select("h1", "h2", F.get(F.split("text", "\n"), F.col("_p")).alias("line")).dropDuplicates(["h1", "h2"]).withColumn("len", F.length("line")), "candidates")
    parts = candidates.select("h1", "h2", F.explode_outer(_fine_parts()).alias("p")).select("h1", "h2", "p.key", "p.lo", "p.hi")
    nearer = saved(parts.join(_met(parts, "key"), "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "nearer")
    texts = saved(candidates.join(small(nearer, BROADCAST_ROWS // 4), ["h1", "h2"]).select("h1", "h2", "line", "spans"), "texts")
    variants = texts.select("h1", "h2", F.explode_outer(_variants()).alias("v")).select("h1", "h2", "v.variant", "v.at")
    posted = saved(variants.join(_met(variants, "variant"), "variant"), "variants")
    a, b = (posted.select("variant", F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("at").alias(f"at_{x}")) for x in "ab")
    # One edit: the same place is left out of both, or nothing (place 0) of one.
    pairs = a.join(b, "variant").filter("(a1 < b1 or a1 = b1 and a2 < b2) and (at_a = at_b or at_a = 0 or at_b = 0)")
    pairs = pairs.groupBy("a1", "a2", "b1", "b2").agg(F.min(F.struct("at_a", "at_b")).alias("at"))
    ta, tb = (texts.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"l{x}")) for x in "ab")
    less = lambda x: f"if(at.at_{x} = 0, l{x}, concat(left(l{x}, at.at_{x} - 1), substring(l{x}, at.at_{x} + 1)))"
    verified = pairs.join(ta, ["a1", "a2"]).join(tb, ["b1", "b2"]).filter(f"{less('a')} = {less('b')}").select("a1", "a2", "b1", "b2")
    fa, fb = (lines.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"f{x}")) for x in "ab")
    later = F.when(F.col("fa") < F.col("fb"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).otherwise(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")))
    losers = saved(verified.join(fa, ["a1", "a2"]).join(fb, ["b1", "b2"]).select(later.alias("l")).select("l.*").distinct().withColumn("loses", F.lit(True)), "losers")
    # Lines that occur more than once, or lose: all their occurrences but, at most, the first are dropped.
    hit = saved(lines.join(losers, ["h1", "h2"], "left").filter("n > 1 or loses").select("h1", "h2", F.when(F.col("loses"), F.lit(None)).otherwise(F.col("first")).alias("stays")), "repeated")
    occurrences = each.select("doc_id", "th", "pos", "h1", "h2").join(small(hit, BROADCAST_ROWS), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("stays")))
    dropped = saved(occurrences.select("doc_id", "th", "pos").distinct(), "dropped")
    by_text = dropped.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list("pos").alias("dropped"))
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_text = F.broadcast(by_text)
    joined = slim.join(by_text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return joined.select(
        "row",
        F.size(F.filter("lines", _has_word)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), coalesce(dropped, cast(array() as array<int>))), i -> lines[i]), '\n')").alias("kept"),
    )


def _met(keyed: DataFrame, key: str) -> DataFrame:
    """Those of the keys that different lines have."""
    return keyed.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select(key)


def _part_keys(parts: int) -> Column:
    """For ``line`` as the shorter and as the longer of two: keys of what stands before and after each part of the shorter."""
    lo, hi = f"cast(s * j div {parts} as int)", f"cast(s * (j + 1) div {parts} as int)"
    return F.expr(f"flatten(transform(array(len, len - 1), s -> transform(sequence(0, {parts - 1}), j -> xxhash64(j, s, left(line, {lo}), right(line, s - {hi})))))")


def _fine_parts() -> Column:
    """As ``_part_keys`` with at least 16 parts, and the square root of the length: (key, lo, hi), where the line's own part is its characters from lo + 1 to hi."""
    parts = "greatest(16, cast(sqrt(s) as int))"
    lo, hi = f"cast(cast(s as bigint) * j div {parts} as int)", f"cast(cast(s as bigint) * (j + 1) div {parts} as int)"
    own = f"named_struct('key', xxhash64(j, s, left(line, {lo}), right(line, s - {hi})), 'lo', {lo}, 'hi', {hi} + len - s)"
    return F.expr(f"flatten(transform(array(len, len - 1), s -> transform(sequence(0, {parts} - 1), j -> {own})))")


def _variants() -> Column:
    """(variant, at): hashes of the line, and of the line less the character at each place of its ``spans``."""
    less = "named_struct('variant', xxhash64(concat(left(line, i - 1), substring(line, i + 1))), 'at', i)"
    return F.expr(f"concat(array(named_struct('variant', xxhash64(line), 'at', 0)), array_distinct(flatten(transform(spans, p -> transform(sequence(p.lo + 1, greatest(p.lo + 1, p.hi)), i -> {less})))))")
