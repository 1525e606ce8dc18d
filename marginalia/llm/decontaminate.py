"""Benchmark decontamination by SimHash of item-sized windows.

Windows as long as an item may start at every word of a document, as the similarity is of bags and
blind to order. Of all these, a window is looked at if the shingles that it shares with items of its size weigh
enough: what it has in common with an item weighs no more than those, and no less than ``percent`` of the item
if it passes, so no window that could pass is left out. Each window looked at gets a SimHash of its weighted shingles; fingerprints are cut into one block
more than the radius, so that two within the radius agree in a whole block, and are joined by
(size, block, value). Candidates within the radius are verified by their exact weighted Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import fresh, lower_ascii, saved, small, words

BITS = 64
#: A table of up to so many rows of at most 40 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
SCALE = 1000


def _grams(n: int) -> Column:
    """Hashes of all n-word shingles of ``w``; of a shorter text, of its whole sequence."""
    run = ", ".join(f"w[i + {k}]" for k in range(n))
    short = " ".join(f"when {m} then array(xxhash64({', '.join(f'w[{k}]' for k in range(m))}))" for m in range(1, n))
    return F.expr(f"case when size(w) >= {n} then transform(sequence(0, size(w) - {n}), i -> xxhash64({run})) else case size(w) {short} else cast(array() as array<bigint>) end end")


def _runs(m: int) -> Column:
    """Hashes of all runs of m words of ``w``."""
    run = ", ".join(f"w[i + {k}]" for k in range(m))
    return F.expr(f"case when size(w) >= {m} then transform(sequence(0, size(w) - {m}), i -> xxhash64({run})) else cast(array() as array<bigint>) end")


def _bag(df: DataFrame, keys: list[str], weights: DataFrame, unseen: Column) -> DataFrame:
    """(keys, sh, weight) from (keys, grams): counts times shingle weights."""
    each = df.select(*keys, F.explode("grams").alias("sh")).groupBy(*keys, "sh").agg(F.count("*").alias("c"))
    return each.join(small(weights, BROADCAST_ROWS), "sh", "left").select(*keys, "sh", (F.col("c") * F.coalesce("idf", unseen)).alias("weight"))


def _fingerprints(bag: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, fp): weight and SimHash of every bag."""
    sums = [F.sum(F.when(F.shiftright("sh", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(BITS)]
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return bag.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums).select(*keys, "total", fp.alias("fp"))


def _blocks(radius: int) -> Column:
    """(block, value) of all radius + 1 blocks of ``fp``."""
    cut = [i * BITS // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))))


def _windows(seeds: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, th, m, start) of all windows of m words whose shared shingles weigh ``percent`` of the lightest item of m words.

    ``seeds`` (doc_id, th, n, m, pos, idf, least): the shared shingles of texts of n words. A window whose first shared
    shingle is at pos starts after the seed before it, and holds the seeds of the m - n shingles from there on (a window of
    fewer than n words is one shingle).
    """
    own = Window.partitionBy("doc_id", "th", "m")
    more = F.greatest(F.col("m") - n, F.lit(0))
    # Places in units of a window's shingles, so that one range serves all sizes; halves keep the comparison off rounding.
    within = own.orderBy(F.col("pos") * 2 / (2 * more + 1)).rangeBetween(0, 1)
    near = seeds.select("*", F.lag("pos").over(own.orderBy("pos")).alias("prev"), F.sum("idf").over(within).alias("ahead"), F.collect_list(F.struct("pos", "idf")).over(within).alias("shared"))
    near = near.filter(100 * F.col("ahead") >= percent * F.col("least"))
    lo = F.greatest(F.lit(0), F.coalesce(F.col("prev") + 1, F.lit(0)), F.col("pos") - more)
    hi = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("m")))
    starts = near.select("*", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi").select("doc_id", "th", "m", "least", "shared", F.explode(F.sequence("lo", "hi")).alias("start"))
    inside = F.expr(f"aggregate(shared, 0L, (a, x) -> a + if(x.pos <= start + greatest(m - {n}, 0), x.idf, 0L))")
    return starts.filter(100 * inside >= percent * F.col("least")).select("doc_id", "th", "m", "start")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, radius: int = 19) -> DataFrame:
    """(doc_id, th, item_id, n_words, start, hamming, similarity): every item found in a document, by its best window.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Words are runs other than ASCII white
    space, with A-Z lowered; th is the text's hash. A window has as many words as the item (or all of a
    shorter document) and starts at word ``start``. Shingles weigh their count times their inverse item frequency.

    An item of fewer than ``n`` words is one shingle, its whole sequence, and so is found where that stands as it is. Texts
    without words, and null ones, never match; items with equal texts are all reported; rows that repeat id and text
    are reported once; other columns are ignored; either table may be empty.
    """
    items = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("w")).select("item_id", F.size("w").alias("m"), _grams(n).alias("grams")).filter("m > 0")
    items = saved(items.distinct(), "items")
    where = saved(items.select("item_id", "m", F.posexplode("grams").alias("ipos", "sh")), "item-grams")
    n_items = items.count()
    idf = F.round(F.log(1.0 + n_items / F.col("df")) * SCALE).cast("long")
    weights = saved(where.groupBy("sh").agg(F.countDistinct("item_id").alias("df")).select("sh", idf.alias("idf")), "weights")
    unseen = F.round(F.log(F.lit(1.0 + n_items)) * SCALE).cast("long")

    parsed = docs.select("doc_id", F.xxhash64("text").alias("th"), words(lower_ascii(F.col("text"))).alias("w"))
    grams = parsed.select("doc_id", "th", F.size("w").alias("n"), _grams(n).alias("grams"))
    held = where.join(weights, "sh").groupBy("sh", "m").agg(F.first("idf").alias("idf"))
    least = where.join(weights, "sh").groupBy("item_id", "m").agg(F.sum("idf").alias("total")).groupBy("m").agg(F.min("total").alias("least"))
    held = saved(held.join(least, "m"), "held")
    # explode_outer: for the inner form Spark adds a filter on the array's size, and so computes it twice, word by word
    places = grams.select("doc_id", "th", "n", F.posexplode_outer("grams").alias("pos", "sh"))
    for m in sorted(r["m"] for r in items.filter(F.col("m") < n).select("m").distinct().collect()):  # n - 1 sizes at most
        places = places.unionByName(parsed.select("doc_id", "th", F.size("w").alias("n"), F.posexplode_outer(_runs(m)).alias("pos", "sh")))
    seeds = places.join(small(held, BROADCAST_ROWS), "sh")
    windows = saved(_windows(seeds.select("doc_id", "th", "n", "m", "pos", "idf", "least").distinct(), n, percent), "windows")

    by_text = windows.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(F.struct("m", "start")).alias("windows"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    if windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_text = F.broadcast(by_text)
    opened = (
        docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
        .join(by_text, same)
        .select("doc_id", "th", words(lower_ascii(F.col("text"))).alias("w"), "windows")
        .select("doc_id", "th", "w", F.explode("windows").alias("x"))
        .select("doc_id", "th", "x.m", "x.start", F.expr("slice(w, x.start + 1, x.m)").alias("w"))
        .select("doc_id", "th", "m", "start", _grams(n).alias("grams"))
        .dropDuplicates(["doc_id", "th", "m", "start"])
    )
    key = ["doc_id", "th", "m", "start"]
    bags = saved(_bag(opened, key, weights, unseen), "window-bags")
    item_bags = saved(_bag(items, ["item_id", "m"], weights, unseen), "item-bags")
    prints = saved(_fingerprints(bags, key), "window-prints")
    item_prints = saved(_fingerprints(item_bags, ["item_id", "m"]), "item-prints")

    left = prints.select(*key, "total", "fp", F.explode(_blocks(radius)).alias("b")).select(*key, "total", "fp", "b.*")
    right = item_prints.select("item_id", "m", F.col("total").alias("item_total"), F.col("fp").alias("item_fp"), F.explode(_blocks(radius)).alias("b")).select("item_id", "m", "item_total", "item_fp", "b.*")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = (
        left.join(small(right, BROADCAST_ROWS), ["m", "block", "value"])
        .withColumn("hamming", hamming.cast("int"))
        .filter(F.col("hamming") <= radius)
        .select(*key, "total", "item_id", "item_total", "hamming")
        .distinct()
    )
    shared = F.sum(F.least("weight", "item_weight"))
    item_side = item_bags.select("item_id", "sh", F.col("weight").alias("item_weight"))
    window_side = bags.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("m").alias("_m"), F.col("start").alias("_s"), "sh", "weight")
    this = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("m") == F.col("_m")) & (F.col("start") == F.col("_s"))
    scored = (
        near.join(window_side, this)
        .drop("_d", "_t", "_m", "_s")
        .join(small(item_side, BROADCAST_ROWS), ["item_id", "sh"])
        .groupBy(*key, "total", "item_id", "item_total", "hamming")
        .agg(shared.alias("both"))
        .filter(100 * F.col("both") >= percent * (F.col("total") + F.col("item_total") - F.col("both")))
        .withColumn("similarity", F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")))
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "hamming")).alias("best")
    return scored.groupBy("doc_id", "th", "item_id", F.col("m").alias("n_words")).agg(best).select("doc_id", "th", "item_id", "n_words", (-F.col("best.back")).cast("int").alias("start"), "best.hamming", "best.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, radius: int = 19) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) in which no item of ``benchmark`` is found, with all their columns.

    Nulls, empty, short and very long texts, repeated rows and empty tables as in ``leaks``; columns may have any names.
    """
    own_id, own_text = fresh(docs, "own_id", "own_text")
    found = saved(leaks(docs, benchmark, n, percent, radius).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_text)).distinct(), "leaks")
    return docs.join(small(found, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_text)), "left_anti")
