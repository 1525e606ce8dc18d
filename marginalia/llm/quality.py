"""Quality rules: base counts of a text, then robust multivariate outliers.

Per language and source, minimum-covariance-determinant estimates (C-steps from two
deterministic starts) give a centre and a scatter of the transformed statistics;
documents beyond a cutoff of the squared Mahalanobis distance are rejected. A C-step is
one aggregation of all documents into (group, start, distance bin) sums: its shuffle is
bounded by groups times bins, and a hot group is summed where its rows lie.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, fresh, saved, small, words

SYMBOLS = "#*$%&|<>"
#: Texts of up to 2**PLACE_BITS words keep a window's place and hash in one long.
PLACE_BITS = 12
DIMS = range(4)
PAIRS = list(combinations_with_replacement(DIMS, 2))
#: Added to each statistic's own standard deviation, so that a statistic which hardly
#: varies in a group doesn't reject every other value.
RIDGE = (0.10, 0.50, 0.50, 0.50)
#: Statistics are rounded to 1/1024: their sums are then whole numbers, the same in any order. Sums of squares fit a long
#: up to some 10**10 documents of a group.
GRAIN = 1024
#: The share of a group that the estimates rest on, and the chi-square quantile (4 degrees
#: of freedom) at that share.
HALF, CHI2_HALF = 0.75, 5.385
#: The share of normally distributed documents that the default cutoff rejects, and the chi-square quantile
#: (4 degrees of freedom) that leaves this share above it: exp(-x / 2) * (1 + x / 2) = FALSE_REJECTIONS.
FALSE_REJECTIONS, CUTOFF = 0.001, 18.467
#: Squared distances in bins of equal ratio.
BINS_PER_E, MAX_BIN = 32, 1023
#: Estimates of up to so many groups (200 bytes each) are broadcast.
BROADCAST_GROUPS = 100_000


def text_stats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row: struct of ``carry``, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.trim(F.translate(x, BLANKS[1:], " " * 5)) != "")
    # Places of repeated windows, in order. A long holds a place and 52 bits of a window's hash; texts too long for that
    # sort structs of the place and the whole hash, which takes several times as long.
    window = "xxhash64(_w[i], _w[i + 1], _w[i + 2])"
    packed = f"sort_array(transform(sequence(0, size(_w) - 3), i -> shiftleft({window}, {PLACE_BITS}) | i))"
    whole = f"sort_array(transform(sequence(0, size(_w) - 3), i -> struct({window} as h, i as i)))"
    met = "sort_array(transform(filter({s}, (x, i) -> {h} <=> {before} or {h} <=> {after}), x -> {place}))"
    of_packed = met.format(s="_s", h=f"shiftright(x, {PLACE_BITS})", before=f"shiftright(get(_s, i - 1), {PLACE_BITS})", after=f"shiftright(get(_s, i + 1), {PLACE_BITS})", place=f"x & {(1 << PLACE_BITS) - 1}L")
    of_whole = met.format(s="_l", h="x.h", before="get(_l, i - 1).h", after="get(_l, i + 1).h", place="cast(x.i as bigint)")
    return (
        docs.select(F.struct(*carry).alias("row"), "lang", "source", F.coalesce("text", F.lit("")).alias("_text"))
        .select(
            "row",
            "lang",
            "source",
            words(F.col("_text")).alias("_w"),
            F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("_lines"),
        )
        .select(
            "row",
            "lang",
            "source",
            "word_chars",
            "n_symbols",
            F.size("_w").cast("long").alias("n_words"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.expr(f"case when size(_w) between 3 and {1 << PLACE_BITS} then {packed} end").alias("_s"),
            F.expr(f"case when size(_w) > {1 << PLACE_BITS} then {whole} end").alias("_l"),
        )
        .select("row", "lang", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines", F.expr(f"case when _s is not null then {of_packed} when _l is not null then {of_whole} else cast(array() as array<bigint>) end").alias("_p"))
        .withColumn(
            "n_repeat_words",
            F.expr("aggregate(_p, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)"),
        )
        .drop("_p")
    )


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log1p(100.0 * F.col("n_dup_lines") / n),
        F.log1p(100.0 * F.col("n_repeat_words") / n),
    )
    return [F.round(x * GRAIN).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _factors(moments: DataFrame) -> DataFrame:
    """Centre m0.., lower Cholesky factor l00.. and log determinant from n, s0.. and q00.."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in DIMS})
    out = out.withColumns({f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (RIDGE[i] * GRAIN) ** 2 * (i == j) for i, j in PAIRS})
    return _cholesky(out)


def _cholesky(out: DataFrame) -> DataFrame:
    for j in DIMS:
        used = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - used, F.lit((0.1 * RIDGE[j] * GRAIN) ** 2))))
        for i in range(j + 1, len(DIMS)):
            used = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - used) / F.col(f"l{j}{j}"))
    low = [f"l{i}{j}" for j, i in PAIRS]
    return out.select("g", "start", *(f"m{i}" for i in DIMS), *low, sum((F.log(f"l{i}{i}") for i in DIMS), F.lit(0.0)).alias("log_det"))


def _with_distance(rows: DataFrame) -> DataFrame:
    for i in DIMS:
        used = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - used) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in DIMS), F.lit(0.0)))


def _starts(points: DataFrame) -> DataFrame:
    """Start 0: mean and covariance of all; start 1: medians and interquartile ranges."""
    moments = points.groupBy("g").agg(
        F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in DIMS), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS)
    )
    classical = _factors(moments.withColumn("start", F.lit(0)))
    cell = GRAIN // 64
    bins = (
        points.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") / cell).alias("bin")) for i in DIMS))).alias("b"))
        .groupBy("g", "b.dim", "b.bin")
        .agg(F.count("*").alias("n"))
    )
    along = Window.partitionBy("g", "dim").orderBy("bin")
    share = F.sum("n").over(along) / F.sum("n").over(Window.partitionBy("g", "dim"))
    quartiles = (
        bins.withColumn("share", share)
        .groupBy("g", "dim")
        .agg(*(F.min(F.when(F.col("share") >= q, (F.col("bin") + 0.5) * cell)).alias(name) for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
        .groupBy("g")
        .pivot("dim", list(DIMS))
        .agg(F.first("q2").alias("mid"), F.first((F.col("q3") - F.col("q1")) / 1.349).alias("sd"))
    )
    robust = quartiles.select(
        "g",
        F.lit(1).alias("start"),
        *(F.col(f"{i}_mid").alias(f"m{i}") for i in DIMS),
        *((F.col(f"{i}_sd") ** 2 + (RIDGE[i] * GRAIN) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS),
    )
    return classical.unionByName(_cholesky(robust))


def _c_step(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """Moments of the HALF of each group that lies nearest by the estimates, and that half's distance."""
    bins = (
        _with_distance(points.join(small(estimates, BROADCAST_GROUPS), "g"))
        .withColumn("bin", F.least(F.floor(F.log1p("d2") * BINS_PER_E), F.lit(MAX_BIN)))
        .groupBy("g", "start", "bin")
        .agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in DIMS), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS))
    )
    group = Window.partitionBy("g", "start")
    before = F.sum("n").over(group.orderBy("bin")) - F.col("n")
    near = bins.withColumn("near", before < HALF * F.sum("n").over(group)).filter("near")
    return near.groupBy("g", "start").agg(F.max("bin").alias("bin"), *(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in DIMS), *(f"q{i}{j}" for i, j in PAIRS)]))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), min_words: int = 50, max_repeat_pct: int = 50, cutoff: float = CUTOFF, min_group: int = 40, steps: int = 4) -> DataFrame:
    """Judge every row of ``docs`` (text, lang, source and the columns of ``carry``).

    Returns row (a struct of ``carry``), the five counts, base_failed, distance (the squared
    Mahalanobis distance; null if base_failed or too few documents are left to estimate from) and kept.

    ``cutoff`` is in units of the chi-square distribution with four degrees of freedom; the
    default rejects one of a thousand documents where the statistics are normal, and more where their
    tails are heavier. The documents of a language's groups of fewer than ``min_group`` (ten for each dimension) are
    judged together; where even those are fewer, together with those of other such languages; if there are fewer
    than 8 documents near their centre, the rule rejects none of them.
    A null text has no words (so it fails the base rule); null languages and sources are groups
    of their own; an empty table gives an empty result; repeated rows are judged alike.
    """
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    base = (n < min_words) | (100 * repeat > max_repeat_pct * n)
    stats = saved(
        text_stats(docs, list(carry)).select("row", F.to_json(F.struct("lang", "source")).alias("own"), F.to_json(F.struct("lang")).alias("language"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), *_transformed()),
        "stats",
    )
    fine = stats.filter(~F.col("base_failed"))
    # Of each language, its groups are counted; no more rows than there are pairs of language and source.
    groups = fine.groupBy("own", "language").agg(F.count("*").alias("n"))
    own = groups.withColumn("pool", F.when(F.col("n") < min_group, F.col("language")))
    pools = own.filter("pool is not null").groupBy("pool").agg(F.sum("n").alias("pooled"))
    group = F.when(F.col("pool").isNull(), F.col("own")).when(F.col("pooled") >= min_group, F.concat(F.lit("language "), F.col("pool"))).otherwise("*")
    sizes = saved(own.join(pools, "pool", "left").select("own", group.alias("g")), "groups")
    points = fine.join(small(sizes, BROADCAST_GROUPS), "own").select("g", *(f"x{i}" for i in DIMS))
    estimates = saved(_starts(points), "start")
    for k in range(steps):
        moments = _c_step(points, estimates)
        estimates = saved(_factors(moments), f"step{k}")
    reach = _c_step(points, estimates).select("g", "start", "n", ((F.exp((F.col("bin") + 1) / BINS_PER_E) - 1) / CHI2_HALF).alias("scale"))
    best = F.row_number().over(Window.partitionBy("g").orderBy("log_det", "start"))
    final = saved(estimates.join(reach, ["g", "start"]).filter("n >= 8").withColumn("best", best).filter("best = 1").drop("best", "n"), "final")
    judged = stats.join(small(sizes, BROADCAST_GROUPS), "own", "left").join(small(final, BROADCAST_GROUPS), "g", "left")
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.greatest(F.col("scale"), F.lit(1.0)))
    return (
        _with_distance(judged)
        .withColumn("distance", distance)
        .select(
            "row",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            "distance",
            (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        )
    )


def reject_outliers(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (text, lang, source and any others) that ``quality_rules`` keeps, with all their columns.

    A verdict depends on text, language and source alone, so that rows equal in these share it. Nulls, empty and very long
    texts, repeated rows and empty tables as in ``quality_rules``; columns may have any names.
    """
    h1, h2 = fresh(docs, "h1", "h2")
    what = [F.col("text"), F.to_json(F.struct("lang", "source"))]
    a, b = F.xxhash64(*what), F.xxhash64(F.lit("verdict"), *what)
    judged = quality_rules(docs.select("text", "lang", "source", a.alias("h1"), b.alias("h2")), ("h1", "h2"), **options)
    rejected = saved(judged.filter("not kept").select(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2)).distinct(), "rejected")
    return docs.join(small(rejected, BROADCAST_GROUPS), (a == F.col(h1)) & (b == F.col(h2)), "left_anti")
