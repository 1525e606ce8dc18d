"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight; within its source
the smallest keys come first, and sizes are summed along them up to the token budget.
A source whose target exceeds its size is repeated whole first (complete epochs), and
only the rest of the target is selected by keys. The keys of every source are cut
into slices by their logarithm; slices wholly below or above the budget need no order, so that no task ever
sorts a source, however large its share of the rows. As exponential keys of any scale spread over
a few octaves, a slice holds some 1/10,000 of its source's rows, whatever the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import n_words, saved, small

#: Slices of each octave of keys.
SLICES = 4096
#: Plans of up to so many sources (100 bytes each) are broadcast.
BROADCAST_SOURCES = 100_000
SYMBOLS = "#*$%&|<>"


def quality_weight() -> Column:
    """Default quality weight of a text, in (0, 1]: falls with its share of symbol characters."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, 1.0 / (1.0 + 20.0 * symbols / n)).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share the sum of all
    sizes; a target stops at ``max_epochs`` times its source and the excess is reshared by weight.
    Filling up in the order of source_size / weight gives the level at which that ends.
    """
    everywhere = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everywhere.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    fill = everywhere.orderBy("full_at", "weight", F.col("source").isNull(), "source")
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("rest", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everywhere))
        .select(
            "source",
            "source_size",
            F.when(F.col("rest").isNull() | (F.col("full_at") < F.col("rest.full_at")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest.level")).alias("target"),
        )
    )


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), weight: Column | None = None, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """How often the mix takes every row of ``docs`` (doc_id, text, source and the columns of ``carry``).

    Returns row (a struct of ``carry``), size, source, source_size, target, copies and taken
    (``size * copies``). Whole documents are taken; of the last one of a source's fractional
    part, the choice is what comes nearer to the target.

    A null text has size 0 and is taken with its epoch; null sources are one source; rows with equal ids
    draw equal keys and are ordered by size (rows repeated in full are exchangeable); rows without an id draw by their
    text; an empty table gives an empty result. Keys depend on these and ``seed`` only, so that reruns agree.
    """
    unit = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    draws = saved(
        docs.select(
            F.struct(*carry).alias("row"),
            F.col("doc_id").alias("_id"),
            "source",
            n_words(F.col("text")).alias("size"),
            (-F.log(unit) / (quality_weight() if weight is None else weight)).alias("key"),
        ).withColumn("slice", F.floor(F.log2("key") * SLICES)),
        "draws",
    )
    slices = saved(draws.groupBy("source", "slice").agg(F.sum("size").alias("n")), "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    ended = F.col("before") + F.col("n") > F.col("budget")
    plan = saved(
        slices.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long"))
        .withColumn("budget", budget)
        .groupBy("_s", "source_size", "target", "epochs", "budget")
        .agg(F.min(F.when(ended, F.struct("slice", "before"))).alias("edge")),
        "plan",
    )
    planned = (
        draws.join(small(plan, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("extra", F.when(F.col("budget") <= 0, 0).when(F.col("edge").isNull() | (F.col("slice") < F.col("edge.slice")), 1).when(F.col("slice") > F.col("edge.slice"), 0))
        .withColumn("before", F.col("edge.before"))
        .drop("_s", "edge")
    )
    # Only the slice in which a source's budget ends needs an order.
    inner = Window.partitionBy("source", "slice").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    last = planned.filter("extra is null").withColumn("extra", (reach + F.col("size") / 2 <= F.col("budget")).cast("int"))
    mixed = planned.filter("extra is not null").unionByName(last)
    return mixed.withColumn("copies", F.col("epochs") + F.col("extra")).select("row", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
