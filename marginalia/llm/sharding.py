"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. Every shard owns ``vnodes`` places on it; a row belongs to
the arc that ends at the next place clockwise. A shard takes rows of its own arcs up to
its capacity; what overflows continues clockwise to the next shards with room. Only the
counts of the arcs (``shards * vnodes`` at most) are folded one after the other, in one
SQL expression; rows are ranked within their arc, so that no task sees more than an arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import saved

#: Bits of a position that name its cell.
CELL_BITS = 16
#: A quarter of the cells, so that a free one is soon drawn.
MOST_SHARDS = 1 << (CELL_BITS - 2)


def ring(spark, shards: int, vnodes: int) -> DataFrame:
    """(cell, arc, home): the arc of each cell and the shard at the arc's end.

    Size: 2**CELL_BITS rows, whatever the input. Of two virtual nodes in one cell the smaller shard's stays, so adding
    shards only adds places. A shard all of whose places were taken draws further ones until every shard has an arc.
    """
    if not 0 < shards <= MOST_SHARDS:
        raise ValueError(f"from 1 to {MOST_SHARDS} shards")
    drawn = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("home"), F.floor(F.col("id") / shards).alias("v"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("home"))
    while True:
        cell = F.shiftrightunsigned(F.xxhash64(F.lit("place"), "home", "v"), 64 - CELL_BITS).cast("int")
        places = drawn.select("home", cell.alias("cell")).groupBy("cell").agg(F.min("home").alias("home"))
        without = every.join(places.select("home").distinct(), "home", "left_anti")
        if without.isEmpty():
            break
        drawn, vnodes = drawn.unionByName(saved(without, "without").select("home", F.lit(vnodes).cast("bigint").alias("v"))), vnodes + 1
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    place = F.when(F.col("home").isNotNull(), F.struct(F.col("cell").alias("arc"), "home"))
    return (
        spark.range(1 << CELL_BITS)
        .select(F.col("id").cast("int").alias("cell"))
        .join(places, "cell", "left")
        .select("cell", place.alias("p"))
        .select("cell", F.coalesce(F.last("p", ignorenulls=True).over(ahead), F.min("p").over(whole)).alias("p"))
        .select("cell", "p.arc", "p.home")
    )


def _arcs(counts: DataFrame, cells: DataFrame, shards: int, slack: float) -> DataFrame:
    """Per arc: how many of its rows its own shard takes, and how many overflow."""
    everywhere = Window.partitionBy(F.lit(0))
    in_shard = Window.partitionBy("home").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    total, room = F.sum("n").over(everywhere), F.col("total")
    if slack:
        capacity = F.ceil(room * (1 + slack) / shards)
    else:
        capacity = F.floor(room / shards) + (F.col("home") < room % shards).cast("long")
    return (
        cells.select("arc", "home")
        .distinct()
        .join(counts, "arc", "left")
        .select("arc", "home", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("total", total)
        .withColumn("capacity", capacity.cast("long"))
        .withColumn("before", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
        .withColumn("own", F.greatest(F.lit(0), F.least(F.col("n"), F.col("capacity") - F.col("before"))).cast("long"))
        .withColumn("over", F.col("n") - F.col("own"))
        .select("arc", "home", "n", "capacity", "own", "over")
    )


def _takes(arcs: DataFrame, shards: int) -> DataFrame:
    """The clockwise sweep over the arcs: (from, shard) cuts the overflow's order into shards.

    One row of ``shards * vnodes`` numbers at most; two laps place everything, as the
    second passes all room that the first left.
    """
    in_shard = Window.partitionBy("home")
    row = (
        arcs.withColumn("spare", F.max("capacity").over(in_shard) - F.sum("own").over(in_shard))
        .agg(F.array_sort(F.collect_list(F.struct("arc", "home", "over"))).alias("arcs"), F.map_from_entries(F.collect_set(F.struct("home", "spare"))).alias("rooms"))
        .select("arcs", F.expr(f"transform(sequence(0, {shards - 1}), s -> coalesce(try_element_at(rooms, s), 0L))").alias("spare"))
    )
    state = "named_struct('carry', 0L, 'spare', spare, 'takes', cast(array() as array<struct<shard:int,n:bigint>>))"
    step = """(s, a) -> named_struct(
        'carry', s.carry + a.over - least(s.carry + a.over, s.spare[a.home]),
        'spare', transform(s.spare, (v, i) -> if(i = a.home, v - least(s.carry + a.over, v), v)),
        'takes', if(least(s.carry + a.over, s.spare[a.home]) > 0,
                    concat(s.takes, array(named_struct('shard', a.home, 'n', least(s.carry + a.over, s.spare[a.home])))),
                    s.takes))"""
    laps = "concat(arcs, transform(arcs, a -> named_struct('arc', a.arc, 'home', a.home, 'over', 0L)))"
    cumulative = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        row.select(F.expr(f"aggregate({laps}, {state}, {step}).takes").alias("takes"))
        .select(F.posexplode("takes").alias("pos", "t"))
        .select("pos", "t.shard", "t.n")
        .select(F.coalesce(F.sum("n").over(cumulative), F.lit(0)).alias("from"), "shard")
    )


def _segments(arcs: DataFrame, shards: int) -> DataFrame:
    """Per arc: its ranks cut into (lo, hi, shard, slot of lo), as one array."""
    running = Window.partitionBy(F.lit(0)).orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    over = arcs.filter("over > 0").select("arc", "own", F.coalesce(F.sum("over").over(running), F.lit(0)).alias("from"), F.sum("over").over(everywhere).alias("end"))
    along = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(F.lit(0)).orderBy("at")
    cuts = (
        over.select(F.col("from").alias("at"), F.struct("arc", "own", "from", "end").alias("a"), F.lit(None).cast("int").alias("shard"))
        .unionByName(_takes(arcs, shards).select(F.col("from").alias("at"), F.lit(None).cast("struct<arc:int,own:bigint,from:bigint,end:bigint>").alias("a"), "shard"))
        .groupBy("at")
        .agg(F.max("a").alias("a"), F.max("shard").alias("shard"))
        .select("at", F.last("a", ignorenulls=True).over(along).alias("a"), F.last("shard", ignorenulls=True).over(along).alias("shard"), F.lead("at").over(after).alias("next"))
    )
    lo = F.col("a.own") + F.col("at") - F.col("a.from")
    moved = cuts.select(F.col("a.arc").alias("arc"), lo.alias("lo"), (lo + F.coalesce("next", "a.end") - F.col("at")).alias("hi"), "shard")
    kept = arcs.filter("own > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("own").alias("hi"), F.col("home").alias("shard"))
    in_shard = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    return (
        kept.unionByName(moved)
        .withColumn("slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(in_shard), F.lit(0)))
        .groupBy("arc")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard", "slot"))).alias("segments"))
    )


def ring_shards(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text and the columns of ``carry``) into a shard.

    ``slack``: a shard's capacity is ``(1 + slack)`` times the mean, rounded up; with 0
    the capacities are the mean rounded up or down, so that counts differ by one at most.

    Returns row (a struct of ``carry``), size (UTF-8 bytes of the text plus 16), text_crc32, home (the shard
    without bounds), shard and slot (0, 1, ... within the shard).

    A null text counts as no bytes; null and repeated ids and repeated rows are rows as
    any other (the place on the ring is the hash of id and text digest); an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keys = (
        docs.select(F.struct(*carry).alias("row"), "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
        .withColumn("at", F.xxhash64("doc_id", "text_crc32"))
        .withColumn("cell", F.shiftrightunsigned("at", 64 - CELL_BITS).cast("int"))
    )
    cells = saved(ring(spark, shards, vnodes), "cells")
    placed = keys.join(F.broadcast(cells), "cell")  # 65,536 rows
    arcs = saved(_arcs(placed.groupBy("arc").agg(F.count("*").alias("n")), cells, shards, slack), "arcs")
    in_arc = Window.partitionBy("arc").orderBy("at", "doc_id", "size")
    segment = F.expr("filter(segments, s -> rank >= s.lo and rank < s.hi)[0]")
    return (
        placed.withColumn("rank", (F.row_number().over(in_arc) - 1).cast("long"))
        .join(F.broadcast(_segments(arcs, shards)), "arc")  # shards * vnodes rows at most
        .withColumn("s", segment)
        .select("row", "size", "text_crc32", "home", "s.shard", (F.col("s.slot") + F.col("rank") - F.col("s.lo")).alias("slot"))
    )
