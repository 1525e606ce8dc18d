"""Classes of sets that are linked, directly or through others, from the keys that they share.

Sets that share a key are candidates. Each list of a key is first scanned for two pivots only, and every set is compared with
the nearest pivot it met that is not of its own component. This is repeated with other pivots; then the pairs of each list
that stand in different components are compared. So a group of n near copies costs about n comparisons, and no link
between components is lost. A condition on small sketches goes before every comparison, which is made on the whole sets: both
texts are brought to the pair, and their sets are built and intersected there. The texts of sets that met a key are
read once, one for each set, and stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import grams
from marginalia.llm.common import Scratch, saved, small
from marginalia.llm.graph import star_components

#: A table of up to so many rows of at most 24 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000
#: A table of up to so many sets with their sketches (100 bytes each) is broadcast.
BROADCAST_NODES = 100_000
#: How often lists are scanned with two pivots, while that finds links, before the rest is compared.
ROUNDS = 2
#: Columns of the parity sketch.
PARITY = [f"p{i}" for i in range(grams.PARITY_WORDS)]
#: Pairs whose sets are built together.
PAIRS = 128


def parity_bound(percent: int) -> str:
    """SQL on n_a, n_b and parity sketches that all pairs of linked sets fulfil: few enough members of one set only."""
    most = f"(n_a + n_b - 2 * (({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}))"
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {' + '.join(f'bit_count({p}_a ^ {p}_b)' for p in PARITY)} <= {most}"


@dataclass
class Measure:
    """When two sets link: at ``percent`` of Jaccard similarity of sets of ``n``-word shingles.

    ``sketch``: columns of a node's sketch. ``may_link``: SQL over n_a, n_b and the sketch columns with _a and _b that linked pairs fulfil.
    ``distance``: SQL over the sketch columns, smaller for nearer sets.
    """

    n: int
    percent: int
    sketch: list[str]
    may_link: str
    distance: str


def _linked(n: int, percent: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), PAIRS):
                part = batch.slice(lo, PAIRS)
                a, b = (np.asarray(part.column(c)) for c in ("a", "b"))
                nodes, first = np.unique(np.concatenate((a, b)), return_index=True)
                column = pa.concat_arrays([part.column("text_a"), part.column("text_b")]).take(pa.array(first))
                sets: list[np.ndarray] = []
                for at, to, words, offsets in grams.texts(column, lower=True):
                    sets += [grams.shingle_set(words[offsets[i] : offsets[i + 1]], n) for i in range(to - at)]
                keep = []
                for x, y in zip(np.searchsorted(nodes, a), np.searchsorted(nodes, b), strict=True):
                    s, t = sets[x], sets[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link, by the ``texts`` (node, text)."""
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return left.join(small(pairs, BROADCAST_ROWS), "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked(measure.n, measure.percent), "a bigint, b bigint")


def met_keys(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node) of ``nodes`` (node, keys) for the keys that two nodes have."""
    posted = nodes.select(F.explode("keys").alias("key"), "node")
    shared = scratch.saved(posted.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key"), "shared")
    return scratch.saved(posted.join(small(shared, BROADCAST_ROWS), "key").distinct(), "met")


def _sketches(nodes: DataFrame, measure: Measure, x: str) -> DataFrame:
    return small(nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *measure.sketch))), BROADCAST_NODES)


def _with_pivots(labelled: DataFrame, nodes: DataFrame, measure: Measure, k: int, scratch: Scratch) -> DataFrame:
    """(a, b): of every set in ``labelled`` (key, node, root) the nearest pivot of its lists, if that is of another component and may link.

    The pivots of a list are the two ends of an order that differs with ``k``.
    """
    at = F.struct(F.xxhash64("node", F.lit(k)).alias("at"), "node", "root")
    ends = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(at).alias("first"), F.max(at).alias("last"))
    pivots = scratch.saved(ends.filter("lo <> hi").select("key", F.array("first", "last").alias("pivots")), "pivots")
    met = labelled.join(small(pivots, BROADCAST_ROWS // 4), "key").select(F.col("node").alias("a"), "root", F.explode("pivots").alias("p")).filter("root <> p.root").select("a", F.col("p.node").alias("b")).distinct()
    near = met.join(_sketches(nodes, measure, "a"), "a").join(_sketches(nodes, measure, "b"), "b").filter(measure.may_link).select("a", "b", F.expr(measure.distance).alias("d"))
    best = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def classes(docs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """(node, root) of the sets that link with others.

    ``nodes``: one row for each distinct set that isn't empty, with node, n (its size), keys, text_hash (xxhash64 of the text of a row of ``docs`` that has
    it) and its sketch. Linked sets must share a key (or as nearly all as the keys promise). Everything but the result is deleted.
    """
    with Scratch(docs.sparkSession, "classes") as scratch:
        met = met_keys(nodes, scratch)
        wanted = scratch.saved(met.select("node").distinct(), "wanted")
        about = scratch.saved(nodes.select("node", "n", *measure.sketch, "text_hash").join(small(wanted, BROADCAST_ROWS), "node"), "about")
        hashes = about.select("text_hash", "node")
        texts = scratch.saved(docs.select(F.xxhash64("text").alias("text_hash"), "text").join(small(hashes, BROADCAST_ROWS), "text_hash").dropDuplicates(["node"]).select("node", "text"), "texts")

        labelled, tried, links = met.withColumn("root", F.col("node")), None, None
        for k in range(ROUNDS):
            pairs = scratch.saved(_with_pivots(labelled, about, measure, k, scratch), "tried")
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = scratch.saved(verified(pairs, texts, measure), "links")
            links = found if links is None else links.unionByName(found)
            if found.isEmpty():
                break
            roots = star_components(links, "roots")
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")
            labelled = scratch.saved(met.join(small(roots, BROADCAST_ROWS), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "labelled")

        counts = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
        main = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("key", F.col("m.root").alias("main"))
        left = labelled.join(small(scratch.saved(main, "main"), BROADCAST_ROWS), "key").join(small(about.drop("text_hash"), BROADCAST_NODES), "node")
        # A node has as many keys as it emits. Two sets meet in the first of the keys that they share, so a pair is made once.
        lists = scratch.saved(met.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys")), "lists")
        left = scratch.saved(left.join(small(lists, BROADCAST_NODES // 4), "node"), "open")
        columns = ("node", "root", "n", "keys", *measure.sketch)
        a, b = (left.select("key", "main", *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
        # Of each list, the sets outside its most frequent component are compared with all others.
        rest = (
            a.filter("root_a <> main")
            .join(b.drop("main"), "key")
            .filter(f"(root_b = main or node_a < node_b) and root_a <> root_b and {measure.may_link} and key = array_min(array_intersect(keys_a, keys_b))")
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
            .distinct()
        )
        rest = scratch.saved(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        return star_components(links.unionByName(verified(rest, texts, measure)))


def named(keyed: DataFrame, parts: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(row, text_hash, n, first) of ``keyed`` (row with doc_id, text_hash, node, n): ``first`` is the (last, doc_id, text_hash) of its class's smallest row.

    ``parts``: (node, root) of sets in a class with others. A set with no members is in no class, not even with its like.
    """
    own = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("doc_id"), "text_hash")
    least = keyed.filter("n > 0").groupBy("node").agg(F.min(own).alias("first"), F.count("*").alias("c"))
    rooted = saved(least.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("f"), F.sum("c").alias("rows"))
    classes_ = saved(rooted.join(firsts.filter("rows > 1"), "root").select("node", F.col("f").alias("first")), "named")
    row = F.struct(*(F.col("row")[c].alias(c) for c in carry)).alias("row")
    return keyed.select("row", "text_hash", "n", "node").join(classes_, "node", "left").select(row, "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("first", own)).otherwise(own).alias("first"))
