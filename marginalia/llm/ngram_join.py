"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two sets link when their Jaccard similarity reaches ``percent``. Small sets enumerate
the hashes of all their subsets of the sizes that a link needs; two of them share such a
subset exactly when they link. Large sets go to inverted lists, one for each shingle, which are
scanned. Sets that link have so much in common that one of the rarest shingles of each is among them:
with all shingles in one order, the first ``n - ceil(percent * n / 100) + 1`` of a set suffice. The order
puts shingles of few documents first, so that a passage of many documents makes no long list unless
nearly the whole text consists of such passages. The boundary between small and large is the last
size at which enumeration costs less than the lists.

Every set posts a key once, with its size and the number of members from that key on in the order. The first key that two linked sets share
leaves both as many members as the link needs in common, so pairs of other sizes or with fewer members left are not brought
together in that list, and lists of two sets that are such a pair are dropped when keys are counted.

Sets that share a key are candidates. Each list of more than SHORT sets is first scanned for two pivots only, and every set is compared
with the nearest pivot it met that is not of its own component; components of those links are contracted, and this is
repeated with other pivots. Then the pairs
of each list, short ones too, that stand in different components are verified, so that a group of n near copies costs about
n comparisons and no link between components is lost. Before two sets are brought together, the
parities of their members in 512 cells are compared, and for large sets in twice as many cells as they have members: these
differ in at most as many cells as the sets
have members of one only, so pairs beyond the allowed difference are out for certain.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import grams
from marginalia.llm.common import Scratch, fresh, saved, ship, small
from marginalia.llm.graph import star_components
from marginalia.llm.near import named

#: A table of up to so many rows of at most 24 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000
#: A table of up to so many sets with their sketches (100 bytes each) is broadcast.
BROADCAST_NODES = 100_000
#: 64-bit words of the parity sketch.
SKETCH = 8
SKETCH_COLUMNS = [f"p{i}" for i in range(SKETCH)]
#: Sets of more members have a second, wide sketch.
NARROW = 512
#: How often lists are scanned with two pivots before the rest is compared.
ROUNDS = 3
#: Lists of up to so many sets have no pivots: all of their pairs are made.
SHORT = 4
#: Of so many keys before each, sets that meet in a list are looked up for one that both have; a pair with such a key was made in its list.
EARLIER = 4
#: What scanning a list costs for each set in it, in keys of a small set.
SCAN = 4
#: The order of shingles tells apart documents' counts under 16, under 64, under 256, ... by a table of 2**CELL_BITS cells.
CELL_BITS = 24
STEPS = [16 * 4**i for i in range(8)]
#: Documents are counted for the shingles in the lowest part of the hash range, COUNTED times as large as the part of a set that
#: is looked up. Others come after those of fewer than 1,024 documents; only texts made of frequent passages get to them.
COUNTED, UNCOUNTED_STEP = 2.5, 3
#: A table of key bits has MARKS bits for each key that sets share, 2**MOST_MARKS at most (16 MB): it tells most other keys apart before keys are joined.
MARKS, MOST_MARKS = 16, 27
#: Bits of a shingle's hash that are counted; shingles that agree in them share a place in the order.
COUNT_BITS = 40


class Plan:
    """Which keys a set of a given size emits."""

    def __init__(self, percent: int) -> None:
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent
        self.boundary = 0
        while self.boundary < 64 and self._light(self.boundary + 1) <= self.first(self.boundary + 1) * (1 + SCAN):
            self.boundary += 1

    def overlap(self, s: int, t: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def largest(self, s: int) -> int:
        return 100 * s // self.percent

    def first(self, s: int) -> int:
        """How many of a set's rarest shingles meet one of any set that it links with."""
        return s - -(-self.percent * s // 100) + 1

    def removals(self, s: int, most: int) -> list[int]:
        """How many shingles the subsets leave out, over all partner sizes up to ``most``."""
        least = -(-self.percent * s // 100)
        sizes = {self.overlap(s, t) for t in range(max(1, least), min(most, self.largest(s)) + 1)}
        return sorted({s - c for c in sizes if c <= s})

    def _light(self, s: int) -> int:
        return sum(comb(s, j) for j in self.removals(s, 2 * s))

    def keys(self, members: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """The keys of a sorted set of 64-bit shingle hashes, its rarest shingles first and in order; ``levels`` is the table of ``frequency_levels``."""
        s, found, subsets = len(members), [], []
        if self.largest(s) > self.boundary:
            level = levels[members >> np.uint64(64 - CELL_BITS)]
            found.append(members[np.argsort(level, kind="stable")[: self.first(s)]])
        if s <= self.boundary:
            mixed = grams.mix(members)
            total = mixed.sum(dtype=np.uint64)
            for j in self.removals(s, self.boundary):
                left = np.array([total]) - _sums(mixed, j)
                subsets.append(grams.mix(left * np.uint64(3) + np.uint64(s - j)))
            found.append(np.unique(np.concatenate(subsets)))
        return np.concatenate(found)

    def left(self) -> str:
        """SQL on n and ``at``, a key's place in ``keys``: the members from that key on in the order, all of them for subsets."""
        listed = f"n - ({self.percent} * n + 99) div 100 + 1"
        return f"if(100 * n div {self.percent} > {self.boundary} and at < {listed}, n - at, n)"


def _sums(values: np.ndarray, j: int) -> np.ndarray:
    """Sums of all choices of j values."""
    if j == 0:
        return np.zeros(1, np.uint64)
    if j == 1:
        return values
    return np.concatenate([values[i] + _sums(values[i + 1 :], j - 1) for i in range(len(values) - j + 1)])


def _sketch(members: np.ndarray) -> np.ndarray:
    """The parities of the counts of members in SKETCH * 64 cells, as bits."""
    cell = (grams.mix(members) >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


def _wide_sketch(members: np.ndarray) -> np.ndarray:
    """The same in at least twice as many cells as there are members; none for small sets. Its halves, xored, are the sketch in half the cells."""
    if len(members) <= NARROW:
        return np.empty(0, np.uint64)
    cells = 1 << int(2 * len(members) - 1).bit_length()
    cell = (grams.mix(members) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=cells).astype(np.uint8) & 1).view(np.uint64)


def _node(members: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(grams.mix(grams.mix(members).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _rows(batch: pa.RecordBatch, n: int, of):
    """Calls ``of`` with the sorted shingle set of every text; yields pieces of the batch with what it returned."""
    for lo, hi, words, offsets in grams.texts(batch.column(batch.schema.get_field_index("text")), lower=True):
        yield lo, hi, [of(grams.shingle_set(words[offsets[i] : offsets[i + 1]], n)) for i in range(hi - lo)]


def _counted(n: int, cells: int):
    end = np.uint64(cells << (64 - CELL_BITS))

    def run(batches):
        for batch in batches:
            for _, _, sets in _rows(batch, n, lambda m: m[: np.searchsorted(m, end)] >> np.uint64(64 - COUNT_BITS)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    return run


def frequency_levels(docs: DataFrame, n: int, percent: int) -> np.ndarray:
    """The place in the order of each cell of shingle hashes: twice the number of STEPS that its most frequent shingle reaches.

    All documents are counted. A table of 2**CELL_BITS bytes, whatever the input. It decides the cost, not the result.
    """
    cells = int((1 << CELL_BITS) * COUNTED * (100 - percent) / 100) + 64
    cell = F.shiftright("shingle", COUNT_BITS - CELL_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(shingle, {COUNT_BITS - CELL_BITS}) & 63 as int))")
    frequent = docs.select("text").mapInArrow(_counted(n, cells), "shingle bigint").groupBy("shingle").agg(F.count("*").alias("c")).filter(F.col("c") >= STEPS[0])
    steps = [F.bit_or(F.when(F.col("c") >= step, bit)).alias(f"s{i}") for i, step in enumerate(STEPS)]
    found = frequent.groupBy(F.shiftright(cell, 6).alias("word")).agg(*steps).toArrow()  # 2**(CELL_BITS - 6) rows at most
    levels = np.zeros((1 << (CELL_BITS - 6), 64), np.uint8)
    at = found.column("word").to_numpy()
    for i in range(len(STEPS)):
        bits = found.column(f"s{i}").fill_null(0).to_numpy()
        levels[at] += (bits[:, None] >> np.arange(64) & 1).astype(np.uint8) * np.uint8(2)
    levels = levels.reshape(-1)
    levels[cells:] = 2 * UNCOUNTED_STEP + 1
    return levels


def _keys_of(percent: int, n: int, shared):
    def run(batches):
        plan, levels = Plan(percent), shared.value
        for batch in batches:
            for lo, hi, made in _rows(batch, n, lambda m: (_node(m), len(m), plan.keys(m, levels) if len(m) else m, _sketch(m), _wide_sketch(m))):
                nodes, sizes, keys, sketches, wide = zip(*made, strict=True)
                parity = np.stack(sketches, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(list(keys)), *(pa.array(p) for p in parity), _lists(list(wide))],
                    names=["row", "text_hash", "node", "n", "keys", *SKETCH_COLUMNS, "wide"],
                )

    return run


def _sets_of(n: int):
    def run(batches):
        for batch in batches:
            for _, _, made in _rows(batch, n, lambda m: (_node(m), m)):
                nodes, sets = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(list(sets))], names=["node", "members"])

    return run


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link. Only texts of sets in ``pairs`` are read again, one for each set."""
    large = nodes.filter(F.col("n") > NARROW)
    wide_a, wide_b = (large.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}")) for x in "ab")
    pairs = scratch.saved(pairs.join(wide_a, "a", "left").join(wide_b, "b", "left").filter(_may_link_by_wide(percent)).select("a", "b"), "near")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    hashes = scratch.saved(nodes.select("node", "text_hash").join(small(ids, BROADCAST_ROWS), "node").select("text_hash").distinct(), "texts")
    chosen = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(small(hashes, BROADCAST_ROWS), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = scratch.saved(chosen.select("text").mapInArrow(_sets_of(n), "node bigint, members array<bigint>"), "members")
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("ma") + F.size("mb") - both)).select("a", "b")


def ngram_sets(docs: DataFrame, carry: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """(row, text_hash, node, n, keys, p0..) of every row: its shingle set's identity, size, join keys and parity sketch."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n, percent))
    row = F.struct(*carry)
    slim = docs.select(row.alias("row"), F.xxhash64("text").alias("text_hash"), "text")
    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(_keys_of(percent, n, levels), f"row {kind}, text_hash bigint, node bigint, n bigint, keys array<bigint>, " + ", ".join(f"{p} bigint" for p in SKETCH_COLUMNS) + ", wide array<bigint>")


_DISTANCE = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in SKETCH_COLUMNS)


def _may_link(percent: int) -> str:
    """SQL condition on n_a, n_b and both sketches that every pair of linked sets fulfils."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {_DISTANCE} <= {_differ(percent)}"


def _overlap(percent: int, both: str) -> str:
    """SQL for the least intersection of linked sets that have ``both`` members together."""
    return f"(({percent} * ({both}) + {99 + percent}) div {100 + percent})"


def _may_meet(percent: int) -> str:
    """SQL condition on n_a, n_b, left_a and left_b that linked sets fulfil in the first key that they share."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and least(left_a, left_b) >= {_overlap(percent, 'n_a + n_b')}"


def _differ(percent: int) -> str:
    """SQL for the most members that linked sets of n_a and n_b members have in one of them only."""
    return f"(n_a + n_b - 2 * {_overlap(percent, 'n_a + n_b')})"


def _may_link_by_wide(percent: int) -> str:
    """SQL condition on wide sketches, where both sets have one, that every pair of linked sets fulfils; sizes differ by less than half."""
    folded = lambda x, y: f"if(size(w_{x}) > size(w_{y}), transform(sequence(0, size(w_{y}) - 1), i -> w_{x}[i] ^ w_{x}[i + size(w_{y})]), w_{x})"
    distance = f"aggregate(zip_with({folded('a', 'b')}, {folded('b', 'a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"w_a is null or w_b is null or {distance} <= {_differ(percent)}"


def _side(nodes: DataFrame, x: str) -> DataFrame:
    return small(nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *SKETCH_COLUMNS))), BROADCAST_NODES)


def _marks(keys: DataFrame) -> np.ndarray:
    """A table of bits by the last bits of a key, set for each of ``keys`` (key) and by chance for few others. It decides the cost, not the result."""
    size = min(MOST_MARKS, max(10, int(MARKS * keys.count()).bit_length()))
    at = F.col("key").bitwiseAND((1 << size) - 1)
    bit = F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")
    found = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(bit).toArrow()  # 2**(MOST_MARKS - 6) rows at most
    marks = np.zeros(1 << (size - 6), np.uint64)
    marks[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return marks


def _posted(shared):
    """A row for each key of a set that is marked, with its place among the set's keys."""

    def run(batches):
        marks = shared.value
        last = np.uint64(64 * len(marks) - 1)
        for batch in batches:
            lists = batch.column("keys")
            keys, counts = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.value_lengths()).astype(np.int64)
            cell = keys & last
            chosen = np.flatnonzero(marks[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1))
            of = np.repeat(np.arange(len(counts)), counts)[chosen]
            at = chosen - (np.cumsum(counts) - counts)[of]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), batch.column("node").take(rows), batch.column("n").take(rows), pa.array(at)], names=["key", "node", "n", "at"])

    return run


def met_keys(keyed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, node, n, left, c) of the sets in ``keyed`` for keys that several sets have; ``left``: the set's members from that key on; ``c``: how many sets.

    Lists of two sets that don't link if this is the first key that they share are left out.
    """
    distinct = scratch.saved(keyed.filter("n > 0").select("node", "n", "keys").dropDuplicates(["node"]), "distinct")
    left = F.expr(Plan(percent).left()).alias("left")
    counts = distinct.select("n", F.posexplode("keys").alias("at", "key")).select("key", "n", left)
    counts = counts.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("both"), F.min("n").alias("least"), F.min("left").alias("left"))
    pair = f"100 * least >= {percent} * (both - least) and left >= {_overlap(percent, 'both')}"
    shared = scratch.saved(counts.filter(f"c > 2 or c = 2 and {pair}").select("key", "c"), "shared")
    marks = distinct.sparkSession.sparkContext.broadcast(_marks(shared.select("key")))
    posted = distinct.select("node", "n", "keys").mapInArrow(_posted(marks), "key bigint, node bigint, n bigint, at bigint").select("key", "node", "n", left)
    return scratch.saved(posted.join(small(shared, BROADCAST_ROWS), "key"), "met")


def links(docs: DataFrame, keyed: DataFrame, n: int, percent: int, scratch: Scratch, every: bool = False) -> DataFrame:
    """(node, root) of the sets in ``keyed`` that link with others, equal roots in a component.

    With ``every`` instead all pairs (a, b) of different sets that link, once each with a < b.
    """
    met = met_keys(keyed, percent, scratch)
    about = ["node", "n", *SKETCH_COLUMNS]
    wanted = scratch.saved(met.select("node").distinct(), "wanted")
    nodes = scratch.saved(keyed.select(*about, "wide", "text_hash").join(small(wanted, BROADCAST_ROWS), "node").groupBy(*about).agg(F.first("wide").alias("wide"), F.min("text_hash").alias("text_hash")), "nodes")
    sketches = nodes.select("node", *SKETCH_COLUMNS)
    may_link = f"{_may_meet(percent)} and {_may_link(percent)}"
    met_here = "not arrays_overlap(earlier_a, earlier_b)"
    if every:
        sized = scratch.saved(with_earlier_keys(met).join(small(sketches, BROADCAST_NODES), "node"), "open")
        a, b = (sized.select("key", *(F.col(c).alias(f"{c}_{x}") for c in (*about, "left", "earlier"))) for x in "ab")
        pairs = a.join(b, "key").filter(f"node_a < node_b and {met_here} and {may_link}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        return saved(_verify(scratch.saved(pairs, "pairs"), docs, nodes, n, percent, scratch), "links")

    lists, close = met.filter(f"c > {SHORT}").drop("c"), scratch.saved(_pairs_of_short_lists(met, nodes, percent), "close")
    labelled, tried, edges, roots = lists.withColumn("root", F.col("node")), None, None, None
    for k in range(ROUNDS):
        pairs = scratch.saved(_pairs_with_pivots(labelled, nodes, percent, k, scratch), "tried")
        tried = pairs if tried is None else tried.unionByName(pairs)
        linked = scratch.saved(_verify(pairs, docs, nodes, n, percent, scratch), "links")
        edges = linked if edges is None else edges.unionByName(linked)
        if linked.isEmpty():
            break
        roots = star_components(edges, "roots")
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")
        labelled = scratch.saved(lists.join(small(roots, BROADCAST_ROWS), "node", "left").select(*lists.columns, F.coalesce("root", "node").alias("root")), "labelled")

    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = scratch.saved(sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("key", F.col("m.root").alias("main")), "main")
    left = with_earlier_keys(labelled.join(small(main, BROADCAST_ROWS), "key"))
    left = scratch.saved(left.join(small(sketches, BROADCAST_NODES), "node"), "open")
    a, b = (left.select("key", "main", *(F.col(c).alias(f"{c}_{x}") for c in (*about, "left", "root", "earlier"))) for x in "ab")
    # Of each list, the sets outside its most frequent component are compared with all others.
    rest = (
        a.filter("root_a <> main")
        .join(b.drop("main"), "key")
        .filter(f"(root_b = main or node_a < node_b) and root_a <> root_b and {met_here} and {may_link}")
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    )
    if roots is not None:
        of_a, of_b = (small(roots, BROADCAST_ROWS).select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        close = close.join(of_a, "a", "left").join(of_b, "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    apart = scratch.saved(rest.unionByName(close).distinct(), "apart")  # else Spark looks up what was tried before pairs are distinct
    rest = scratch.saved(apart.join(tried, ["a", "b"], "left_anti"), "rest")
    return star_components(edges.unionByName(scratch.saved(_verify(rest, docs, nodes, n, percent, scratch), "more-links")))


def with_earlier_keys(met: DataFrame) -> DataFrame:
    """``met`` (key, node, left and others) with ``earlier``: up to EARLIER keys that come before the row's among those of its set, by members left, then key.

    Two sets that meet in a list and have one of these keys in common meet in that key's list too, with as many members left or more. So they need
    no pair here: the one made, or left out for a still earlier key, is there, and the first key of all that both have always makes it.
    """
    before = Window.partitionBy("node").orderBy(F.desc("left"), "key").rowsBetween(-EARLIER, -1)
    return met.withColumn("earlier", F.collect_list("key").over(before))


def _pairs_of_short_lists(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pairs of lists of up to SHORT sets that may link."""
    short = met.filter(f"c <= {SHORT}")
    a, b = (short.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "left"))) for x in "ab")
    pairs = a.join(b, "key").filter(f"node_a < node_b and {_may_meet(percent)}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").filter(_may_link(percent)).select("a", "b")


def _pairs_with_pivots(labelled: DataFrame, nodes: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """(a, b): of every set in ``labelled`` (key, node, n, left, root) the nearest pivot of its lists, if that is of another component and may link.

    The pivots of a list are the two ends of an order that differs with ``k``.
    """
    at = F.struct(F.xxhash64("node", F.lit(k)).alias("at"), "node", "n", "left", "root")
    pivots = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(at).alias("first"), F.max(at).alias("last")).filter("lo <> hi")
    pivots = scratch.saved(pivots.select("key", F.array("first", "last").alias("pivots")), "pivots")
    pivot = [F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "n", "left", "root")]
    posts = labelled.join(small(pivots, BROADCAST_ROWS // 4), "key").select(*(F.col(c).alias(f"{c}_a") for c in ("node", "n", "left", "root")), F.explode("pivots").alias("p"))
    met = posts.select("*", *pivot).filter(f"root_a <> root_b and {_may_meet(percent)}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    near = met.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").filter(_may_link(percent)).select("a", "b", F.expr(_DISTANCE).alias("d"))
    best = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), n: int = 5, percent: int = 80) -> DataFrame:
    """(row, text_hash, n, first) of every row: ``first`` is the (last, doc_id, text_hash) of its class's smallest row.

    Everything but the result is deleted.
    """
    ship(docs.sparkSession)
    with_id = tuple(dict.fromkeys((*carry, "doc_id")))
    with Scratch(docs.sparkSession, "ngram-join") as scratch:
        keyed = scratch.saved(ngram_sets(docs, with_id, n, percent), "sets")
        return saved(named(keyed, links(docs, keyed, n, percent, scratch), carry), "judged")


def ngram_join(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), n: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of all rows of ``docs`` (doc_id, text and the columns of ``carry``).

    Words are runs other than ASCII white space, with A-Z lowered; a text's set holds its
    distinct ``n``-word shingles (the whole sequence of a shorter text). Returns row (a struct
    of ``carry``), n_shingles and component_id: the smallest doc_id of the rows linked directly or
    through others.

    Texts without words and null texts have an empty set, link with nothing and are their own component;
    rows with equal sets are linked; null ids join components but never name one unless all of its ids are null; an
    empty table gives an empty result.
    """
    return near_duplicates(docs, carry, n, percent).select("row", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def ngram_links(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), n: int = 5, percent: int = 80) -> DataFrame:
    """(row, n_shingles, n_links): with how many other rows each row of ``docs`` links directly, by the rules of ``ngram_join``.

    Every pair of different sets that link is verified; rows of equal sets are counted by the size of their class, not paired.
    """
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession, "ngram-links") as scratch:
        keyed = scratch.saved(ngram_sets(docs, carry, n, percent), "sets")
        edges = links(docs, keyed, n, percent, scratch, every=True)
        sizes = scratch.saved(keyed.filter("n > 0").groupBy("node").agg(F.count("*").alias("c")), "sizes")
        ends = edges.select(F.col("a").alias("own"), F.col("b").alias("node")).unionByName(edges.select(F.col("b").alias("own"), F.col("a").alias("node")))
        others = ends.join(sizes, "node").groupBy(F.col("own").alias("node")).agg(F.sum("c").alias("others"))
        counts = scratch.saved(sizes.join(others, "node", "left").select("node", (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "counts")
        linked = F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links")
        return saved(keyed.select("row", "n", "node").join(counts, "node", "left").select("row", F.col("n").alias("n_shingles"), linked), "linked")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest doc_id, then text hash.

    Texts without words (null ones too) all stay; null ids come last; of rows that repeat id and text, the first in the
    order of their other columns stays; columns may have any names; an empty table gives an empty result.
    """
    judged = near_duplicates(docs, ("doc_id",), n, percent).select("row.doc_id", "text_hash", "n", "first")
    chosen = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    own_id, own_text, rank = fresh(docs, "own_id", "own_text", "rank")
    key = [F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_text)]
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_text))
    dropped = saved(judged.filter(~chosen).select(*key).distinct(), "dropped")
    repeated = saved(judged.filter(chosen & (F.col("n") > 0)).groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").select(own_id, own_text), "repeated")
    left = docs.join(small(dropped, BROADCAST_ROWS), same, "left_anti")
    if repeated.isEmpty():
        return left
    again = left.join(small(repeated, BROADCAST_ROWS), same, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    firsts = again.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*others))).filter(F.col(rank) == 1).drop(rank)
    return left.join(small(repeated, BROADCAST_ROWS), same, "left_anti").unionByName(firsts)
