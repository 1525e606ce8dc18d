"""MinHash near-duplicates: minima of many universal hashes in bands, verified by signatures and then on the whole sets.

A set's signature holds its least member under each of ``bands * rows`` functions ``a * x + b`` over 32 bits. Two sets of
similarity s agree in a minimum with probability s, so they share the key of one band at least with probability
``1 - (1 - s ** rows) ** bands``: with 42 bands of 5, all but 6 of 100 million pairs of similarity 0.8, and more of the nearer ones.
Pairs that share a key are compared by one bit of each minimum: half of the minima that differ differ in it. Those whose
bits leave a similarity as asked for possible, within seven standard deviations, and whose sets don't differ in too many parities,
are confirmed on their full sets. Links are joined to components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import grams
from marginalia.llm.common import saved, ship
from marginalia.llm.near import PARITY, Measure, classes, named, parity_bound

BANDS, ROWS = 42, 5
#: 64-bit words of the signature's bits.
BIT_WORDS = 4
BIT_COLUMNS = [f"s{i}" for i in range(BIT_WORDS)]
SKETCH = [*BIT_COLUMNS, *PARITY]
#: How many standard deviations the bits of a pair may be off.
DEVIATIONS = 7
#: Members that are hashed at once: the products stay in the processor's cache.
BLOCK = 256
_EVEN, _BAND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the hash functions."""
    draw = np.random.default_rng(97).integers(0, 2**32, (2, count), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def signature(members: np.ndarray, count: int) -> np.ndarray:
    """The minima of a set of 64-bit hashes under ``count`` functions of their upper halves."""
    a, b = functions(count)
    x = (members >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(count, 2**32 - 1, np.uint32)
    products = np.empty((BLOCK, count), np.uint32)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        out = products[: len(part)]
        np.multiply(part, a, out=out)
        out += b
        np.minimum(least, out.min(axis=0), out=least)
    return least


def band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of ``minima``."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * _BAND
    for column in minima.reshape(bands, -1).T:
        h = grams.mix(h * _EVEN + column)
    return h


def bits(minima: np.ndarray) -> np.ndarray:
    """One bit of each of up to 256 minima, as 64-bit words."""
    found = np.zeros(64 * BIT_WORDS, np.uint8)
    found[: len(minima)] = (minima * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(found).view(np.int64)


def _signed(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, words, offsets in grams.texts(text, lower=True):
                nodes, sizes, keys, marks = [], [], [], []
                for i in range(hi - lo):
                    members = grams.shingle_set(words[offsets[i] : offsets[i + 1]], n)
                    minima = signature(members, bands * rows)
                    nodes.append(grams.set_id(members))
                    sizes.append(len(members))
                    keys.append(band_keys(minima, bands) if len(members) else members)
                    marks.append(np.concatenate((bits(minima), grams.parity_sketch(members))))
                flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(pa.array(w) for w in np.stack(marks, axis=1))],
                    names=["row", "text_hash", "node", "n", "keys", *SKETCH],
                )

    return run


def measure(n: int, percent: int, count: int) -> Measure:
    """How pairs are judged: by their bits, of which those of linked sets differ in ``count * (1 - s) / 2`` on average."""
    differ = count * (1 - percent / 100) / 2
    most = int(differ + DEVIATIONS * sqrt(differ * (1 - differ / count)) + 1)
    distance = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in BIT_COLUMNS)
    return Measure(n, percent, SKETCH, f"{parity_bound(percent)} and {distance} <= {most}", distance)


def minhash_duplicates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate classes of all rows of ``docs`` (doc_id, text and the columns of ``carry``).

    Words are runs other than ASCII white space, with A-Z lowered; a text's set holds its distinct ``n``-word shingles (the whole
    sequence of a shorter text). Returns row (a struct of ``carry``), n_shingles, component_id: the smallest doc_id of the rows linked
    directly or through others, and kept: whether the row has that id.

    Texts without words and null texts have an empty set, link with nothing and are their own component; rows with equal sets
    are linked; null ids join components but name one only if all of its ids are null; rows that repeat an id are kept
    together; an empty table gives an empty result; other columns are ignored.
    """
    if bands * rows > 64 * BIT_WORDS:
        raise ValueError(f"a signature has {64 * BIT_WORDS} minima at most")
    ship(docs.sparkSession)
    with_id = tuple(dict.fromkeys((*carry, "doc_id")))
    slim = docs.select(F.struct(*with_id).alias("row"), F.xxhash64("text").alias("text_hash"), "text")
    kind = slim.schema["row"].dataType.simpleString()
    signed = f"row {kind}, text_hash bigint, node bigint, n bigint, keys array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCH)
    keyed = saved(slim.mapInArrow(_signed(n, bands, rows), signed), "signatures")
    about = ["node", "n", *SKETCH]
    nodes = saved(keyed.filter("n > 0").groupBy(*about).agg(F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash")), "nodes")
    found = named(keyed, classes(docs, nodes, measure(n, percent, bands * rows)), with_id)
    row, component = F.struct(*(F.col("row")[c].alias(c) for c in carry)).alias("row"), F.col("first.doc_id")
    return found.select(row, F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("row.doc_id")).alias("kept"))
