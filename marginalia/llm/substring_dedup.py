"""Substring dedup by seed and extend over word sequences.

Seeds are winnowed anchors: of every window of ``length`` words the k-gram with the
least hash (the rightmost of equals), so equal windows have equal anchors at equal places
and a text keeps about 2 / (length - k + 2) of its k-grams. An anchor's span is extended both ways
over all windows that chose it. Anchors that occur once are done. Where all spans of an
anchor are equal, they repeat as a whole; elsewhere the span's windows are compared one
by one, by hash. Repeats that overlap or touch are joined to maximal ones. Everything is
counted by key before it is joined, so a passage that many documents share costs one row
for each of its occurrences, never a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import grams
from marginalia.llm.common import saved, ship, small

#: Words in an anchor.
ANCHOR = 8
#: Low bits of a k-gram's rank that hold its place (texts of up to 2**PLACE_BITS words).
PLACE_BITS = 28
#: A table of up to so many rows of at most 32 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    done, n = v, 1
    while 2 * n <= w:
        done, n = np.minimum(done[:-n], done[n:]), 2 * n
    return done if n == w else np.minimum(done[: len(v) - w + 1], done[w - n : w - n + len(v) - w + 1])


def anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, span hash, first window, windows) of a text's anchors."""
    k = min(ANCHOR, length)
    n = len(words) - length + 1
    if n <= 0:
        none = np.empty(0, np.uint64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    g = grams.ngrams(words, k)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(g), dtype=np.uint64)
    least = _sliding_min((g & ~mask) | (mask - place), length - k + 1)
    at = (mask - (least & mask)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=n)
    at = at[first]
    spans = grams.span_hashes(grams.prefix_sums(words), first, first + count + length - 1)
    return g[at], grams.mix(spans + (at - first).astype(np.uint64)), first.astype(np.int32), count.astype(np.int32)


def _list(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(kind, copy=False)))


def _signed(values: list[np.ndarray]) -> list[np.ndarray]:
    return [v.view(np.int64) for v in values]


def _seeds(length: int):
    def run(batches):
        for batch in batches:
            for lo, hi, words, offsets in grams.texts(batch.column("text")):
                a, s, f, c = zip(*(anchors(words[offsets[i] : offsets[i + 1]], length) for i in range(hi - lo)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), _list(_signed(a), np.int64), _list(_signed(s), np.int64), _list(f, np.int32), _list(c, np.int32)],
                    names=["id", "th", "anchor", "span", "first", "count"],
                )

    return run


def _windows(length: int):
    """Window starts and hashes of the spans in ``mixed``."""

    def run(batches):
        for batch in batches:
            spans = batch.column("mixed")
            for lo, hi, words, offsets in grams.texts(batch.column("text")):
                starts, hashes = [], []
                for i in range(hi - lo):
                    sums = grams.prefix_sums(words[offsets[i] : offsets[i + 1]])
                    own = np.unique(np.concatenate([np.arange(x["first"], x["first"] + x["count"]) for x in spans[lo + i].as_py()]))
                    starts.append(own)
                    hashes.append(grams.span_hashes(sums, own, own + length).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), _list(starts, np.int32), _list(hashes, np.int64)], names=["id", "th", "first", "hash"]
                )

    return run


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(length: int):
    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n, removed, spans, kept = [], [], [], []
                for text, runs in zip(part.column("text"), part.column("runs"), strict=True):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    own = _merged([(x["first"], x["first"] + x["count"] + length - 1) for x in runs.as_py() or []])
                    at, left = 0, []
                    for a, b in own:
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    n.append(len(words))
                    removed.append(len(words) - len(left))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(lo, 256),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["row", "n_words", "n_removed", "repeats", "kept"],
                )

    return run


def substring_dedup(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), length: int = 35) -> DataFrame:
    """Remove from every text (doc_id, text and the columns of ``carry``) all words of repeated windows of ``length`` words.

    Words are the runs other than ASCII white space. A window is removed if its word sequence starts
    anywhere else too, the same document included. Returns row (a struct of ``carry``), n_words, n_removed, repeats (the
    maximal repeated runs, as word offsets) and kept (the other words, joined by one space).

    Null texts have no words; texts of fewer than ``length`` words keep all; rows repeated in full repeat each
    other as any two documents do; null ids are no exception; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    keys = (F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    texts = docs.select(*keys, "text")
    seeds = saved(texts.mapInArrow(_seeds(length), "id bigint, th bigint, anchor array<bigint>, span array<bigint>, first array<int>, count array<int>"), "seeds")
    each = seeds.select("id", "th", F.explode(F.arrays_zip("anchor", "span", "first", "count")).alias("s")).select("id", "th", "s.*")
    groups = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter("n > 1")
    shared = saved(groups.select("anchor", (F.col("lo") == F.col("hi")).alias("whole")), "anchors")
    found = saved(each.join(small(shared, BROADCAST_ROWS), "anchor").select("id", "th", "first", "count", "whole"), "found")
    mixed = found.filter("not whole").groupBy("id", "th").agg(F.collect_set(F.struct("first", "count")).alias("mixed"))
    windows = saved(
        texts.join(small(mixed.select("id", "th"), BROADCAST_ROWS), ["id", "th"], "left_semi")
        .join(mixed, ["id", "th"])
        .select("id", "th", "text", "mixed")
        .mapInArrow(_windows(length), "id bigint, th bigint, first array<int>, hash array<bigint>"),
        "windows",
    )
    each_window = windows.select("id", "th", F.explode(F.arrays_zip("first", "hash")).alias("w")).select("id", "th", "w.*")
    repeated = saved(each_window.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated")
    runs = each_window.join(small(repeated, BROADCAST_ROWS), "hash").select("id", "th", "first", F.lit(1).alias("count")).unionByName(found.filter("whole").select("id", "th", "first", "count"))
    by_text = runs.groupBy("id", "th").agg(F.collect_set(F.struct("first", "count")).alias("runs"))
    slim = docs.select(F.struct(*carry).alias("row"), *keys, "text")
    joined = slim.join(by_text, ["id", "th"], "left").select("row", "text", "runs")
    kind = slim.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_cut(length), f"row {kind}, n_words bigint, n_removed bigint, repeats array<struct<start:int,end:int>>, kept string")
