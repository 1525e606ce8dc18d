"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

FTRL-proximal, with per-coordinate rates and L1 sparsity, learns from a bounded sample of
the labelled texts, in one task and in the order of their hashes. What is left after L1 is a
compact vector of at most 2**BITS weights, which is broadcast to score all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import grams
from marginalia.llm.common import saved, ship

#: Feature slots: 2**BITS.
BITS = 20
#: Bound of the labelled rows that a model is fitted on; rows are chosen by the hash of their id.
MAX_ROWS = 24_000
#: Bound of their distinct slots together (4 bytes each), as rows are taken in that order.
MAX_SLOTS = 48_000_000
#: FTRL-proximal: rate and smoothing of each coordinate, L1 and L2 strength, passes.
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 4.0, 0.0, 5
_SALT = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
BIAS = 0


def features(words: np.ndarray) -> list[np.ndarray]:
    """Slots of all unigrams, bigrams and one-word skip-grams of a run of word hashes."""
    k, shift = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - BITS)
    return [grams.mix(h + _SALT[i]) >> shift for i, h in enumerate((words, words[:-1] * k + words[1:], words[:-2] * k + words[2:]))]


def _slots(batches):
    """Distinct slots of every labelled text."""
    for batch in batches:
        for lo, hi, words, offsets in grams.texts(batch.column("text"), lower=True):
            own = [np.unique(np.concatenate([*features(words[offsets[i] : offsets[i + 1]]), np.zeros(1, np.uint64)])).astype(np.int32) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(own, pa.list_(pa.int32()))], names=["key", "label", "slots"])


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (slots, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        zi = z[i]
        strength = np.where(i == BIAS, 0.0, L1)
        return np.where(np.abs(zi) <= strength, 0.0, -(zi - np.sign(zi) * strength) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, label in examples:
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(1 << BITS))


def _fit(table: pa.Table) -> pa.Table:
    rows = table.select(["key", "label", "slots"]).sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    slots, labels = rows.column("slots").chunk(0), rows.column("label").to_numpy()
    flat, cut = slots.values.to_numpy(), slots.offsets.to_numpy()
    w = ftrl([(flat[cut[i] : cut[i + 1]], int(labels[i])) for i in range(len(labels))])
    kept = np.flatnonzero(w)
    return pa.table({"slot": pa.array(kept, pa.int32()), "weight": pa.array(w[kept], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS) -> np.ndarray:
    """Weights learnt from a bounded sample of ``labels`` (doc_id and ``label``, 0 or 1) and their texts in ``docs`` (doc_id, text).

    The sample takes labelled ids in the order of their hashes: at most ``max_rows`` of them, and texts as long as their
    slots are ``max_slots`` together at most.

    Labels other than 0 and 1, null ids and ids without a document are left out; an id labelled twice has the larger label; rows
    that repeat an id are an example each, within the bound on slots; null and empty texts have the bias alone; without
    examples all weights are 0. Other columns are ignored.
    """
    ship(docs.sparkSession)
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = saved(chosen.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(max_rows), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("key", "label", "text")
    examples = saved(rows.mapInArrow(_slots, "key bigint, label int, slots array<int>"), "examples")
    # max_rows sums, one for each id
    sizes = examples.groupBy("key").agg(F.sum(F.size("slots")).alias("n"))
    within = sizes.select("key", F.sum("n").over(Window.orderBy("key")).alias("until")).filter(F.col("until") <= max_slots).select("key")
    bounded = examples.join(F.broadcast(within), "key")
    fitted = bounded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "slot int, weight double").toArrow()  # 2**BITS rows at most
    w = np.zeros(1 << BITS, np.float32)
    w[fitted.column("slot").to_numpy()] = fitted.column("weight").to_numpy()
    return w


def _score(shared):
    def run(batches):
        w = shared.value
        for batch in batches:
            for lo, hi, words, offsets in grams.texts(batch.column("text"), lower=True):
                total = np.full(hi - lo, float(w[BIAS]))
                for i, slots in enumerate(features(words)):
                    at = np.flatnonzero(w[slots])
                    owner = np.searchsorted(offsets, at, "right") - 1
                    inside = at + i < offsets[owner + 1]  # the last word of the gram is still in the text
                    pairs = np.unique(owner[inside].astype(np.int64) << BITS | slots[at[inside]].astype(np.int64))
                    pairs = pairs[(pairs & ((1 << BITS) - 1)) != BIAS]
                    np.add.at(total, pairs >> BITS, w[pairs & ((1 << BITS) - 1)].astype(float))
                score = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def toxicity(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row: a struct of ``carry``, score) of every row of ``docs`` (text): the probability of label 1.

    A text without words, or null, gets the score of the bias alone; repeated rows score alike; language,
    source and ids are no inputs; an empty table gives an empty result, and weights fitted on no rows give 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.struct(*carry).alias("row"), "text")
    return slim.mapInArrow(_score(spark.sparkContext.broadcast(weights)), f"row {slim.schema['row'].dataType.simpleString()}, score double")
