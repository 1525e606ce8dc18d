"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens). Contents are joined to it
by digest; only distinct misses are encoded, and their counts are appended. Of every
missing digest one text is taken where its rows lie, and again after the shuffle, so a group of copies never
meets in one task.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import saved, ship

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_version(content: bytes, name: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    return hashlib.sha256(content + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _plain_byte_bpe(spec: dict) -> bool:
    """True for byte-level BPE without normaliser, prefix space or options that rank merging lacks."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    return (
        model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and spec.get("normalizer") is None
    )


def _ids_follow_merges(model: dict) -> bool:
    """True if merging by the smallest id is merging in the order of the merges: ids rise along them, and every longer token is made by one."""
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    return all(a < b for a, b in zip([-1, *made], made, strict=False)) and sum(len(token) > 1 for token in vocab) == len(made)


#: Runs of so many blanks go to the library: the faster one gives up on them.
LONG_RUN = 100_000
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")
#: The split of byte-level BPE before its merges (fixed by the vocabulary).
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def counter(content: bytes, name: str):
    """A function from a list of texts to their token counts, without special tokens around them."""
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(content.decode())
    whole.no_truncation()
    whole.no_padding()
    spec = json.loads(content)

    def exact(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in whole.encode_batch(texts, add_special_tokens=False)]

    if not _plain_byte_bpe(spec):
        return exact
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if not _ids_follow_merges(spec["model"] | {"vocab": {t: i for t, i in spec["model"]["vocab"].items() if t not in special}}):
        return exact
    import tiktoken  # the same merges by rank, several times as fast

    of = _byte_of_character()
    ranks = {bytes(of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("ranks", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        """Texts that hold an added token's string or a long run of blanks go to the library itself."""
        out = [-1 if any(s in t for s in special) or len(t) >= LONG_RUN and _BLANKS.search(t) else len(fast.encode_ordinary(t)) for t in texts]
        rest = [i for i, n in enumerate(out) if n < 0]
        for i, n in zip(rest, exact([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = n
        return out

    return count


def _encode(shared, name: str):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(shared.value, name)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n = count([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, cache: str, tokenizer: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token counts of every text of ``docs`` (doc_id, text and the columns of ``carry``).

    ``tokenizer``: path of a .json or .model file, read by the driver; ``cache``: path of the cache in a
    shared store, created or appended to. Returns row (a struct of ``carry``), n_bytes and n_tokens.

    Contents are compared as they are, a null text as an empty one: a normalisation that
    changed a text would change its count. Repeated rows and null ids are counted as any other; an
    empty table gives an empty result and stores nothing new.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        content = f.read()
    version = tokenizer_version(content, tokenizer)
    content_of = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(content_of, 256)).alias("digest")
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    misses = docs.select(digest, content_of.alias("text")).join(stored.select("digest"), "digest", "left_anti")
    texts = misses.groupBy("digest").agg(F.first("text").alias("text"))
    counted = texts.select("digest", "text").mapInArrow(_encode(spark.sparkContext.broadcast(content), tokenizer), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Written out, so that the join below stands alone and Spark can split the digest of a large group of copies.
    known = saved(read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    return docs.select(F.struct(*carry).alias("row"), digest, F.octet_length(content_of).cast("long").alias("n_bytes")).join(known, "digest").select("row", "n_bytes", "n_tokens")
