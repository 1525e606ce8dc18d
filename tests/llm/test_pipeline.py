"""The pipeline's stages against brute-force versions, each on what its predecessor kept."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import corpus


def test_stages_and_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [prose(r.randint(60, 140)) for _ in range(260)]
    item = " ".join("".join(r.choice("mnopq") for _ in range(4)) for _ in range(30))
    junk = [" ".join(w + "%%%" for w in prose(90).split()) for _ in range(8)] + [None, "", "short text", "same word again " * 40]
    copies = [clean[0], clean[0], clean[1].replace(clean[1].split()[50], "other", 1), clean[2] + " end"]
    leaked = [f"{prose(50)} {item} {prose(40)}", f"{item} {prose(70)}"]
    texts = clean + copies + leaked + junk
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    (_, quality), (_, near), (_, leaks), (_, mix), (_, shards) = pipeline.STAGES
    n_good = len(clean + copies + leaked)

    kept = quality(spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in kept) == list(range(n_good))
    docs = spark.createDataFrame(kept, docs.schema)

    want = {c for _, _, c in corpus.components([tuple(x) for x in kept], 5, 80)}
    kept = near(spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(want)
    docs = spark.createDataFrame(kept, docs.schema)

    kept = leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(x for x in want if item not in texts[x])
    docs = spark.createDataFrame(kept, docs.schema)

    kept = mix(spark, docs, str(tmp_path)).collect()
    size = Counter()
    for x in docs.collect():
        size[x.source] += len(corpus.words(x.text))
    took = Counter()
    for x in kept:
        took[x.source] += len(corpus.words(x.text))
    total = sum(size.values())
    assert abs(took["s0"] - total / 3) < 200 and abs(took["s1"] - total * 2 / 3) < 200
    docs = spark.createDataFrame(kept, docs.schema)

    last = shards(spark, docs, str(tmp_path)).collect()
    assert Counter(tuple(x)[:5] for x in last) == Counter(map(tuple, kept))
    sizes = Counter(x.shard for x in last)
    assert max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1

    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, last))


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, empty and very long texts, further columns with names of the operators' own, and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus.make_rows(corpus.make_texts(count=30))
    names = {"shard": 1, "slot": 2, "h1": 3, "own_id": 4, "own_text": 5, "rank": 6, "th": 7, "_d": 8, "g": 9, "edge": 10, "slice": 11, "text_hash": 12}
    docs = corpus.frame(spark, rows).withColumns({name: F.lit(x) for name, x in names.items()}).cache()
    spark.createDataFrame([(0, rows[4][1]), (1, None), (2, "zzz yyy")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = Counter((r[0], r[1]) for r in rows)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns + (["_shard", "_slot"] if k == 4 else []), name
        kept = Counter((x.doc_id, x.text) for x in got.select("doc_id", "text").collect())
        if k < 3:
            assert kept <= whole and kept, name
        assert set(kept) <= set(whole) and (kept == whole if k == 4 else kept != whole), name
        assert got.select(*docs.columns).subtract(docs).count() == 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == got.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_entry_registers_ten_queries_and_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
