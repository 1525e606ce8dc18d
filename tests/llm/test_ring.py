"""A ring on which places collide."""

from __future__ import annotations

import pytest

from marginalia.llm.sharding import MOST_SHARDS, ring, ring_shards


def test_every_shard_has_an_arc_and_its_share(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    counts = [r["count"] for r in ring_shards(docs, shards=1500, vnodes=1).groupBy("shard").count().collect()]
    assert len(counts) == 1500 and max(counts) - min(counts) <= 1 and sum(counts) == 20000


def test_a_further_shard_only_takes_cells(spark):
    before, after = ({r["cell"]: r["home"] for r in ring(spark, n, 3).collect()} for n in (700, 701))
    assert set(before.values()) == set(range(700)) and set(after.values()) == set(range(701))
    assert sum(before[c] != after[c] and after[c] != 700 for c in before) <= 2**16 // 200


def test_too_many_shards_are_refused(spark):
    with pytest.raises(ValueError, match="shards"):
        ring(spark, MOST_SHARDS + 1, 1)
