"""MinHash near-duplicates against all pairs, its signatures against plain minima, and components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marginalia.llm import minhash, near
from marginalia.llm.graph import star_components
from marginalia.llm.minhash import minhash_duplicates
from tests.llm.corpus import SCHEMA, components, frame, make_rows, make_texts


@pytest.mark.parametrize(("n", "broadcast"), [(2, True), (2, False), (5, True)])
def test_classes_equal_all_pairs(spark, monkeypatch, n, broadcast):
    if not broadcast:
        monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(near, "BROADCAST_NODES", 0)
    rows = make_rows(make_texts(seed=n, count=80))
    want = components(rows, n, 80)
    found = minhash_duplicates(frame(spark, rows), ("doc_id", "key"), n=n).collect()
    got = [(r["row"]["doc_id"], r["n_shingles"], r["component_id"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (r["row"]["doc_id"] == r["component_id"]) for r in found)
    assert len({r["component_id"] for r in found}) < len(rows) - 10


def test_a_chain_of_near_copies_and_a_group_around_none(spark):
    """Texts that link only with their neighbours, and texts that share half without linking: no link between components is lost."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    chain = [" ".join(words[i * 8 : i * 8 + 120]) for i in range(30)]
    half = words[:100]
    apart = [" ".join(half + [f"x{i}y{j}" for j in range(60)]) for i in range(40)]
    pairs = [t + " end" for t in apart[::4]]
    rows = make_rows(chain + apart + pairs)
    got = [(x["row"]["doc_id"], x["n_shingles"], x["component_id"]) for x in minhash_duplicates(frame(spark, rows), n=2).collect()]
    assert sorted(got, key=repr) == sorted(components(rows, 2, 80), key=repr)


def test_null_ids_never_name_a_class_of_others(spark):
    texts = ["the same few words in here"] * 9
    rows = [(None if i < 3 else i, *x[1:]) for i, x in enumerate(make_rows(texts))]
    assert {(r["row"]["doc_id"], r["component_id"], r["kept"]) for r in minhash_duplicates(frame(spark, rows), n=2).collect() if r["n_shingles"] == 5} == {(None, 3, False), *((i, 3, i == 3) for i in (*range(3, 9), 10))}


def test_an_empty_table(spark):
    assert minhash_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_are_plain_minima_and_estimate_similarity():
    r = np.random.default_rng(6)
    a, b = minhash.functions(210)
    pool = r.integers(0, 2**64, 3000, dtype=np.uint64)
    for size in (1, 3, 256, 257, 1000):
        members = pool[:size]
        plain = [min((int(f) * int(x >> np.uint64(32)) + int(g)) % 2**32 for x in members) for f, g in zip(a[:20], b[:20], strict=True)]
        assert minhash.signature(members, 210)[:20].tolist() == plain
    share = [np.mean(minhash.signature(pool[i : i + 900], 210) == minhash.signature(pool[i + 100 : i + 1000], 210)) for i in range(0, 2000, 100)]
    assert abs(np.mean(share) - 0.8) < 0.02
    apart = [np.mean(minhash.bits(minhash.signature(pool[i : i + 50], 210)) == 0) for i in range(0, 2000, 100)]
    assert np.mean(apart) < 0.1


def test_the_bands_find_nearly_all_pairs():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-7


@pytest.mark.parametrize("seed", [1, 2])
def test_star_components_equal_a_plain_search(spark, seed):
    r = random.Random(seed)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(0, 120)] + [(ids[150], ids[i]) for i in range(151, 220)] + [(r.choice(ids[220:]), r.choice(ids[220:])) for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    least = {}
    for x in root:
        least[find(x)] = min(least.get(find(x), x), x)
    want = {x: least[find(x)] for e in edges if e[0] != e[1] for x in e}
    got = star_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {x["node"]: x["root"] for x in got.collect()} == want and got.count() == len(want)


def test_no_edges(spark):
    assert star_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
