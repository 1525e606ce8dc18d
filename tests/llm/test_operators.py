"""The ten operators against brute-force versions, and on the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marginalia.llm import grams, toxicity as toxicity_module, warc
from marginalia.llm.common import Scratch, new_path, words as word_column
from marginalia.llm.decontaminate import decontaminate, leaks
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.mixing import mix_sources, source_targets
from marginalia.llm.ngram_join import CELL_BITS, Plan, _marks, _posted, met_keys, ngram_join, ngram_links, ngram_sets, one_of_each, with_earlier_keys
from marginalia.llm.quality import CUTOFF, FALSE_REJECTIONS, quality_rules, reject_outliers
from marginalia.llm.sharding import ring_shards
from marginalia.llm.substring_dedup import substring_dedup
from marginalia.llm.token_counts import counter, read_cache, token_counts
from marginalia.llm.toxicity import fit, toxicity
from tests.llm import corpus


@pytest.fixture(scope="module")
def rows():
    return corpus.make_rows(corpus.make_texts())


@pytest.fixture(scope="module")
def docs(spark, rows):
    return corpus.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


def ordered(values):
    return sorted(values, key=repr)


def test_words_are_runs_without_ascii_blanks(spark, rows, docs):
    got = docs.select("text", word_column(F.col("text")).alias("w")).collect()
    assert all((r.w or []) == corpus.words(r.text) for r in got)


class TestSharding:
    def test_counts_slots_and_homes(self, docs, rows):
        got = ring_shards(docs, shards=7).select("row.doc_id", "size", "text_crc32", "home", "shard", "slot").collect()
        assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        home = Counter(r.home for r in got)
        moved = sum(r.home != r.shard for r in got)
        assert moved == sum(max(0, home[s] - sizes[s]) for s in range(7)), "only what overflows leaves its home"

    def test_overflow_goes_clockwise(self, spark):
        """Every row lies at the first shard with room, arcs after arcs, as a walk over the ring finds it."""
        from marginalia.llm.sharding import ring

        docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
        got = ring_shards(docs, shards=5, vnodes=6, slack=0.1).select("row.doc_id", "home", "shard").collect()
        cells = ring(spark, 5, 6).select("arc", "home").distinct().orderBy("arc").collect()
        keyed = {r.doc_id: r for r in got}
        places = docs.select("doc_id", F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))).alias("at")).collect()
        arcs = [c.arc for c in cells]
        members = defaultdict(list)
        for p in places:
            cell = (p.at & (2**64 - 1)) >> 48
            members[next((a for a in arcs if a >= cell), arcs[0])].append((p.at, p.doc_id))
        room = {s: -(-300 * 11 // 50) for s in range(5)}
        rejected, want = {}, {}
        for s in range(5):
            for c in (c for c in cells if c.home == s):
                for k in sorted(members[c.arc]):
                    if room[s]:
                        room[s] -= 1
                        want[k[1]] = s
                    else:
                        rejected.setdefault(c.arc, []).append(k)
        queue = []
        for lap in range(2):
            for c in cells:
                queue += rejected.get(c.arc, []) if lap == 0 else []
                while queue and room[c.home]:
                    room[c.home] -= 1
                    want[queue.pop(0)[1]] = c.home
        assert {d: r.shard for d, r in keyed.items()} == want

    def test_one_more_shard_moves_little(self, spark):
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
        a, b = (ring_shards(docs, shards=s, slack=0.05).select("row.doc_id", F.col("shard").alias(f"s{s}")) for s in (10, 11))
        assert a.join(b, "doc_id").filter("s10 <> s11").count() < 1200

    def test_empty(self, empty):
        assert ring_shards(empty).count() == 0


class TestQuality:
    def test_counts_and_base_rule(self, docs, rows):
        got = quality_rules(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        want = []
        for r in rows:
            c = corpus.text_counts(r[1])
            want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert ordered(tuple(g)[:7] for g in got) == ordered(want)
        assert not any(g.kept and g.base_failed for g in got)

    def test_outliers_of_a_group_go_and_the_rest_stays(self, spark):
        r = random.Random(5)
        prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200)))
        rows = [(i, prose(), "en", "s1", 0, 0, "", "", 0) for i in range(300)]
        rows += [(1000 + i, " ".join(w + "%%%" for w in prose().split()), "en", "s1", 0, 0, "", "", 0) for i in range(20)]
        got = {x.doc_id: x.kept for x in quality_rules(corpus.frame(spark, rows)).select("row.doc_id", "kept").collect()}
        assert all(got[i] for i in range(300))
        assert not any(got[1000 + i] for i in range(20))

    def test_cutoff_is_the_stated_quantile(self, spark):
        """A document that is far out for a chi-square variable goes, though it is no extreme."""
        assert math.exp(-CUTOFF / 2) * (1 + CUTOFF / 2) == pytest.approx(FALSE_REJECTIONS, rel=1e-3)
        r = random.Random(6)
        prose = lambda: ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))]
        rows = [(i, " ".join(prose()), "en", "s1", 0, 0, "", "", 0) for i in range(300)]
        rows += [(1000 + i, " ".join(w + "%" * (k % 4 == 0) for k, w in enumerate(prose())), "en", "s1", 0, 0, "", "", 0) for i in range(10)]
        got = {x.doc_id: x for x in quality_rules(corpus.frame(spark, rows)).select("row.doc_id", "distance", "kept").collect()}
        assert all(got[i].kept for i in range(300))
        assert all(CUTOFF < got[1000 + i].distance < 60 and not got[1000 + i].kept for i in range(10))

    def test_empty(self, empty):
        assert quality_rules(empty).count() == 0


    @pytest.mark.parametrize("n", [4096, 4098, 4099, 30_000])
    def test_repeats_in_long_texts(self, spark, n):
        """On both sides of the length from which windows are sorted with their whole hashes."""
        w = [f"w{i}" for i in range(n)]
        w[n - 4 : n - 1] = w[7:10]
        text = " ".join(w)
        got = quality_rules(spark.createDataFrame([(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string")).first()
        assert (got.n_words, got.n_repeat_words) == (corpus.text_counts(text)[0], corpus.text_counts(text)[4]) == (n, 6)

    def test_small_groups_are_judged_with_their_language(self, spark):
        """Groups of 30 of one language form a pool: what is far out for that goes, though no group has an estimate of its own."""
        r = random.Random(8)
        prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200)))
        junk = lambda: " ".join(w + "%%%" for w in prose().split())
        rows = [(100 * s + i, junk() if i == 0 else prose(), "en", f"s{s}", 0, 0, "", "", 0) for s in range(4) for i in range(30)]
        rows += [(1000 + i, junk(), "de", "s0", 0, 0, "", "", 0) for i in range(5)]  # too few for any estimate
        got = {x.doc_id: x.kept for x in quality_rules(corpus.frame(spark, rows)).select("row.doc_id", "kept").collect()}
        assert {i for i, kept in got.items() if not kept} == {0, 100, 200, 300}

    def test_estimates_against_concentration_steps_in_numpy(self, spark):
        """Squared distances equal those of the same steps over whole arrays, up to the bins that cut the nearest part."""
        r = random.Random(12)
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + "%" * (r.random() < 0.02) for _ in range(r.randint(60, 200))) for _ in range(400)]
        texts += [" ".join(w + "#" * 3 for w in texts[i].split()) for i in range(40)]
        rows = [(i, t, "en", "s", 0, 0, "", "", 0) for i, t in enumerate(texts)]
        got = {x.doc_id: x.distance for x in quality_rules(corpus.frame(spark, rows)).select("row.doc_id", "distance").collect()}
        want = corpus.robust_distances(texts)
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=0.15, atol=0.2)
        assert all((got[i] > CUTOFF) == (want[i] > CUTOFF) for i in range(len(texts)))

    def test_rejected_rows_leave_with_all_columns(self, docs, rows):
        left = reject_outliers(docs.withColumns({"h1": F.lit(1), "own": F.lit("x"), "g": F.lit("y")}))
        judged = quality_rules(docs, ("doc_id", "text")).filter("kept").select("row.doc_id", "row.text")
        assert left.columns == [*docs.columns, "h1", "own", "g"]
        assert ordered(map(tuple, left.select("doc_id", "text").collect())) == ordered(map(tuple, judged.collect()))


class TestMixing:
    def test_targets(self, spark):
        sizes = {"a": 1000, "b": 10, "c": 500, None: 90}
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        weight = {"a": 1, "b": 2, "c": 3, None: 1}
        capped = set()
        while True:  # share by weight, stop what is above, reshare
            rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
            level = rest / sum(weight[s] for s in sizes if s not in capped)
            above = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
            if not above:
                break
            capped |= above
        want = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        assert got == pytest.approx(want)

    def test_taken_words_meet_targets(self, docs, rows):
        got = mix_sources(docs).select("row.doc_id", "size", "source", "source_size", "target", "copies", "taken").collect()
        assert ordered((g.doc_id, g.size) for g in got) == ordered((r[0], len(corpus.words(r[1]))) for r in rows)
        by = defaultdict(list)
        for g in got:
            by[g.source].append(g)
        for own in by.values():
            assert abs(sum(g.taken for g in own) - own[0].target) <= max(g.size for g in own)
            assert max(g.copies for g in own) - min(g.copies for g in own) <= 1
            assert all(g.taken <= 3 * g.size for g in own)
        again = mix_sources(docs.repartition(3)).select("row.doc_id", "size", "copies").collect()
        assert ordered(map(tuple, again)) == ordered((g.doc_id, g.size, g.copies) for g in got)

    def test_heavier_documents_come_first(self, spark):
        rows = [(i, "w " * 10, "en", s, 0, 0, "", "", 0) for s, base in (("a", 0), ("b", 1000)) for i in range(base, base + 400)]
        weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
        got = mix_sources(corpus.frame(spark, rows), weight=weight, weights=(1, 3)).select("row.doc_id", "source", "copies").filter("source = 'a' and copies > 0").collect()
        even = sum(g.doc_id % 2 == 0 for g in got)
        assert len(got) == 200 and even > 1.5 * (200 - even)

    def test_empty(self, empty):
        assert mix_sources(empty).count() == 0


    def test_low_weights_and_missing_ids(self, spark):
        """Keys of any scale meet the target, and rows without ids are drawn one by one."""
        rows = [(None if i % 2 else i, f"w{i} " * 10, "en", "a" if i < 300 else "b", 0, 0, "", "", 0) for i in range(600)]
        for weight in (1e-9, 1.0, 1e9):
            got = mix_sources(corpus.frame(spark, rows), weight=F.lit(weight), weights=(1, 3)).select("row.doc_id", "source", "taken", "target").collect()
            for s in "ab":
                own = [g for g in got if g.source == s]
                assert abs(sum(g.taken for g in own) - own[0].target) <= 10
            assert 30 < sum(g.source == "a" and g.doc_id is None and g.taken > 0 for g in got) < 120


class TestDecontamination:
    def items(self, spark, texts):
        return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")

    def test_planted_passages(self, spark, rows):
        r = random.Random(3)
        item = [" ".join("".join(r.choice("lmnopq") for _ in range(r.randint(2, 6))) for _ in range(n)) for n in (20, 30, 60)]
        plain = " ".join("".join(r.choice("rstuv") for _ in range(5)) for _ in range(80))
        edited = item[2].split()
        edited[30] = "CHANGED"
        half = " ".join(item[1].split()[:15])
        texts = [plain, f"{plain} {item[0].upper()} {plain}", item[1], f"{half} {plain}", f"{plain} {' '.join(edited)}", None, "", item[0], item[0] + " " + item[0]]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, item[1])], "doc_id bigint, text string")
        found = leaks(docs, self.items(spark, [*item, "too short", None])).collect()
        assert ordered((f.doc_id, f.item_id) for f in found) == ordered([(1, 0), (2, 1), (4, 2), (7, 0), (8, 0), (None, 1)])
        exact = {f.doc_id: f for f in found}
        assert (exact[1].start, exact[1].hamming, exact[1].similarity) == (80, 0, 1.0)
        assert 0.8 <= exact[4].similarity < 1
        left = decontaminate(docs, self.items(spark, item)).collect()
        assert ordered(x.doc_id for x in left) == [0, 3, 5, 6]

    def test_best_window_of_all(self, spark):
        """Passages in another order, with gaps and at the ends, against all windows of the item's size."""
        r = random.Random(4)
        word = lambda: "".join(r.choice("lmnopq") for _ in range(4))
        items = [[word() for _ in range(m)] for m in (60, 60, 80)]
        items[1][:30] = items[0][30:]  # items share a passage
        texts = []
        for x in items:
            for cut in (len(x) // 2, len(x) // 3):
                turned = x[cut:] + x[:cut]
                for before, after in ((0, 0), (7, 9), (0, 30), (30, 0)):
                    texts.append([word() for _ in range(before)] + turned + [word() for _ in range(after)])
            texts.append(x[:-3])
            texts.append(x[:20] + [word()] + x[20:] + x[:20])
            texts.append(x[: len(x) // 2])
        docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id bigint, text string")
        grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        df = Counter(g for x in items for g in grams(x))
        weight = lambda g: round(math.log(1 + len(items) / df.get(g, 1)) * 1000)
        want = {}
        for d, text in enumerate(texts):
            for k, x in enumerate(items):
                for start in range(max(1, len(text) - len(x) + 1)):
                    a, b = grams(text[start : start + len(x)]), grams(x)
                    both, total = (sum(weight(g) * c for g, c in bag.items()) for bag in (a & b, a | b))
                    if 100 * both >= 80 * total and (both / total, -start) > want.get((d, k), (0, 0)):
                        want[d, k] = (both / total, -start)
        assert set(range(8)) <= {d for d, _ in want}, "both parts lie in one window"
        got = leaks(docs, self.items(spark, [" ".join(x) for x in items])).collect()
        assert {(f.doc_id, f.item_id): (round(f.similarity, 9), -f.start) for f in got} == {k: (round(s, 9), at) for k, (s, at) in want.items()}

    def test_items_of_few_words(self, spark):
        items = self.items(spark, ["alone", "two words", "one more short item", "five words make a shingle"])
        texts = ["nothing here", "it says TWO  words\there", "two other words", "alone", "one more short item", "x one more short item y", "five words make a", "so five words make a shingle too"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = leaks(docs, items).select("doc_id", "item_id", "n_words", "start", "similarity").collect()
        assert ordered(map(tuple, found)) == ordered([(1, 1, 2, 2, 1.0), (3, 0, 1, 0, 1.0), (4, 2, 4, 0, 1.0), (5, 2, 4, 1, 1.0), (7, 3, 5, 1, 1.0)])

    def test_very_long_texts_repeated_rows_and_other_columns(self, spark):
        r = random.Random(14)
        word = lambda: "".join(r.choice("lmnopq") for _ in range(5))
        item = [word() for _ in range(40)]
        long = [word() for _ in range(300_000)]
        long[200_000:200_040] = item
        rows = [(1, " ".join(long), "a", "b", "c", 1), (1, " ".join(long), "a", "b", "c", 1), (2, " ".join(long[:5000]), "a", "b", "c", 1), (None, " ".join(item), None, None, None, None)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, own_id string, own_text string, _d string, th int")
        found = leaks(docs, self.items(spark, [" ".join(item)])).collect()
        assert ordered((f.doc_id, f.start, f.similarity) for f in found) == ordered([(1, 200_000, 1.0), (None, 0, 1.0)])
        left = decontaminate(docs, self.items(spark, [" ".join(item)]))
        assert left.columns == docs.columns and [x.doc_id for x in left.collect()] == [2]

    def test_empty_tables(self, spark, empty, docs):
        assert leaks(empty, self.items(spark, ["a b c d e f"])).count() == 0
        assert leaks(docs, self.items(spark, [None])).count() == 0


class TestWarc:
    def pages(self, spark):
        html = ["<p>one</p>", "<p>two</p>" * 2000, "<p>one</p>", None, "", "é😀\r\n\r\nWARC/1.1\r\n", "<p>one</p>"]
        rows = [(10 - i, "http://a/\r\nb c é" if i == 0 else None if i == 1 else f"http://a/{i}", h) for i, h in enumerate(html)] + [(None, "u", "nothing like it")]
        return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string")

    def test_round_trip(self, spark):
        rows, pages = self.pages(spark)
        path = new_path(spark, "warc")
        warc.write_bundles(pages, path)
        got = {r.page_id: r for r in warc.read_bundles(spark, path).collect()}
        least = {}
        for p, _, h in rows:
            if p is not None:
                least[h or ""] = min(least.get(h or "", p), p)
        assert len(got) == len(rows)
        for p, _, h in rows:
            payload = (h or "").encode()
            g = got[p]
            assert (g.payload_bytes, g.payload_digest) == (len(payload), warc.digest_of(payload))
            first = least.get(h or "", p)
            assert (g.record_type, g.refers_to) == (("response", None) if p == first else ("revisit", first))

    def test_seek_table_of_a_file(self, spark, monkeypatch):
        monkeypatch.setattr(warc, "FRAME_BYTES", 500)
        rows, pages = self.pages(spark)
        path = new_path(spark, "warc")
        warc.write_bundles(pages.repartition(1), path)
        folder = Path(path.removeprefix("file://")) / "bundles"
        places = {r.record_id: r for r in warc.index(spark, path).collect()}
        bundles = {f.name: warc.SeekableBundle(f.open("rb")) for f in folder.iterdir()}
        assert {r.bundle for r in places.values()} == set(bundles)
        for p, url, h in rows:
            at = places[warc.record_id(p)]
            record = bundles[at.bundle].record(at.frame, at.offset, at.length)
            assert record["page_id"] == p and record["payload"] in (None, (h or "").encode())
        for f in folder.iterdir():  # a reader that knows no seek tables gets all records too
            whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(f.read_bytes())
            assert whole.count(b"WARC/1.1\r\nWARC-Type") == sum(r.bundle == f.name for r in places.values())

    def test_small_payloads_and_no_pages(self, spark):
        _, pages = self.pages(spark)
        path = new_path(spark, "warc")
        warc.write_bundles(pages, path, min_bytes=100)
        assert warc.read_bundles(spark, path).filter("record_type = 'revisit'").count() == 0
        path = new_path(spark, "warc")
        warc.write_bundles(pages.limit(0), path)
        assert warc.read_bundles(spark, path).count() == 0

    def test_repeated_rows_other_columns_and_a_long_payload(self, spark):
        rows = [(1, "u", "x", 1, "p")] * 3 + [(2, "u", "x", 2, "q"), (None, None, "x", 3, None), (3, "u", "long " * 1_000_000, 4, "r")]
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int, first string")
        path = new_path(spark, "warc")
        warc.write_bundles(pages, path)
        got = warc.read_bundles(spark, path).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
        assert ordered(map(tuple, got)) == ordered([(1, 1, "response", None)] * 3 + [(2, 1, "revisit", 1), (None, 1, "revisit", 1), (3, 5_000_000, "response", None)])


class TestNgramJoin:
    @pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
    def test_components(self, docs, rows, n, percent):
        got = ngram_join(docs, n=n, percent=percent).select("row.doc_id", "n_shingles", "component_id").collect()
        assert ordered(map(tuple, got)) == ordered(corpus.components(rows, n, percent))

    def test_all_links(self, spark):
        """A group of near copies that all link, with equal rows and empty ones among them: none of its pairs is left out."""
        base = [f"w{i}" for i in range(200)]
        texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 200, 10)]
        texts += [texts[3]] * 3 + [" ".join(base[:40]), "", None]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(corpus.words, texts)]
        linked = lambda a, b: bool(a) and 100 * len(a & b) >= 90 * len(a | b)
        want = [(i, len(a), sum(i != j and linked(a, b) for j, b in enumerate(sets))) for i, a in enumerate(sets)]
        assert max(x[2] for x in want) == 22
        assert ordered(map(tuple, ngram_links(frame, n=3, percent=90).select("row.doc_id", "n_shingles", "n_links").collect())) == ordered(want)

    def test_keys_meet_for_every_pair_of_linked_sets(self):
        r = np.random.default_rng(7)
        levels = r.integers(0, 9, 1 << CELL_BITS, dtype=np.uint8)
        for percent in (80, 90):
            plan = Plan(percent)
            for _ in range(1500):
                s = int(r.integers(1, 150))
                a = np.unique(r.integers(0, 2**63, s, dtype=np.uint64))
                grow, shrink = r.integers(0, s // 8 + 2), r.integers(0, s // 8 + 2)
                b = np.unique(np.concatenate((a[shrink:], r.integers(0, 2**63, grow, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(plan.keys(a, levels), plan.keys(b, levels))), (percent, len(a), len(b))

    def test_lists_of_two_sets_that_can_not_link_are_dropped(self, spark):
        """Of three pairs that share a shingle among their rarest, only the pair that links is kept."""
        prose = lambda k, n: [f"{k}w{i}" for i in range(n)]
        linked = [prose("a", 100), ["x", *prose("a", 100)[1:]]]
        texts = linked + [prose("b", 100), prose("b", 3) + prose("c", 30)] + [["p", *prose("d", 100)], prose("d", 40) + prose("e", 60)]
        frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
        with Scratch(spark, "test") as scratch:
            keyed = scratch.saved(ngram_sets(frame, ("doc_id",), 3, 90), "sets")
            met = met_keys(keyed, 90, scratch).join(keyed.select("node", "row.doc_id"), "node")
            both = met.groupBy("key").agg(F.collect_set("doc_id").alias("ids"), F.min("left").alias("left"), F.sum("n").alias("n")).collect()
        assert any(set(r.ids) == {0, 1} for r in both) and not any(2 in r.ids or 3 in r.ids for r in both)
        assert all(190 * r.left >= 90 * r.n for r in both)
        assert ngram_join(frame, n=3, percent=90).filter("component_id <> row.doc_id").count() == 1

    def test_first_shared_key_leaves_what_a_link_needs(self):
        r = np.random.default_rng(8)
        levels = r.integers(0, 9, 1 << CELL_BITS, dtype=np.uint8)
        met = 0
        for percent in (80, 90):
            plan = Plan(percent)
            for _ in range(1500):
                s = int(r.integers(1, 150))
                a = np.unique(r.integers(0, 2**63, s, dtype=np.uint64))
                b = np.unique(np.concatenate((a[r.integers(0, s // 8 + 2) :], r.integers(0, 2**63, r.integers(0, s // 8 + 2), dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and max(len(a), len(b)) > plan.boundary:
                    x, y = (list(plan.keys(m, levels)[: plan.first(len(m))]) for m in (a, b))
                    first = next(k for k in x if k in y)
                    assert min(len(a) - x.index(first), len(b) - y.index(first)) >= plan.overlap(len(a), len(b))
                    met += 1
        assert met > 500

    def test_lists_of_a_large_group_of_near_copies(self, spark):
        """Near copies that share a frequent passage, some linked only through others, beside texts that only share the passage."""
        r = random.Random(15)
        prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
        passage, base, texts = prose(60), prose(120), []
        for i in range(150):
            w = base + passage
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = f"x{i}"
            texts.append(" ".join(w))
            texts.append(" ".join(prose(r.randint(20, 90)) + passage))
        rows = list(enumerate(texts))
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        for n, percent in ((3, 90), (5, 80)):
            got = ngram_join(frame, n=n, percent=percent).select("row.doc_id", "n_shingles", "component_id").collect()
            assert ordered(map(tuple, got)) == ordered(corpus.components(rows, n, percent))

    def test_pairs_of_many_shared_keys_are_made_about_once(self, spark):
        """Texts that share a long passage and don't link meet in many lists; nearly all of these leave a pair to an earlier one."""
        prose = lambda k, n: [f"{k}w{i}" for i in range(n)]
        texts = [" ".join(prose("p", 300) + prose(f"a{i}-", 80 + i)) for i in range(24)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        with Scratch(spark, "test") as scratch:
            keyed = scratch.saved(ngram_sets(frame, ("doc_id",), 5, 80), "sets")
            met = scratch.saved(with_earlier_keys(met_keys(keyed, 80, scratch)), "earlier")
            a, b = (met.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "earlier"))) for x in "ab")
            every = a.join(b, "key").filter("node_a < node_b")
            pairs, made = every.select("node_a", "node_b").distinct().count(), every.filter("not arrays_overlap(earlier_a, earlier_b)")
            assert made.select("node_a", "node_b").distinct().count() == pairs and made.count() <= 2 * pairs and every.count() >= 5 * pairs

    def test_few_keys_but_those_that_sets_share_are_posted(self, spark):
        """Of the keys of 300 sets, those that two have are posted, at their places, and of 12,000 others one in eight at most."""
        r = np.random.default_rng(16)
        both = r.integers(-(2**63), 2**63, 200)
        rows = [(i, 40 + i, [int(k) for k in (*r.integers(-(2**63), 2**63, i % 80), both[i % 200], *r.integers(-(2**63), 2**63, 3))]) for i in range(300)] + [(300, 0, [])]
        sets = spark.createDataFrame(rows, "node bigint, n bigint, keys array<bigint>")
        shared = spark.createDataFrame([(int(k),) for k in both[:100]], "key bigint")
        marks = spark.sparkContext.broadcast(_marks(shared))
        got = {tuple(x) for x in sets.mapInArrow(_posted(marks), "key bigint, node bigint, n bigint, at bigint").collect()}
        every = {(k, i, n, at) for i, n, keys in rows for at, k in enumerate(keys)}
        asked = {x for x in every if x[0] in set(both[:100].tolist())}
        assert len(every) > 12_000 and len(asked) == 200 and asked <= got <= every and len(got - asked) < len(every) / 8
        assert len(_marks(shared.limit(0))) == 16 and not _marks(shared.limit(0)).any()

    def test_columns_of_any_name_stay(self, docs):
        more = docs.withColumns({"_d": F.lit(1), "own_id": F.lit(2), "own_text": F.lit(3), "rank": F.lit(4), "text_hash": F.lit(5)})
        left = one_of_each(more)
        assert left.columns == more.columns and left.count() == one_of_each(docs).count()

    def test_one_of_each(self, docs, rows):
        left = one_of_each(docs).select(*corpus.DOCUMENT_COLUMNS).collect()
        want = {c for _, n, c in corpus.components(rows, 5, 80) if n}
        assert ordered({r.doc_id for r in left if corpus.words(r.text)}) == ordered(want)
        assert sum(1 for r in left if not corpus.words(r.text)) == sum(1 for r in rows if not corpus.words(r[1]))
        assert len(left) == len({(r.doc_id, r.text) for r in left})

    def test_empty(self, empty):
        assert ngram_join(empty).count() == 0


class TestTokenCounts:
    def path(self, name="byte_bpe_50k.json"):
        return pytest.importorskip("public_tokenizers").path(name)

    def test_counts_and_cache(self, spark, docs, rows):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path())
        cache = new_path(spark, "cache")
        got = token_counts(docs, cache, self.path()).select("row.doc_id", "n_bytes", "n_tokens").collect()
        assert ordered(map(tuple, got)) == ordered((r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
        assert read_cache(spark, cache).count() == len({r[1] or "" for r in rows})
        more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("quite new")))
        assert token_counts(more, cache, self.path()).count() == len(rows) + 1
        assert read_cache(spark, cache).count() == len({r[1] or "" for r in rows}) + 1

    def test_long_runs_of_blanks(self, spark):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path())
        texts = [" " * 2_000_000, "\n" * 1_500_000, "a" + "\t" * 100_000 + "b", "\u00a0" * 150_000, "x" * 50_000, "word " * 100_000]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = dict(token_counts(docs, new_path(spark, "cache"), self.path()).select("row.doc_id", "n_tokens").collect())
        assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}

    @pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
    def test_other_tokenizers(self, name, rows):
        content, texts = open(self.path(name), "rb").read(), [r[1] or "" for r in rows] + ["two words", "<|endoftext|> and <s> in a text", " " * 1000]
        if name.endswith(".model"):
            import sentencepiece

            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=self.path(name)).encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            want = [len(Tokenizer.from_file(self.path(name)).encode(t, add_special_tokens=False).ids) for t in texts]
        assert counter(content, name)(texts) == want and max(want) > 1000

    def test_empty(self, spark, empty):
        assert token_counts(empty, new_path(spark, "cache"), self.path()).count() == 0


class TestLineDedup:
    def test_against_all_pairs(self, spark):
        r = random.Random(11)
        line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).strip() or "x"
        lines = [line(r.choice([3, 8, 12, 13, 20, 60])) for _ in range(40)]
        for x in list(lines):
            at = r.randrange(len(x) + 1)
            lines += [x[:at] + r.choice("ab") + x[at:], x[:at] + x[at + 1 :], x[:at] + "z" + x[at + 1 :]]
        lines += ["", " ", "\t"]
        rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(60, None)]
        got = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
        assert {g.doc_id: g.kept for g in got} == corpus.lines_kept(rows)
        text = dict(rows)
        for g in got:
            n = sum(1 for x in (text[g.doc_id] or "").split("\n") if corpus.words(x))
            assert (g.n_lines, g.n_dropped) == (n, n - sum(1 for x in g.kept.split("\n") if corpus.words(x)))

    def test_awkward_rows(self, docs, rows, empty):
        assert dedup_lines(docs).count() == len(rows)
        assert dedup_lines(empty).count() == 0

    def test_nulls_ties_long_lines_and_other_columns(self, docs, spark):
        long = "long line of text " * 20_000
        rows = [(1, f"{long}\nsame line here", "h"), (2, f"{long}x\nsame line here\nshort", None), (2, None, "h"), (None, "same line hers\nshort", None), (3, "", "h"), (3, " \nshort", "h")]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, h1 string").withColumns({"pos": F.lit(1), "line": F.lit("l"), "first": F.lit(2)})
        got = {(x.row.doc_id, x.row.text): x.kept for x in dedup_lines(frame, ("doc_id", "text")).collect()}
        assert got == {(1, rows[0][1]): rows[0][1], (2, rows[1][1]): "short", (2, None): "", (None, rows[3][1]): "", (3, ""): "", (3, " \nshort"): " "}


class TestSubstringDedup:
    @pytest.mark.parametrize("length", [35, 8, 5])
    def test_against_all_windows(self, docs, rows, length):
        got = substring_dedup(docs, length=length).select("row.doc_id", "n_words", "n_removed", "repeats", "kept").collect()
        want = corpus.without_repeats(rows, length)
        assert ordered((g.doc_id, g.n_words, g.kept) for g in got) == ordered(want)
        assert all(g.n_removed == sum(x.end - x.start for x in g.repeats) for g in got)

    def test_empty(self, empty):
        assert substring_dedup(empty).count() == 0

    def test_hashes_do_not_depend_on_slices(self):
        import pyarrow as pa

        column = pa.array(["one two  three", None, "", "four\n", "five six seven eight nine ten"])
        whole = [h.tolist() for _, _, h, _ in grams.texts(column)]
        small = [x for _, _, h, _ in grams.texts(column, slice_bytes=4) for x in h.tolist()]
        assert sum(whole, []) == small and len(small) == 10


class TestToxicity:
    def test_held_out_accuracy(self, spark):
        r = random.Random(2)
        prose = lambda: ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(60)]
        rows, labels = [], []
        for i in range(600):
            w = prose()
            if i % 5 == 0:
                w[r.randrange(60)] = r.choice(["vile", "Nasty", "awful"])
            rows.append((i, " ".join(w)))
            labels.append((i, int(i % 5 == 0)))
        docs = spark.createDataFrame([*rows, (None, "vile"), (9000, None), (9001, "")], "doc_id bigint, text string")
        known = spark.createDataFrame([x for x in labels if x[0] >= 150] + [(None, 1), (7000, None)], "doc_id bigint, toxic int")
        weights = fit(docs, known)
        got = {x.doc_id: x.score for x in toxicity(docs, weights).select("row.doc_id", "score").collect()}
        assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(150))
        assert got[9000] == got[9001] < 0.5 and got[None] > 0.5
        assert np.array_equal(weights, fit(docs.repartition(5), known))
        assert 0 < np.count_nonzero(weights) < 5000

    def test_weights_against_a_plain_version(self):
        """One coordinate at a time, in Python floats."""
        r = random.Random(3)
        examples = [(np.unique([0, *(r.randrange(1, 50) for _ in range(6))]).astype(np.int32), r.randrange(2)) for _ in range(300)]
        z, n = defaultdict(float), defaultdict(float)

        def weight(i):
            strength = 0.0 if i == toxicity_module.BIAS else toxicity_module.L1
            if abs(z[i]) <= strength:
                return 0.0
            return -(z[i] - math.copysign(strength, z[i])) / ((toxicity_module.BETA + math.sqrt(n[i])) / toxicity_module.ALPHA + toxicity_module.L2)

        for _ in range(3):
            for slots, label in examples:
                w = {int(i): weight(int(i)) for i in slots}
                g = 1 / (1 + math.exp(-sum(w.values()))) - label
                for i in w:
                    sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity_module.ALPHA
                    z[i] += g - sigma * w[i]
                    n[i] += g * g
        got = toxicity_module.ftrl(examples, epochs=3)
        assert np.allclose(got[:50], [weight(i) for i in range(50)]) and not got[50:].any()

    def test_long_texts_repeated_rows_other_columns_and_bounds(self, spark):
        texts = ["good plain words " * 5, "vile words " * 5, "good " * 300_000 + "vile", "good plain words " * 5]
        docs = spark.createDataFrame([(i % 3, t, "k", 1) for i, t in enumerate(texts)] * 4, "doc_id bigint, text string, key string, label int")
        known = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (1, 0, "y"), (2, 2, "x")], "doc_id bigint, toxic int, slots string")
        weights = fit(docs, known)
        scored = toxicity(docs, weights, ("doc_id", "text", "key")).collect()
        assert len(scored) == 16 and len({(x.row.doc_id, x.row.text, x.score) for x in scored}) == 3 and all(0 <= x.score <= 1 for x in scored)
        assert not fit(docs, known, max_slots=3).any() and fit(docs, known, max_rows=1).any()

    def test_no_rows(self, spark, empty):
        weights = fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))
        assert toxicity(empty, weights).count() == 0
        one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
        assert toxicity(one, weights).first().score == 0.5


def test_digest_of_kept_words(docs, rows):
    got = substring_dedup(docs).select("row.doc_id", F.sha2("kept", 256).alias("d")).collect()
    assert ordered(map(tuple, got)) == ordered((i, hashlib.sha256(k.encode()).hexdigest()) for i, _, k in corpus.without_repeats(rows, 35))
