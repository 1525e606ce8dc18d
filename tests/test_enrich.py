"""Enrichment, order and renders on small cases: the semantics that are easy to get wrong."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from marginalia import sinks
from marginalia.operators import books, enrich, flow, order, render
from marginalia.plans import fixtures
from marginalia.schema import conform


def annotations(spark, *rows):
    """(event_id, char_start, char_end, content) of book 1."""
    data = [(i, 1, s, e, c, None) for i, s, e, c in rows]
    return spark.createDataFrame(data, "event_id bigint, book_id bigint, char_start bigint, char_end bigint, content string, page int")


def by_id(df, *columns):
    return {r.event_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


TEXT = "Hello \n  wide world"


class TestText:
    CASES = [(1, 0, 5, ""), (2, 0, 19, "[yellow]"), (3, 6, None, ""), (4, 6, 0, ""), (5, 99, 120, ""), (6, 9, 500, "[open tag"), (7, 0, 5, "a note"), (8, None, 5, ""), (9, 5, 9, "[x]"), (10, 10, 4, "")]
    WANT = {1: "Hello", 2: "[yellow] Hello wide world", 3: "", 4: "", 5: "", 6: "wide world", 7: "a note", 8: "", 9: "[x]", 10: ""}

    def test_simple_form(self, spark):
        text = spark.createDataFrame([(1, TEXT)], "book_id bigint, text string")
        assert by_id(enrich.resolve_text_simple(annotations(spark, *self.CASES), text), "content") == self.WANT

    @pytest.mark.parametrize("salts", [1, 3])
    def test_chunk_form(self, spark, salts):
        chunks = spark.createDataFrame([(1, 0, 0, 7, TEXT[:7]), (1, 1, 7, 12, TEXT[7:])], "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        assert by_id(enrich.resolve_text(annotations(spark, *self.CASES), chunks, salts=salts), "content") == self.WANT

    def test_chunks_with_gaps_overlaps_and_wrong_lengths(self, spark):
        rows = [(1, 0, 2, 3, "abc"), (1, 1, 4, 9, "DE"), (1, 2, 20, 2, "😀z"), (1, 3, 21, 1, ""), (1, 4, 25, 1, "end")]
        chunks = spark.createDataFrame(rows, "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        assembled = books.assemble_text(chunks).first().text
        assert assembled == "  abcDE" + " " * 7 + "😀z" + " " * 3 + "end"
        spans = [(100 * a + b, a, b, "") for a in range(len(assembled) + 2) for b in range(a + 1, len(assembled) + 4)]
        simple = by_id(enrich.resolve_text_simple(annotations(spark, *spans), books.assemble_text(chunks)), "content")
        assert by_id(enrich.resolve_text(annotations(spark, *spans), chunks, salts=4), "content") == simple

    def test_a_span_meets_only_the_chunks_that_it_touches(self, spark):
        """Rows of the join are counted: one for each pair of span and chunk (with its gap) that share a character, however long the span."""
        rows = [(1, k, 10 * k + (k > 3), 10, "x" * 10) for k in range(8) if k != 5] + [(2, 0, 4, 1, "y")]
        chunks = spark.createDataFrame(rows, "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        numbered = books.numbered_chunks(chunks)
        spans = [(100 * a + b, book, a, b) for book in (1, 2, 3) for a in range(0, 90, 7) for b in (a + 1, a + 10, a + 35, 2**50 + a)]
        places = [(r.book_id, r.n, r.start - r.gap, r.end) for r in numbered.collect()]
        want = sorted((*s, n) for s in spans for book, n, lo, hi in places if book == s[1] and s[2] < hi and lo < s[3])
        frame = spark.createDataFrame(spans, "_key bigint, book_id bigint, _s bigint, _e bigint")
        popular = spark.createDataFrame([(1, 3)], "book_id bigint, streams int")
        for how in ({}, {"salts": 2}, {"popular": popular}):
            assert sorted(tuple(r) for r in enrich.touched_chunks(frame, numbered, **how).collect()) == want

    def test_texts_stay_out_of_the_lookup(self, spark):
        """The stream that finds chunks holds numbers only: a text is measured before anything is shuffled and goes no further."""
        chunks = spark.createDataFrame([(1, 0, 0, 3, "abc")], "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        frame = spark.createDataFrame([(1, 1, 0, 9)], "_key bigint, book_id bigint, _s bigint, _e bigint")
        plan = enrich.touched_chunks(frame, books.numbered_chunks(chunks))._jdf.queryExecution().optimizedPlan().toString()
        holding = [line for line in plan.splitlines() if "text#" in line]
        assert holding and all("length(text#" in line or "Filter" in line or "LogicalRDD" in line for line in holding)

    def test_an_end_far_beyond_the_book(self, spark):
        far = annotations(spark, (1, 9, 10**15, ""), (2, 10**15, 10**15 + 9, ""), (3, 0, 2**62, "[x]"))
        want = {1: "wide world", 2: "", 3: "[x] Hello wide world"}
        text = spark.createDataFrame([(1, TEXT)], "book_id bigint, text string")
        chunks = spark.createDataFrame([(1, 0, 0, 7, TEXT[:7]), (1, 1, 7, 12, TEXT[7:])], "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        assert by_id(enrich.resolve_text_simple(far, text), "content") == want
        assert by_id(enrich.resolve_text(far, chunks), "content") == want


class TestPlaces:
    def test_books_without_locations_and_other_columns(self, spark):
        places = spark.createDataFrame([(1, i + 1, i * 10 + 5) for i in range(4)], "book_id bigint, location int, char_offset bigint")
        rows = annotations(spark, (1, 14, 15, ""), (2, 0, 30, "")).withColumn("id", F.lit("mine")).withColumn("kind", F.lit("k"))
        both = rows.withColumn("book_id", F.when(F.col("event_id") == 1, 1).otherwise(2))
        got = by_id(enrich.assign_places(both, None, places, sparse=True), "location_start", "location_end", "id", "kind")
        assert got == {1: (1, 2, "mine", "k"), 2: (0, 30, "mine", "k")}

    def test_pages(self, spark):
        pages = spark.createDataFrame([(1, 0, "ix", 10), (1, 1, "1", 20), (1, 2, "2", 20), (1, 3, "3", 30)], "book_id bigint, ordinal int, label string, char_offset bigint")
        rows = annotations(spark, (1, 5, None, ""), (2, 10, None, ""), (3, 20, None, ""), (4, 29, 31, ""), (5, 999, None, ""), (6, None, None, ""))
        given = rows.withColumn("page", F.when(F.col("event_id") == 5, 77))
        assert by_id(enrich.assign_places(given, pages, None, salts=3), "page") == {1: None, 2: None, 3: 2, 4: 2, 5: 77, 6: None}

    def test_locations(self, spark):
        places = spark.createDataFrame([(1, i + 1, i * 10 + 5) for i in range(4)], "book_id bigint, location int, char_offset bigint")
        rows = annotations(spark, (1, 0, 4, ""), (2, 5, 14, ""), (3, 14, 15, ""), (4, 99, None, ""), (5, None, 15, ""))
        got = by_id(enrich.assign_places(rows, None, places), "location_start", "location_end")
        assert got == {1: (1, None), 2: (1, None), 3: (1, 2), 4: (4, None), 5: (None, 2)}

    def test_places_do_not_depend_on_partitions_or_salts(self, spark, sf_dir):
        rows, pages, places = fixtures.annotations(spark, sf_dir), fixtures.page_map(spark, sf_dir), fixtures.location_map(spark, sf_dir)
        once = by_id(enrich.assign_places(rows, pages, places), "page", "location_start", "location_end")
        assert by_id(enrich.assign_places(rows.repartition(7), pages, places, salts=5), "page", "location_start", "location_end") == once

    def test_a_popular_book_is_dealt_to_streams(self, spark):
        """Half of all rows in one book: counted, dealt to as many streams as they need, with the same result."""
        rows = spark.range(4000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 90 + 100).alias("book_id"), (F.col("id") * 37 % 1000).alias("char_start"), F.when(F.col("id") % 3 == 0, F.col("id") * 37 % 1000 + 40).alias("char_end"), F.lit(None).cast("int").alias("page"))
        books = rows.select("book_id").distinct()
        pages = books.select("book_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ordinal")).select("book_id", "ordinal", F.col("ordinal").cast("string").alias("label"), (F.col("ordinal") * 100).alias("char_offset"))
        places = books.select("book_id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("location")).select("book_id", "location", (F.col("location") * 20).alias("char_offset"))
        popular = enrich.popular_books(rows, per_stream=200)
        assert [tuple(r) for r in popular.collect()] == [(7, 14)]
        columns = ("page", "location_start", "location_end")
        once = by_id(enrich.assign_places(rows, pages, places, sparse=True), *columns)
        dealt = enrich.assign_places(rows, pages, places, sparse=True, popular=popular)
        assert by_id(dealt, *columns) == once
        streams = rows.join(popular, "book_id").groupBy(F.pmod(F.xxhash64("event_id"), "streams")).count().collect()
        assert len(streams) == 14 and max(r["count"] for r in streams) < 220

    def test_long_spans_are_cut_at_their_own_books(self, spark):
        chunks = spark.createDataFrame([(1, 0, 0, 3, "abc"), (1, 1, 10, 3, "xyz"), (2, 0, 0, 2, "no")], "book_id bigint, ordinal int, pid bigint, length bigint, text string")
        rows = annotations(spark, (1, 1, 2**60, ""), (2, 1, 2, "")).withColumn("book_id", F.lit(1).cast("bigint"))
        assert by_id(enrich.resolve_text(rows, chunks), "content") == {1: "bc xyz", 2: "b"}


class TestPairing:
    def test_best_suffix_and_missing_books(self, spark):
        files = spark.createDataFrame([(p,) for p in ("/a/B.mobi", "/a/B.azw3", "/a/B.pdf", "/c/B.kfx")], "path string")
        folders = spark.createDataFrame([("/a/B.sdr",), ("/b/B.sdr",)], "dir string")
        assert dict(enrich.pair_books(folders, files).select("dir", "book_file").collect()) == {"/a/B.sdr": "/a/B.azw3", "/b/B.sdr": None}

    @pytest.mark.parametrize(("dirs", "want"), [([None, "/a.sdr"], [None, "/x.kfx"]), ([None, None], ["/x.kfx", "/x.kfx"])])
    def test_override(self, spark, dirs, want):
        rows = spark.createDataFrame(list(enumerate(dirs)), "event_id bigint, sidecar_dir string")
        got = enrich.with_book(rows, spark.createDataFrame([], "dir string, book_file string"), "/x.kfx")
        assert [r.book_file for r in got.orderBy("event_id").collect()] == want


def export(spark, *rows):
    names = "book_title string, author string, clip_type string, page int, location_start bigint, location_end bigint, added_date string, content string, source_file string, file_ord string, kind_ord int, rec_ord bigint"
    return conform(spark.createDataFrame([(*r, "f", "f", 0, i) for i, r in enumerate(rows)], names))


ROWS = [
    ("B", "", "highlight", 14, 138, 139, "2026-02-08 13:46:58", "[yellow] text"),
    ("B", "X", "bookmark", 18, 186, None, "2026-02-08 13:50:57", "[dark_blue]"),
    ("A", "Y", "note", None, 0, 5, None, "say"),
    ("B", "", "highlight", None, None, None, "Monday, January 1, 2024 1:00:00 AM", ""),
    ("C", "", "last_position", None, 9, None, "", ""),
    ("B", "", "bookmark", 0, 3, 4, "2026-02-08 13:50:57", ""),
]


class TestRenders:
    def test_order(self, spark):
        got = order.order_annotations(export(spark, *ROWS)).select("rec_ord").collect()
        assert [r.rec_ord for r in got] == [2, 4, 0, 1, 5, 3]

    def test_markdown(self, spark):
        got = {r.book_title: r.document for r in render.render_markdown(export(spark, *ROWS)).collect()}
        assert got["A"] == "## A  \n*Y*\n\n**Note** (): say\n"
        assert got["C"] == "## C\n"
        assert got["B"] == (
            "## B\n\n> [yellow] text\n> *— p. 14 | loc. 138–139 | 2026-02-08 13:46:58*\n\n*Bookmark* (p. 18 | loc. 186 | 2026-02-08 13:50:57): [dark_blue]\n\n"
            "*Bookmark* (loc. 3–4 | 2026-02-08 13:50:57)\n\n> \n> *— Monday, January 1, 2024 1:00:00 AM*\n"
        )

    def test_text(self, spark):
        got = [r.block for r in render.render_text(export(spark, *ROWS)).orderBy("at").collect()]
        rule = "=" * 60
        assert got == [
            f"{rule}\nA\nby Y\n{rule}\n\nsay\n",
            f"{rule}\nB\n{rule}\n\n[HIGHLIGHT] Page 14  Loc 138-139  (2026-02-08 13:46:58)\n[yellow] text\n",
            "[BOOKMARK] Page 18  Loc 186  (2026-02-08 13:50:57)\n[dark_blue]\n",
            "[BOOKMARK] Loc 3-4  (2026-02-08 13:50:57)\n",
            "[HIGHLIGHT] (Monday, January 1, 2024 1:00:00 AM)\n",
        ]

    def test_a_title_may_head_several_runs(self, spark):
        rows = [(t, "", "note", None, None, None, d, "") for t, d in (("A", "2026-01-01 10:00:00"), ("B", "2026-01-01 10:30:00"), ("A", "2026-01-01 11:00:00"), ("A", "2026-01-02 09:00:00"))]
        got = render.text_runs(export(spark, *rows)).orderBy("rec_ord").select("run", "opens_run").collect()
        assert [tuple(r) for r in got] == [(1, True), (2, True), (3, True), (3, False)]

    @pytest.mark.parametrize("titles", [1, 2, 40])
    def test_runs_over_many_ranges(self, spark, titles):
        """Runs longer than a range, and ranges of many runs, against a walk over all rows; authors may be null."""
        import random

        r = random.Random(titles)
        rows, title = [], "T"
        for i in range(900):
            if r.random() < 0.02 * titles:
                title = f"T{r.randrange(titles)}"
            rows.append((title, r.choice(["X", "Y", "", None]), r.choice(["note", "note", "last_position"]), None, None, None, f"2026-01-{i // 40 + 1:02d} 10:00:00", ""))
        want, run, last = {}, 0, None
        for i, x in enumerate(rows):
            if x[2] == "last_position":
                continue
            opens = last is None or x[0] != last
            if opens:
                run, author = run + 1, x[1]
            want[i], last = (run, opens, author), x[0]
        got = {x.rec_ord: (x.run, x.opens_run, x.run_author) for x in render.text_runs(export(spark, *rows).repartition(5)).collect()}
        assert got == want

    def test_runs_are_not_brought_together(self, spark):
        plan = render.text_runs(export(spark, *ROWS))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(run" not in plan and "hashpartitioning(_range" in plan


class TestSinks:
    def test_json_leaves_absent_fields_out(self, spark, tmp_path):
        indexes = spark.createDataFrame([("", "g", 0, [1], "f")], "asin string, content_guid string, page_count bigint, page_offsets array<bigint>, source_file string")
        sinks.write_json(export(spark, *ROWS), indexes, f"{tmp_path}/out")
        read = lambda name: [json.loads(x) for f in sorted((tmp_path / "out" / name).glob("part-*")) for x in f.read_text().splitlines()]
        rows = read("annotations")
        assert len(rows) == 6 and rows[0] == {"book_title": "A", "author": "Y", "clip_type": "note", "location_start": 0, "location_end": 5, "content": "say", "source_file": "f"}
        assert read("page_indexes") == [{"asin": "", "content_guid": "g", "page_count": 0, "page_offsets": [1], "source_file": "f"}]
        assert read("manifest")[0]["total_clippings"] == 6

    def test_csv_quotes_and_spaces(self, spark, tmp_path):
        sinks.write_csv(export(spark, (' "T", x ', "", "note", None, 1, None, None, 'a "b"')), f"{tmp_path}/out")
        (line,) = [r for f in (tmp_path / "out").glob("part-*") for r in csv.DictReader(f.open())]
        assert (line["book_title"], line["content"], line["page"], line["added_date"]) == (' "T", x ', 'a "b"', "", "")

    def test_a_corpus_from_files_to_markdown(self, spark, tmp_path):
        """Paired and unpaired folders, clippings text in one of them, and a file that can't be read."""
        for name in ("One.sdr", "Two.sdr"):
            (tmp_path / "in" / name).mkdir(parents=True)
        entry = lambda title, place: f"{title} (A)\n- Your Highlight | Location {place}\n\n[yellow]\n==========\n"
        (tmp_path / "in" / "One.sdr" / "My Clippings.txt").write_text(entry("One", "5-9"))
        (tmp_path / "in" / "Two.sdr" / "My Clippings.txt").write_text(entry("Two", "5-9"))
        (tmp_path / "in" / "One.kfx").write_bytes(b"book")
        (tmp_path / "in" / "One.sdr" / "a.mbp").write_bytes(b"\x00\x01\x00\x01\x00\x04\x00\x00\x00\x07")
        (tmp_path / "in" / "Two.sdr" / "b.mbp").write_bytes(b"\x00\x01\x00\x01\x00\x04\x00\x00\x00\x07")
        (tmp_path / "in" / "Two.sdr" / ".b.mbp.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")  # a wrong checksum
        book = f"{tmp_path}/in/One.kfx"
        chunks = spark.createDataFrame([(book, 0, 0, 12, "some long te"), (book, 1, 12, 2, "xt")], "book_id string, ordinal int, pid bigint, length bigint, text string")
        pages = spark.createDataFrame([(book, 0, "1", 0), (book, 1, "2", 6)], "book_id string, ordinal int, label string, char_offset bigint")
        places = spark.createDataFrame([(book, 1, 0), (book, 2, 4), (book, 3, 8)], "book_id string, location int, char_offset bigint")
        found, indexes, failed = flow.annotate_corpus(spark, f"{tmp_path}/in", chunks, pages, places)
        got = sorted((r.book_title, r.clip_type, r.page, r.location_start, r.location_end, r.content) for r in found.collect())
        assert got == [("One", "highlight", 1, 2, 3, "[yellow] long"), ("Two", "highlight", None, 5, 9, "[yellow]"), ("a", "last_position", 2, 2, None, "")]
        assert [(r.source_file, r.format, r.reason) for r in failed.collect()] == [(f"{tmp_path}/in/Two.sdr/b.mbp", "mbp", "unreadable")]
        assert indexes.count() == 0
        sinks.write_markdown(found, f"{tmp_path}/md")
        assert "".join(f.read_text() for f in sorted((tmp_path / "md").glob("part-*"))) == "## One  \n*A*\n\n> [yellow] long\n> *— p. 1 | loc. 2–3*\n\n## a\n\n## Two  \n*A*\n\n> [yellow]\n> *— loc. 5–9*\n\n"

    def test_text_and_markdown_files(self, spark, tmp_path):
        sinks.write_markdown(export(spark, *ROWS), f"{tmp_path}/md")
        sinks.write_text(export(spark, *ROWS), f"{tmp_path}/txt")
        whole = lambda name: "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        assert whole("md").startswith("## A") and whole("md").index("## C") < whole("md").index("## B")
        assert whole("txt").count("=" * 60) == 4
        sinks.write_annotations(export(spark, *ROWS), f"{tmp_path}/table")
        assert spark.read.parquet(f"{tmp_path}/table").count() == 6

    def test_all_exports_from_one_sort(self, spark, tmp_path):
        """The files of all sinks are as those written one by one, and the counts are of the rows written."""
        rows = export(spark, *(r for i in range(40) for r in ROWS)).repartition(6)
        indexes = spark.createDataFrame([("", "g", 0, [1], "f")], "asin string, content_guid string, page_count bigint, page_offsets array<bigint>, source_file string")
        seen = sinks.write_all(rows, indexes, f"{tmp_path}/all")
        assert (seen["total"], seen["shown"], seen["books"]) == (240, 200, 3)
        sinks.write_json(rows, indexes, f"{tmp_path}/one/json")
        sinks.write_csv(rows, f"{tmp_path}/one/csv")
        sinks.write_markdown(rows, f"{tmp_path}/one/markdown")
        sinks.write_text(rows, f"{tmp_path}/one/text")
        for name in ("json/annotations", "json/page_indexes", "csv", "markdown", "text"):
            whole = lambda top: [x for f in sorted((tmp_path / top / name).glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("book_title,")]  # noqa: E731, B023
            assert whole("all") == whole("one"), name
        (manifest,) = [json.loads(x) for f in (tmp_path / "all" / "json" / "manifest").glob("part-*") for x in f.read_text().splitlines()]
        assert (manifest["total_clippings"], manifest["page_indexes"]) == (240, 1)

    def test_an_export_of_no_rows(self, spark, tmp_path):
        rows = export(spark, *ROWS).limit(0)
        indexes = spark.createDataFrame([], "asin string, content_guid string, page_count bigint, page_offsets array<bigint>, source_file string")
        assert sinks.write_all(rows, indexes, f"{tmp_path}/all")["total"] == 0


class TestStreams:
    def test_new_files_are_decoded(self, spark, tmp_path):
        from marginalia.streaming.files import stream_clippings, stream_sidecars

        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "My Clippings.txt").write_text("T (A)\n- Your Note | Location 4\n\nx\n==========\n")
        (tmp_path / "in" / "a.mbp").write_bytes(b"\x00\x01\x00\x01\x00\x04\x00\x00\x00\x07")
        for name, stream, want in (("c", stream_clippings(spark, f"{tmp_path}/in/*.txt"), ("T", 4)), ("s", stream_sidecars(spark, f"{tmp_path}/in"), ("a", 7))):
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").option("path", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination(90)
            assert [(r.book_title, r.location_start) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()] == [want]
