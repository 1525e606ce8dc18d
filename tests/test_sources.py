"""Readers on small files: each format, its traps, and a whole tree."""

from __future__ import annotations

import datetime
import random

import pytest

from marginalia.sources import clippings, corpus, page_index, plain_text, sidecar, sidecar_splits, typed


def be(n, size):
    return n.to_bytes(size, "big")


def keyed(key, *values):
    return b"\xfe" + be(len(key), 3) + key.encode() + b"".join(values) + b"\xff"


def text(b):
    b = b.encode() if isinstance(b, str) else b
    return b"\x03" + be(len(b), 3) + b


def decode(spark, reader, *contents, name="a.bin"):
    rows = [(f"/d/{i}/{name}", bytearray(c)) for i, c in enumerate(contents)]
    return reader(spark.createDataFrame(rows, "path string, content binary")).orderBy("source_file", "kind_ord", "rec_ord").collect()


def entries(spark, *values):
    rows = [(v, "/d/My Clippings.txt", "f", i) for i, v in enumerate(values)]
    return clippings.parse_entries(spark.createDataFrame(rows, "value string, source_file string, file_ord string, rec_ord bigint")).orderBy("rec_ord").collect()


class TestClippings:
    def test_all_fields(self, spark):
        (r,) = entries(spark, "﻿A Title (Part 1) (An Author)\r\n- Your Highlight on page 42 | Location 512-530 | Added on Monday, January 1, 2024 10:00:00 AM\r\n\r\nSome text \r\n\r\n more\r\n")
        assert (r.book_title, r.author, r.clip_type, r.page, r.location_start, r.location_end) == ("A Title (Part 1)", "An Author", "highlight", 42, 512, 530)
        assert r.added_date == "Monday, January 1, 2024 10:00:00 AM"
        assert r.added_ts == datetime.datetime(2024, 1, 1, 10)
        assert r.content == "Some text  more"

    def test_location_without_page_is_swallowed(self, spark):
        (r,) = entries(spark, "T\n- Your Note on Location 7-9 | Added on Monday, January 1, 2024 1:00:00 PM\n\nx")
        assert (r.location_start, r.location_end, r.author) == (None, None, "")
        assert r.added_ts == datetime.datetime(2024, 1, 1, 13)

    def test_page_range_loses_location_and_date(self, spark):
        (r,) = entries(spark, "T\n- Your Highlight on page 42-43 | Location 5 | Added on x\n\ny")
        assert (r.page, r.location_start, r.added_date) == (42, None, None)

    def test_short_and_unknown_entries_are_dropped(self, spark):
        assert entries(spark, "", "only one line", "T\n- Their Highlight\n", None) == []

    def test_case_and_unicode_space(self, spark):
        (r,) = entries(spark, "　T (A) \n-  your BOOKMARK | location 3\n \nx　")
        assert (r.book_title, r.author, r.clip_type, r.location_start, r.content) == ("T", "A", "bookmark", 3, "x")

    def test_files_are_cut_at_the_separator_only(self, spark, tmp_path):
        entry = "T (A)\n- Your Note | Location {}\n\nbody {}\n==========\n"
        (tmp_path / "My Clippings.txt").write_text("﻿" + "".join(entry.format(i, i) for i in range(200)) + "T\n- Your Note\nleft==========right\n- Your Bookmark\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            rows = clippings.read_clippings_text(spark, str(tmp_path)).orderBy("file_ord", "rec_ord").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.location_start for r in rows[:200]] == list(range(200))
        assert [(r.book_title, r.content) for r in rows[200:]] == [("T", "left"), ("right", "")]


class TestSidecar:
    marker = text(b"\x00\x01\x02\x03\x04")

    def highlight(self, *values, key="annotation.personal.highlight"):
        return keyed(key, *values)

    def test_layouts(self, spark):
        p, q = text("a:5"), text("a:9")
        data = b"x" * 16 + b"".join(
            [
                self.highlight(b"\x01\0\0\0\1", b"\x02" + be(1700000000000, 8), b"\x07\x02", p, q, self.marker, text("yellow")),
                self.highlight(p, q, text("notmarker"), text("z")),
                self.highlight(p, q, text("pink")),
                self.highlight(p, q, self.marker),
                self.highlight(p, q),
                self.highlight(p),
            ]
        )
        rows = decode(spark, sidecar.decode_annotations, data)
        assert [r.content for r in rows] == ["[yellow]", "notmarker", "[pink]", "", ""]
        assert {(r.location_start, r.location_end) for r in rows} == {(5, 9)}
        assert [r.added_date for r in rows] == ["2023-11-14 22:13:20", None, None, None, None]

    def test_order_is_by_kind_then_place(self, spark):
        p = text("a:5")
        data = keyed("annotation.personal.note", p, p, self.marker, text("n")) + keyed("annotation.personal.bookmark", p, p) + self.highlight(p, p)
        rows = decode(spark, sidecar.decode_annotations, data)
        assert [(r.clip_type, r.location_end, r.content) for r in rows] == [("highlight", None, ""), ("bookmark", None, ""), ("note", None, "n")]

    def test_bad_positions_times_and_bytes(self, spark):
        data = self.highlight(b"\x02" + be(2**64 - 1, 8), text("none"), text("a:-5"), text(b"\xff\xfe")) + self.highlight(b"\x02" + be(0, 8), text("a:1"), text("a:1"), b"\x03\xff\xff\xff")
        rows = decode(spark, sidecar.decode_annotations, data)
        assert [(r.location_start, r.location_end, r.added_date) for r in rows] == [(None, None, None), (1, None, None)]
        assert rows[0].content == "[��]"

    def test_record_end_inside_a_string_does_not_end_it(self, spark):
        (r,) = decode(spark, sidecar.decode_annotations, self.highlight(text("a:1"), text("a:2"), self.marker, text("cþÿ")))
        assert r.content == "[cþÿ]"

    def test_records_inside_payloads(self, spark):
        """Both the outer record and the inner ones are found, each read to its own end."""
        p, q = text("a:1"), text("a:2")
        inner = keyed("annotation.personal.bookmark", text("i:7"), text("i:7"))
        deep = self.highlight(p, q, self.marker, text(b"x" + self.highlight(text("j:3"), text("j:4"), self.marker, text(inner)) + inner), key="annotation.personal.note")
        rows = decode(spark, sidecar.decode_annotations, deep + inner)
        assert [(r.clip_type, r.location_start, r.location_end, len(r.content)) for r in rows] == [
            ("highlight", 3, 4, len(inner) + 2),
            ("bookmark", 7, None, 0),
            ("bookmark", 7, None, 0),
            ("bookmark", 7, None, 0),
            ("note", 1, 2, 1 + len(self.highlight(text("j:3"), text("j:4"), self.marker, text(inner))) + len(inner)),
        ]

    def test_random_bytes_equal_a_walk_from_every_place(self, spark):
        """Files glued from records, cut values, prefixes and single bytes, against a plain reader that starts at every place of a key."""
        keys = [k.encode() for k in sidecar.ANNOTATION_KEYS]
        heads = [b"\xfe" + be(len(k), 3) + k for k in keys]

        def walk(data, at):
            strings, time = [], None
            while at < len(data) and data[at] not in (0xFE, 0xFF):
                tag, at = data[at], at + 1
                if tag == 3:
                    size = int.from_bytes(data[at : at + 3], "big")
                    if at + 3 > len(data) or size > 65536 or at + 3 + size > len(data):
                        break
                    strings.append(data[at + 3 : at + 3 + size])
                    at += 3 + size
                elif tag in (1, 2):
                    width = 4 * tag
                    if at + width > len(data):
                        break
                    time = data[at : at + width] if tag == 2 and time is None else time
                    at += width
                elif tag == 7:
                    at += 1
            return strings, time

        rng = random.Random(5)
        pieces = [lambda: rng.choice(heads), lambda: text(rng.randbytes(rng.randrange(4))), lambda: b"\x03" + be(rng.choice([1, 7, 40, 90, 65537]), 3), lambda: rng.choice([b"\x01", b"\x02", b"\x07", b"\xff", b"\x03\0", b"\x00"]), lambda: rng.randbytes(3)]
        files = [b"".join(rng.choice(pieces)() for _ in range(rng.randrange(40))) for _ in range(150)]
        frame = spark.createDataFrame([(str(i), bytearray(f)) for i, f in enumerate(files)], "path string, content binary")
        got = sorted((int(r.path), r.rec_ord, r.key, [bytes(x) for x in r.strings], r.time and bytes(r.time)) for r in sidecar.records(frame, list(sidecar.ANNOTATION_KEYS)).collect())
        want = []
        for i, data in enumerate(files):
            places = sorted((m, h) for h in heads for m in range(len(data)) if data.startswith(h, m))
            want += [(i, h[4:].decode(), *walk(data, m + len(h))) for m, h in places]
        assert [(i, key, strings, time) for i, _, key, strings, time in got] == want
        assert len(want) > 500

    @staticmethod
    def glued(seed, n, size):
        """Files glued from records, cut values, prefixes, marks and single bytes."""
        heads = [b"\xfe" + be(len(k), 3) + k.encode() for k in sidecar.ANNOTATION_KEYS]
        rng = random.Random(seed)
        pieces = [
            lambda: rng.choice(heads),
            lambda: text(rng.randbytes(rng.randrange(4))),
            lambda: b"\x03" + be(rng.choice([1, 7, 40, 90, 400, 5000, 65537]), 3),
            lambda: rng.choice([b"\x01", b"\x02", b"\x07", b"\xff", b"\x03\0", b"\x00", b"\xfe", b"\xfe\0", b"\xfe\0\0", heads[0][3:]]),
            lambda: rng.randbytes(3),
        ]
        return [b"".join(rng.choice(pieces)() for _ in range(rng.randrange(size))) for _ in range(n)]

    @pytest.mark.parametrize("split", [5, 61, 1 << 20])
    def test_records_of_splits_equal_those_of_whole_files(self, spark, tmp_path, split):
        """Whatever splits the files are read in, marks across their edges, at both ends of a file and inside values included."""
        files = [*self.glued(7, 40, 60), b"", b"\xfe\0\0", b"x", b"\xef\xbb\xbf" + self.glued(8, 1, 60)[0], self.glued(9, 1, 2)[0] + b"".join(self.glued(10, 20, 60))]
        note = b"\xfe" + be(24, 3) + b"annotation.personal.note"
        files += [note + b"\x03" + be(3, 3) + b"\xfe\0\0", note + b"\x03" + be(4, 3) + b"\xfe\0\0", b"\xef\xbb\xbf" + note + b"\x03" + be(99, 3) + b"\xfe\0\0", note[3:] + note + text(note * 300) * 3]
        for i, data in enumerate(files):
            (tmp_path / f"{i}.yjr").write_bytes(data)
        keys = list(sidecar.ANNOTATION_KEYS)
        row = lambda r: (r.path, r.key, [bytes(x) for x in r.strings], r.time and bytes(r.time))
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            cut = sidecar_splits.saved(sidecar_splits.read_pieces(spark, str(tmp_path), "*.yjr"), "pieces")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
            spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
        pieces, unread = sidecar_splits.placed(cut)
        got = [row(r) for r in sidecar_splits.split_records(pieces, keys).orderBy("path", "rec_ord").collect()]
        want = [row(r) for r in sidecar.records(sidecar.read_files(spark, str(tmp_path), "*.yjr"), keys).orderBy("path", "rec_ord").collect()]
        assert got == want and len(want) > 300
        assert unread.count() == 0
        assert (cut.select("path", "split").distinct().count() > 60) == (split < 100)

    def test_one_long_file_is_read_by_several_tasks(self, spark, tmp_path):
        """Many records in one file: as many as there are, in order, from several splits, through the scan too."""
        (tmp_path / "a.yjr").write_bytes(b"".join(keyed("annotation.personal.note", text(f"a:{i}"), text(f"a:{i}"), text(b"12345"), text(f"n {i}" * 20)) for i in range(9000)))
        (tmp_path / "b.yjf").write_bytes(b"-" * 300_000 + keyed("lpr", text("a:77")))
        (tmp_path / "c.yjf").write_bytes(b"-" * 300_000)
        (tmp_path / "d.yjr").write_bytes(keyed("annotation.personal.bookmark", text("a:5"), text("a:5")))
        (tmp_path / "bad.yjr").write_bytes(b"x" * 400_000)
        (tmp_path / ".bad.yjr.crc").write_bytes(b"crc\x00" + be(512, 4) + be(0, 4) * 800)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            found, _, failed = corpus.scan_corpus(spark, str(tmp_path), long=200_000)
            rows = found.orderBy("source_file", "kind_ord", "rec_ord").collect()
            assert sidecar_splits.read_pieces(spark, str(tmp_path), "a.yjr").select("split").distinct().count() > 10
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.location_start for r in rows] == [*range(9000), 77, 5]
        assert rows[8999].content == "n 8999" * 20
        assert [tuple(r) for r in failed.collect()] == [(str(tmp_path / "bad.yjr"), "yjr", "unreadable")]

    def test_no_long_files(self, spark, tmp_path):
        (tmp_path / "a.txt").write_bytes(b"x")
        assert sidecar_splits.read_split_annotations(spark, str(tmp_path)).collect() == []

    def test_last_position(self, spark):
        data = keyed("lpr", b"\x01\0\0\0\2", text(b"\xc3\x28:7"), text("no"), text("AT:77"), b"\x02" + be(1700000000000, 8)) + keyed("lpr", text("none"))
        (r,) = decode(spark, sidecar.decode_last_positions, data)
        assert (r.clip_type, r.location_start, r.added_date) == ("last_position", 77, "2023-11-14 22:13:20")

    def test_empty_files(self, spark):
        assert decode(spark, sidecar.decode_annotations, b"", b"\xfe") == []


class TestTyped:
    def record(self, kind, payload):
        return be(kind, 2) + be(len(payload), 2) + payload

    def test_types_strings_and_short_payloads(self, spark):
        label = "héllo 😀"
        utf16 = label.encode("utf-16-le")
        data = b"\x00\x01" + b"".join(
            [
                self.record(1, be(11, 4)),
                self.record(2, be(12, 4) + be(len(utf16) // 2, 2) + utf16),
                self.record(3, be(1, 4) + be(1, 4)),
                self.record(4, be(2, 4) + be(9, 4) + b"\x03abc"),
                self.record(4, be(2, 4) + be(9, 4) + b"\x00"),
                self.record(3, be(1, 4)),
                self.record(7, be(1, 4)),
                be(2, 2) + be(99, 2) + be(5, 4),
            ]
        )
        rows = decode(spark, typed.decode_records, data)
        assert [(r.clip_type, r.location_start, r.location_end, r.content) for r in rows] == [
            ("last_position", 11, None, ""),
            ("bookmark", 12, None, label),
            ("highlight", 1, 1, ""),
            ("note", 2, 9, "abc"),
            ("note", 2, 9, ""),
            ("bookmark", 5, None, ""),
        ]

    def test_headerless_file_that_starts_with_type_one_is_misread(self, spark):
        assert decode(spark, typed.decode_records, self.record(1, be(11, 4))) == []
        (r,) = decode(spark, typed.decode_records, self.record(3, be(1, 4) + be(2, 4)))
        assert r.location_end == 2

    def test_unpaired_surrogate_is_replaced(self, spark):
        (r,) = decode(spark, typed.decode_records, b"\x00\x01" + self.record(2, be(1, 4) + be(1, 2) + b"\x00\xd8"))
        assert r.content == "�"

    def test_container_and_many_records(self, spark):
        many = b"\x00\x02" + self.record(1, be(3, 4)) * 1300
        rows = decode(spark, typed.decode_records, b"BOOKMOBI" + many, many)
        assert len(rows) == 1300 and {r.source_file for r in rows} == {"/d/1/a.bin"}


class TestPageIndex:
    def file(self, version, meta, *words, count=True):
        head = be(version, 4)[::-1] + be(8 + len(meta), 4)[::-1] + meta
        return head + (be(len(words), 4)[::-1] if count else b"") + b"".join(be(w, 4)[::-1] for w in words)

    def rows(self, spark, *contents):
        data = [(f"/d/{i}.apnx", bytearray(c)) for i, c in enumerate(contents)]
        return page_index.decode_page_indexes(spark.createDataFrame(data, "path string, content binary")).orderBy("source_file").collect()

    def test_counts_and_metadata(self, spark):
        a, b, c, d, e = self.rows(
            spark,
            self.file(1, b'  {"asin":"B1","contentGuid":"g","pageCount":7}\x00', 100001, 200),
            self.file(2, b'{"asin":"B2"}', 5, 6, 7),
            self.file(3, b'{"asin":"B3"}', 5),
            self.file(1, b"{bad json", 100000, 100001, count=False),
            self.file(1, b'{"pageCount":0}', 99999, count=False) + b"\x01",
        )
        assert (a.asin, a.content_guid, a.page_count, a.page_offsets) == ("B1", "g", 7, [100001, 200])
        assert (b.asin, b.page_count, b.page_offsets) == ("B2", 3, [5, 6, 7])
        assert (c.asin, c.page_count, c.page_offsets) == ("", 1, [5])
        assert (d.asin, d.page_count, d.page_offsets) == ("", 0, [100000, 100001])
        assert (e.page_count, e.page_offsets) == (99999, [])

    def test_short_files_are_left_out(self, spark):
        assert self.rows(spark, b"1234567") == []


class TestPlainText:
    #: Line ends of all kinds, byte order marks, bad bytes, characters outside the first plane, one long line, nothing.
    FILES = {
        "a": "one\ntwo\r\nthree\rfour\r\r\n\n\nend".encode(),
        "b": b"\xef\xbb\xbf" + "first\nlast\n".encode(),
        "c": b"\xef\xbb\xbf" + "first\nlast".encode(),
        "d": b"bad \xff\xe2\x82\n\xf0\x9f\x98 and \xf0\x9f\x98\x80",
        "e": ("😀x" * 900 + "\n" + "line\n" * 300 + "z" * 777).encode(),
        "f": b"\n\n\n",
        "g": b"ends in\r",
        "h": b"x",
        "i": b"",
        "j, 100% + é": "name with signs\r\n".encode(),
    }

    @pytest.mark.parametrize(("split", "size"), [(7, 5), (64, 1), (1 << 20, 1000)])
    def test_chunks_equal_slices_of_the_whole_text(self, spark, tmp_path, split, size):
        """Whatever splits the files are read in: the text is what Python reads, cut at the multiples of the size."""
        want = []
        for name, data in self.FILES.items():
            path = tmp_path / f"{name}.txt"
            path.write_bytes(data)
            text = path.read_text(encoding="utf-8", errors="replace")
            want += [(str(path), k, k * size, len(text[k * size : (k + 1) * size]), text[k * size : (k + 1) * size]) for k in range(-(-len(text) // size))]
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            chunks, unread = plain_text.read_books(spark, str(tmp_path), size=size)
            n_splits = plain_text.split_starts(plain_text.read_lines(spark, str(tmp_path))).groupBy("book_id").count().agg({"count": "max"}).first()[0]
            assert sorted(tuple(r) for r in chunks.collect()) == sorted(want)
            assert unread.count() == 0
            assert (n_splits > 20) == (split < 100)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
            spark.conf.set("spark.sql.files.openCostInBytes", kept[1])

    def test_a_file_that_cannot_be_read_to_its_end_is_left_out(self, spark, tmp_path):
        (tmp_path / "good.txt").write_bytes(b"fine\n")
        (tmp_path / "bad.txt").write_bytes(b"line of a text\n" * 2000)
        (tmp_path / ".bad.txt.crc").write_bytes(b"crc\x00" + be(512, 4) + be(0, 4))
        chunks, unread = plain_text.read_books(spark, str(tmp_path))
        assert [r.text for r in chunks.collect()] == ["fine\n"]
        assert [r.path for r in unread.collect()] == [str(tmp_path / "bad.txt")]

    def test_a_folder_without_texts(self, spark, tmp_path):
        (tmp_path / "a.kfx").write_bytes(b"x")
        chunks, unread = plain_text.read_books(spark, str(tmp_path))
        assert chunks.collect() == [] and unread.collect() == []


class TestCorpus:
    @pytest.mark.parametrize(
        ("path", "kind"),
        [("/a/My Clippings.TXT", "clippings"), ("/a/old-clippings.txt", "clippings"), ("/a/clippings.doc", None), ("/a/notes.txt", None), ("/a/b.YJR", "yjr"), ("/a/b.yjr.bad_file", None), ("/a/b.Mbp", "mbp"), ("/a/.yjf", None)],
    )
    def test_route(self, spark, path, kind):
        from pyspark.sql import functions as F

        assert spark.createDataFrame([(path,)], "path string").select(corpus.route(F.col("path"))).first()[0] == kind

    def test_titles(self, spark):
        paths = ["/x/A - B.sdr/h.yjr", "/x/A - B.sdr/deep/n.mbp", "/x/C.SDR/h.yjf", "/x/D.sdr/n.mbp", "/x/plain.mbp"]
        got = dict(corpus.titles(spark.createDataFrame([(p,) for p in paths], "path string")).collect())
        assert got == {paths[0]: "A - B", paths[1]: "A - B", paths[2]: "C.SDR", paths[3]: "n", paths[4]: "plain"}

    def test_scan_of_a_tree(self, spark, tmp_path):
        book = tmp_path / "My Book.sdr"
        book.mkdir()
        (book / "hash.yjr").write_bytes(keyed("annotation.personal.note", text("a:1"), text("a:1"), text(b"12345"), text("hello")))
        (book / "hash.yjf").write_bytes(keyed("lpr", text("a:2")))
        (book / "old.mbp").write_bytes(b"\0\1" + be(1, 2) + be(4, 2) + be(3, 4))
        (tmp_path / "bad.mbp").write_bytes(b"BOOKMOBI....")
        (tmp_path / "bad.apnx").write_bytes(b"1")
        (tmp_path / "My Clippings.txt").write_text("T (A)\n- Your Bookmark | Location 4\n")
        (tmp_path / "notes.txt").write_text("T (A)\n- Your Bookmark | Location 5\n")
        annotations, indexes, bad = corpus.scan_corpus(spark, str(tmp_path))
        assert sorted((r.book_title, r.location_start, r.sidecar_dir is not None) for r in annotations.collect()) == [("My Book", 1, True), ("My Book", 2, True), ("My Book", 3, True), ("T", 4, False)]
        assert indexes.count() == 0
        assert sorted((r.format, r.reason) for r in bad.collect()) == [("apnx", "page index too short"), ("mbp", "container format")]

    def tree(self, tmp_path):
        """Files of all formats, three of which fail: at once, or after some hundred kilobytes."""
        import zlib

        book = tmp_path / "A + B.sdr"
        book.mkdir()
        entry = lambda i: f"T {i} (A)\n- Your Bookmark | Location {i}\n==========\n"
        long = "".join(entry(i) for i in range(9000)).encode()
        (book / "My Clippings.txt").write_text("\ufeff" + entry(4) + entry(5))
        (book / "old clippings.txt").write_bytes(long)
        (tmp_path / "good clippings.txt").write_bytes(long[:-11])
        sums = [zlib.crc32(long[i : i + 512]) for i in range(0, len(long), 512)]
        sums[400:] = [0] * len(sums[400:])
        (book / ".old clippings.txt.crc").write_bytes(b"crc\x00" + be(512, 4) + b"".join(be(x, 4) for x in sums))
        bad = b"crc\x00" + be(512, 4) + be(0, 4)
        for name, content in (("a.yjr", keyed("annotation.personal.note", text("a:1"), text("a:1"), text(b"12345"), text("hello"))), ("a.mbp", b"\0\1" + be(1, 2) + be(4, 2) + be(3, 4)), ("a.apnx", TestPageIndex().file(1, b'{"asin":"B"}', 7)), ("a.yjf", b"no record")):
            (book / name).write_bytes(content)
            (tmp_path / f"bad {name}").write_bytes(content)
            (tmp_path / f".bad {name}.crc").write_bytes(bad)
        return tmp_path

    def test_files_that_fail_do_not_end_the_scan(self, spark, tmp_path):
        root = self.tree(tmp_path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            found, indexes, failed = corpus.scan_corpus(spark, str(root))
            got = [(r.book_title, r.clip_type, r.location_start) for r in found.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(x for x in got if x[1] != "bookmark") == [("A + B", "last_position", 3), ("A + B", "note", 1)]
        assert sorted(x[2] for x in got if x[1] == "bookmark") == sorted([4, 5, *range(9000)])
        assert [(r.asin, r.source_file) for r in indexes.collect()] == [("B", f"{root}/A + B.sdr/a.apnx")]
        want = [(f"{root}/A + B.sdr/old clippings.txt", "clippings", "unreadable"), *((f"{root}/bad a.{k}", k, "unreadable") for k in ("apnx", "mbp", "yjf", "yjr"))]
        assert sorted(map(tuple, failed.collect())) == want

    def test_contents_are_read_once(self, spark, tmp_path):
        """After the scan, nothing that it returns opens a file of the tree."""
        for df in corpus.scan_corpus(spark, str(self.tree(tmp_path))):
            scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in x or "FileScan text" in x]
            assert all("content#" not in x and "FileScan text" not in x for x in scans)

    def test_cut_files_name_every_outcome(self, spark):
        rows = [("/x.yjr", bytearray(b"nothing")), ("/x.mbp", bytearray(b"BOOKMOBI")), ("/x.apnx", bytearray(b"12345678")), ("/y.apnx", bytearray(b"1")), ("/y.yjf", bytearray(keyed("lpr", text("a:2"))))]
        got = {r.path: (r.outcome, r.reason, r.key) for r in corpus.cut_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
        assert got == {"/x.yjr": ("nothing", None, None), "/x.mbp": ("failures", "container format", None), "/x.apnx": ("page_indexes", None, "apnx"), "/y.apnx": ("failures", "page index too short", None), "/y.yjf": ("annotations", None, "lpr")}
        assert {x[0] for x in got.values()} == set(corpus.OUTCOMES)
