"""Trees of many small files: few tasks, nothing opened in vain, and the rows that readers of splits give."""

from __future__ import annotations

import types
import zlib

import pytest

from marginalia.operators import books, flow
from marginalia.sources import clippings, corpus, files, plain_text, sidecar_splits

ODD = {
    "plain": b"a\nb\n",
    "open": b"a\nb",
    "blank": b"\n\n",
    "returns": b"a\r\nb\rc\n\rd\r",
    "mark": b"\xef\xbb\xbfa\r\nb\n",
    "mark inside": b"a\xef\xbb\xbfb",
    "wrong": b"a\xe2\x82\nb\xff\r\nc\xe2",
    "wide": "\U0001f600€\n".encode() * 9,
    "fe": b"\xfe\x00\x00a\xfe\x00\x00\xfe\x00\x00",
    "fe open": b"x\xfe\x00\x00y\xfe\x00",
    "cut": b"=" * 31 + b"\n" + b"=" * 10,
    "mark and cut": b"\xef\xbb\xbf\xff a" + b"=" * 10 + b"b",
    "empty": b"",
}


@pytest.fixture
def odd(tmp_path):
    for name, data in ODD.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    return str(tmp_path)


def values(df, *columns):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect())


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.yjr").write_bytes(b"x" * (i % 7 + 1))
    found = files.read_files(spark, str(tmp_path), "*.yjr")
    assert found.count() == 400
    assert found.rdd.getNumPartitions() <= 6


def test_directories_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.sdr").mkdir()
        (tmp_path / f"{i}.sdr" / "a.yjr").write_bytes(b"x")
    assert files.list_files(spark, str(tmp_path)).count() == 40
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 64


def test_only_files_of_the_name_are_opened(spark, tmp_path):
    (tmp_path / "a b.yjr").write_bytes(b"12")
    (tmp_path / "c.txt").write_bytes(b"3")
    found = files.tree(spark, str(tmp_path))
    assert values(found.filter(files.named("*.[yY][jJ][rR]")), "path", "content") == [(f"{tmp_path}/a b.yjr", b"12")]
    assert values(files.listed(found), "path", "length") == [(f"{tmp_path}/a b.yjr", 2), (f"{tmp_path}/c.txt", 1)]


def test_pieces_of_short_files_equal_those_of_splits(spark, odd):
    got = sidecar_splits.read_pieces(spark, odd, "*.txt")
    want = sidecar_splits._split_pieces(spark, odd, "*.txt", -1)
    assert values(got, "path", "file_bytes", "split", "piece") == values(want, "path", "file_bytes", "split", "piece")
    assert len({(r.path, r.within) for r in got.collect()}) == got.count()


def test_entries_of_short_files_equal_those_of_splits(spark, odd):
    got = clippings.read_entries(spark, odd)
    want = clippings._split_entries(spark, odd, None, -1)
    assert values(got.selectExpr("cast(value as binary) v", "source_file"), "source_file", "v") == values(want.selectExpr("cast(value as binary) v", "source_file"), "source_file", "v")


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_chunks_of_short_books_equal_those_of_splits_and_shuffle_no_text(spark, odd, size):
    chunks, unread = plain_text.read_books(spark, odd, size=size)
    want, want_unread = plain_text.long_books(spark, odd, plain_text.TEXT, size, files.list_files(spark, odd))
    columns = ("book_id", "ordinal", "pid", "length", "text")
    assert values(chunks, *columns) == values(want, *columns)
    assert values(unread, "path") == values(want_unread, "path") == []
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_a_book_that_is_a_byte_order_mark_alone_is_unread(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf")
    chunks, unread = plain_text.read_books(spark, str(tmp_path))
    assert chunks.count() == 0
    assert values(unread, "path") == [(f"{tmp_path}/a.txt",)]


NAMES = ("a b.txt", "100% + é.txt", "[x]{y}*?.txt", "_left.txt", "_kept=1.txt", ".left.txt", "left._COPYING_", "none.txt", "sub/c.txt", "sub/deep.sdr/d.TXT", "_out/e.txt", ".out/f.txt", "_metadata/g.txt")


@pytest.fixture
def names(tmp_path):
    for i, x in enumerate(NAMES):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_bytes(b"x" * (x != "none.txt") * (i + 1))
    (tmp_path / "nowhere.txt").symlink_to(tmp_path / "missing")
    return tmp_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("glob", [None, "*.txt", "*.{[tT][xX][tT]}", "?.*"])
def test_a_tree_listed_by_tasks_is_the_one_that_spark_lists(spark, names, glob):
    for path in (str(names), [f"{names}/sub", f"{names}/s*", f"{names}/a b.txt"], f"{names}/_left.txt"):
        got, want = files.listing(spark, path, glob), files.tree(spark, path, glob)
        assert values(got, "path", "length", "file_size") == values(want, "path", "length", "file_size")
        assert all(r.path.endswith(f"/{r.file_name}") for r in got.collect())
        assert values(files.contents(got), "path", "length", "content") == values(want, "path", "length", "content")


def test_names_of_files_are_not_in_the_driver(spark, names):
    """Spark's own reader holds the names and sizes of all files of a tree in the driver; so did the listing."""
    assert "binaryFile" not in plan(files.list_files(spark, str(names)))
    assert "binaryFile" not in plan(files.read_files(spark, str(names), "*.txt"))


def test_a_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listing(spark, f"{tmp_path}/missing")


def test_files_are_held_against_their_checksums(spark, tmp_path):
    data = bytes(range(256)) * 5
    sums = lambda step, n: b"crc\x00" + step.to_bytes(4, "big") + b"".join(zlib.crc32(data[i : i + step]).to_bytes(4, "big") for i in range(0, len(data), step))[: 4 * n]
    held = {"right": sums(512, 3), "odd step": sums(7, 999), "more": sums(512, 3) + b"1234", "wrong": sums(512, 2) + b"1234", "no sums": b"abc\x00" + sums(512, 1)[4:], "cut head": b"crc\x00\x00", "empty": b""}
    for x, c in (held | {"short": sums(512, 2), "none": None}).items():
        (tmp_path / f"{x}.yjr").write_bytes(data)
        if c is not None:
            (tmp_path / f".{x}.yjr.crc").write_bytes(c)
    got = files.contents(files.listing(spark, str(tmp_path)))
    want = files.read(files.tree(spark, str(tmp_path))).filter("length(content) = length")  # Spark gives what comes before the end of the sums
    assert values(got, "path", "length", "content") == values(want, "path", "length", "content")
    assert {r.path.rpartition("/")[2] for r in got.collect()} == {f"{x}.yjr" for x in ("right", "odd step", "more", "no sums", "cut head", "empty", "none")}


def test_long_files_are_found_by_name(spark, tmp_path):
    """Splits of long files are read without listing what else is in the tree, whatever signs are in their names."""
    (tmp_path / "[a]{b}*?+ %41.yjr").write_bytes(b"x" * 100 + sidecar_splits.MARK + b"y")
    (tmp_path / "a.yjr").write_bytes(b"z")
    found = files.listing(spark, str(tmp_path))
    paths, glob = files.by_name(found.filter("file_size > 50"), str(tmp_path), "*.yjr")
    assert len(paths) == 1
    assert values(sidecar_splits._split_pieces(spark, paths, glob, 50), "path", "piece") == [(f"{tmp_path}/[a]{{b}}*?+ %41.yjr", b"x" * 100), (f"{tmp_path}/[a]{{b}}*?+ %41.yjr", b"y")]


def test_a_store_that_only_spark_opens(spark, odd, monkeypatch):
    columns = ("book_id", "ordinal", "pid", "length", "text")
    want = values(plain_text.read_books(spark, odd, size=3)[0], *columns)
    monkeypatch.setattr(files, "LOCAL", ())
    assert "content" in files.listing(spark, odd).columns
    assert values(plain_text.read_books(spark, odd, size=3)[0], *columns) == want
    assert [x.count() for x in corpus.scan_corpus(spark, odd)] == [0, 0, 0]


def test_a_store_of_arrow(names, monkeypatch):
    """Lists and reads in this process, as a task does, from what stands for another store."""
    import pyarrow as pa
    from pyarrow import fs

    monkeypatch.setattr(fs, "FileSystem", types.SimpleNamespace(from_uri=lambda uri: (fs.LocalFileSystem(), uri.removeprefix("else://host"))))
    batch = lambda **columns: [pa.RecordBatch.from_pydict(columns)]
    found = lambda uri: {x: n for b in files._lister()(batch(uri=[uri])) for x, n in zip(*b.to_pydict().values(), strict=True)}
    assert found(f"else://host{names}") == {f"else://host{x[5:]}": n for x, n in found(f"file:{names}").items() if "nowhere" not in x}
    assert found(f"else://host{names}/a b.txt") == {f"else://host{names}/a b.txt": 1}
    (got,) = files._reader(1 << 20)(batch(path=["p", "gone"], length=[1, 1], uri=[f"else://host{names}/a b.txt", f"else://host{names}/gone"]))
    assert got.to_pydict() == {"path": ["p"], "length": [1], "content": [b"x"]}


def test_names_of_books_are_not_in_the_driver(spark, odd):
    for df in plain_text.read_books(spark, odd):
        assert "binaryFile" not in plan(df)


def test_texts_of_books_are_read_once(spark, tmp_path):
    """Chunks are kept and what has none is unread: nothing is read again afterwards. Texts without a book are looked at too."""
    for x in ("a.kfx", "b.azw3", "e.kfx"):
        (tmp_path / x).write_bytes(b"x")
    for x in "abcd":
        (tmp_path / f"{x}.txt").write_bytes(f"text {x}".encode())
    (tmp_path / "e.txt").write_bytes(b"\xef\xbb\xbf")
    for x in "bd":
        (tmp_path / f".{x}.txt.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")
    found = files.listing(spark, str(tmp_path))
    chunks, unread = flow.text_chunks(spark, str(tmp_path), files.listed(found), found)
    (tmp_path / "a.txt").write_bytes(b"other")
    assert values(chunks, "book_id", "ordinal", "pid", "length", "text") == [(f"{tmp_path}/a.kfx", 0, 0, 6, "text a")]
    assert values(unread, "path") == [(f"{tmp_path}/{x}.txt",) for x in "bde"]


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_chunks_of_texts_are_numbered_without_a_window(spark, odd, size):
    chunks, _ = plain_text.read_books(spark, odd, size=size)
    got, want = plain_text.numbered(chunks), books.numbered_chunks(chunks)
    assert dict(got.dtypes) == dict(want.dtypes)
    columns = ("book_id", "ordinal", "n", "gap", "start", "end", "text")
    assert values(got, *columns) == values(want, *columns)
    assert "Window" not in plan(got)
