"""Trees of files, from a few huge ones to a great many small ones: listed once, by tasks, and small files read as rows."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import local_path, name
from marginalia.sources.storage import new_path

#: Files of up to so many bytes are a row each, also where longer ones are read in splits, if a split is as long.
SHORT = 1 << 20
#: What opening a file costs, as bytes read: tasks take a few thousand small files each. With Spark's 4 MB they take 32 at most.
OPEN_COST = 1 << 15
#: Directories are listed by so many tasks for each core. Spark makes a task of each, up to 10,000.
LISTING = 4
#: A task lists so many directories, or reads so many small files, and has rows of so many bytes in hand.
FOLDERS, FILES, HELD = 1 << 11, 1 << 11, 1 << 22
#: The local file systems that hold files against checksums: Hadoop's, and Hive's around it.
LOCAL = ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem")
_BYTE_ORDER_MARK = "ï»¿"


def configure(spark: SparkSession) -> None:
    """Session settings for many small files; settings that are lower already stay."""
    conf = spark._jsparkSession.sessionState().conf()
    if conf.filesOpenCostInBytes() > OPEN_COST:
        spark.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    tasks = max(32, LISTING * spark.sparkContext.defaultParallelism)
    if conf.parallelPartitionDiscoveryParallelism() > tasks:
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks)


def short(spark: SparkSession) -> int:
    """The most bytes of a file that is a row instead of splits: such a file is one split at most anyway."""
    return min(SHORT, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def tree(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length, content, file_name, file_size) of the files below ``path`` that are not empty, listed here and once, however often the rows are used.

    Only files that pass all conditions on file_name and file_size (their names and lengths again, known before a file is opened) are opened,
    and only where content is asked for; unreadable files are left out then.
    """
    configure(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.select(local_path(F.col("path")).alias("path"), "length", "content", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"))


def listing(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length, file_name, file_size, uri) of the files below ``path`` that are not empty, as ``tree`` finds them, kept in the shared folder.

    Directories are listed by tasks, level by level, and neither names nor sizes pass through the driver, however many there are; a directory is one task's, as
    a stream. A store that can't be opened in Python is listed by Spark, in the driver: then this is the ``tree``.
    """
    configure(spark)
    roots = _roots(spark, path)
    if not all(_opens(spark, root) for root in roots):
        return tree(spark, path, glob)
    place, found, schema = new_path(spark, "listing"), [], "path string, length bigint, file_name string, uri string"
    folders = spark.createDataFrame([(root,) for root in dict.fromkeys(roots)], "uri string")
    while not found or (n := folders.count()):
        if found:
            folders = folders.repartition(-(-n // FOLDERS), "uri")
        below = folders.mapInArrow(_lister(), "uri string, length bigint").repartition("uri")  # as one directory may hold most files
        below.select(local_path(F.col("uri")).alias("path"), "length", name(F.col("uri")).alias("file_name"), "uri").write.parquet(into := f"{place}/{len(found)}")
        found.append(into)
        folders = spark.read.schema(schema).parquet(into).filter("length is null").select("uri")
    every = spark.read.schema(schema).parquet(*found).filter("length > 0")
    if len(roots) > 1:
        every = every.distinct()
    files = every.select("path", "length", "file_name", F.col("length").alias("file_size"), "uri")
    return files.filter(F.col("file_name").rlike(_pattern(spark, glob))) if glob else files


def _roots(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files and directories that ``path`` names, its wildcards resolved, as Spark's readers do it and with their errors."""
    jvm = spark.sparkContext._jvm
    paths = jvm.PythonUtils.toSeq([path] if isinstance(path, str) else list(path))
    source = getattr(getattr(jvm.org.apache.spark.sql.execution.datasources, "DataSource$"), "MODULE$")
    found = source.checkAndGlobPathIfNecessary(paths, spark._jsparkSession.sessionState().newHadoopConf(), True, True, 8, True)
    return [found.apply(i).toString() for i in range(found.size())]


def _opens(spark: SparkSession, root: str) -> bool:
    """Whether tasks can open ``root`` in Python as Hadoop does: a local file system with checksums, or a store that Arrow knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if root.startswith("file:"):
        return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getClass().getName() in LOCAL
    try:
        store, at = _arrow_store()(root)
        return store.get_file_info(at).type.name != "NotFound"
    except (OSError, ValueError, NotImplementedError):
        return False


def _arrow_store():
    """A function that gives Arrow's file system and path there of a URI; names in it are as they are, not escaped."""

    def store(uri):
        from pyarrow import fs

        scheme, _, authority, rest = uri.split("/", 3)
        found, top = fs.FileSystem.from_uri(f"{scheme}//{authority}/")
        return found, f"{top.rstrip('/')}/{rest}"

    return store


def _pattern(spark: SparkSession, glob: str) -> str:
    """Hadoop's regular expression for names of the form ``glob``."""
    return rf"(?s)\A(?:{spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()})\z"


def _lister():
    """A function for ``mapInArrow``: what is directly below each of its directories (uri), as (uri, length), without a length for directories; a file is itself.

    Names that Spark's readers pass over are left out, and so are links that lead nowhere.
    """
    opened = _arrow_store()

    def below(uri):
        if uri.startswith("file:"):
            import os

            with os.scandir(uri[5:]) as found:
                for x in found:
                    try:
                        x.name.encode()
                        yield x.name, None if x.is_dir() else x.stat().st_size
                    except (OSError, UnicodeEncodeError):
                        continue
            return
        from pyarrow import fs

        store, at = opened(uri)
        for x in store.get_file_info(fs.FileSelector(at)):
            yield x.base_name, None if x.type == fs.FileType.Directory else x.size

    def size(uri):
        """Of a file; None for a directory."""
        if uri.startswith("file:"):
            import os

            return None if os.path.isdir(uri[5:]) else os.stat(uri[5:]).st_size
        from pyarrow import fs

        store, at = opened(uri)
        x = store.get_file_info(at)
        return None if x.type == fs.FileType.Directory else x.size

    def hidden(name):
        left_out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
        return left_out and not name.startswith(("_common_metadata", "_metadata"))

    def rows(uri):
        try:
            n = size(uri)
            if n is not None:
                if not hidden(uri.rpartition("/")[2]):
                    yield uri, n
                return
            for name, n in below(uri):
                if not hidden(name):
                    yield f"{uri.rstrip('/')}/{name}", n
        except FileNotFoundError:  # gone since it was listed
            return

    def run(batches):
        import pyarrow as pa

        held = [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.int64())], ["uri", "length"])
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                for x, n in rows(uri):
                    held[0].append(x)
                    held[1].append(n)
                    if len(held[0]) == 10_000:
                        yield out()
                        held = [], []
        yield out()

    return run


def contents(files: DataFrame) -> DataFrame:
    """(path, length, content) of ``files`` of a ``listing`` (or a ``tree``) that can be read, each as a row; files are opened by tasks of about as many bytes and files each."""
    if "content" in files.columns:
        return read(files).select("path", "length", "content")
    conf = files.sparkSession._jsparkSession.sessionState().conf()
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(-(-n // FILES), -(-total // conf.filesMaxPartitionBytes()), min(files.sparkSession.sparkContext.defaultParallelism, -(-n // 64)))
    rows = files.select("path", "length", "uri")
    if tasks > 1:
        rows = rows.repartition(min(tasks, n), "path")
    return rows.mapInArrow(_reader(HELD), "path string, length bigint, content binary")


def _reader(held: int):
    """A function for ``mapInArrow``: (path, length, uri) with content, of files that can be read; local ones are held against their checksum files, as Hadoop does it.

    A file with fewer checksums than it needs isn't readable to its end.
    """
    opened = _arrow_store()

    def sound(path, data):
        import zlib

        folder, _, name = path.rpartition("/")
        try:
            with open(f"{folder}/.{name}.crc", "rb") as f:
                sums = f.read()
        except OSError:
            return True
        if sums[:4] != b"crc\0" or len(sums) < 8:
            return True  # no checksum file
        step = int.from_bytes(sums[4:8], "big", signed=True)
        if step <= 0 or len(sums) < 8 - 4 * (-len(data) // step):
            return False
        return all(zlib.crc32(data[i : i + step]) == int.from_bytes(sums[8 + 4 * k : 12 + 4 * k], "big") for k, i in enumerate(range(0, len(data), step)))

    def content(uri, stores):
        if uri.startswith("file:"):
            with open(uri[5:], "rb") as f:
                data = f.read()
            return data if sound(uri[5:], data) else None
        top = "/".join(uri.split("/", 3)[:3]) + "/"
        if top not in stores:
            stores[top] = opened(top)
        store, at = stores[top]
        with store.open_input_file(f"{at.rstrip('/')}/{uri[len(top):]}") as f:
            return f.read()

    def run(batches):
        import pyarrow as pa

        stores, rows, n = {}, ([], [], []), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "length", "content"])
        for batch in batches:
            for path, length, uri in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "uri")), strict=True):
                try:
                    data = content(uri, stores)
                except OSError:
                    continue
                if data is None:
                    continue
                for column, x in zip(rows, (path, length, data), strict=True):
                    column.append(x)
                n += len(data)
                if n >= held or len(rows[0]) == 10_000:
                    yield out()
                    rows, n = ([], [], []), 0
        yield out()

    return run


def by_name(files: DataFrame, path: str | list[str], glob: str | None) -> tuple[str | list[str], str]:
    """(paths, glob) by which Spark's readers find ``files`` of a ``listing`` alone, so without listing what else is below ``path``; of a ``tree``, its own."""
    if "content" in files.columns:
        return path, glob or "*"
    return [re.sub(r"([][{}*?\\])", r"\\\1", r.uri) for r in files.select("uri").collect()], "*"


def listed(files: DataFrame) -> DataFrame:
    """(path, length) of a ``listing`` or a ``tree``; none of its files is opened."""
    return files.select("path", "length")


def read(files: DataFrame) -> DataFrame:
    """``files`` of a ``tree`` that can be read."""
    return files.filter(F.length("content") >= 0)


def named(glob: str) -> Column:
    """Whether a file of a ``listing`` or a ``tree`` has a name of the form ``glob`` (*, ? and sets in brackets)."""
    return F.col("file_name").rlike(r"\A" + fnmatch.translate(glob).replace(r"\Z", r"\z"))


def cut(files: DataFrame, mark: bytes) -> DataFrame:
    """(path, length, i, piece) of ``files`` (path, length, content) that are rows: what Spark's reader of lines gives, in order, where ``mark`` ends lines.

    A byte order mark at the beginning is taken off, and nothing comes after the last mark if the file ends there.
    """
    whole = F.regexp_replace(F.decode("content", "ISO-8859-1"), rf"\A{_BYTE_ORDER_MARK}", "")
    parts = files.select("path", "length", F.split(whole, "".join(f"\\x{c:02x}" for c in mark)).alias("parts"))
    kept = F.when(F.element_at("parts", -1) == "", F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))
    return parts.select("path", "length", F.posexplode(kept).alias("i", "piece")).select("path", "length", F.col("i").cast("bigint").alias("i"), F.encode("piece", "ISO-8859-1").alias("piece"))


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, length) of the files below ``path`` that are not empty; none of them is opened."""
    return listed(listing(spark, path, glob))


def read_files(spark: SparkSession, path: str | list[str], glob: str, longest: int | None = None) -> DataFrame:
    """(path, content) of the files below ``path`` whose names match, of up to ``longest`` bytes; unreadable files are left out."""
    found = listing(spark, path, glob)
    return contents(found if longest is None else found.filter(F.col("file_size") <= longest)).select("path", "content")
