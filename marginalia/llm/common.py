"""What the corpus operators share: words, names, broadcasts within a bound, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.storage import new_path, qualified, saved, shared_dir

__all__ = ["Scratch", "fresh", "lower_ascii", "n_words", "new_path", "qualified", "saved", "shared_dir", "ship", "small", "table", "words"]

#: ASCII white space; everything else belongs to words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_shipped: set[str] = set()


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; null for null."""
    spaced = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows at most; larger tables are joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Scratch:
    """Intermediate tables in the shared folder, deleted together at the end of a ``with`` block; its results are saved elsewhere."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.count = spark, new_path(spark, name), 0

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions that run in Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
