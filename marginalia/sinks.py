"""Sinks: every export is a partitioned folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.operators.order import order_annotations, order_keys, stored_export
from marginalia.operators.render import csv_rows, manifest_row, markdown_rows, pruned, render_text


def write_json(annotations: DataFrame, indexes: DataFrame, path: str) -> None:
    """annotations/ (pruned, in order), page_indexes/ (whole) and manifest/ as JSON lines.

    The manifest's counts are observed while the rows are written: they are of these rows, and nothing is computed again.
    """
    written, indexed = Observation(), Observation()
    pruned(order_annotations(annotations)).observe(written, F.count("*").alias("n")).write.json(f"{path}/annotations")
    indexes.observe(indexed, F.count("*").alias("n")).write.json(f"{path}/page_indexes")
    manifest_row(annotations.sparkSession, written.get["n"], indexed.get["n"]).write.json(f"{path}/manifest")


def write_csv(annotations: DataFrame, path: str) -> None:
    """The export columns with a header; quotes are doubled, edge spaces stay, nulls are empty."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": ""}
    csv_rows(order_annotations(annotations)).write.options(**options).csv(path)


def write_markdown(annotations: DataFrame, path: str) -> None:
    """One section per book, in the order of first appearance."""
    markdown_rows(annotations).orderBy("first_seen", "book_title", "at").select(F.col("block").alias("value")).write.text(path)


def write_text(annotations: DataFrame, path: str) -> None:
    render_text(annotations).orderBy("at").select(F.col("block").alias("value")).write.text(path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Parquet by kind, each file in export order, for further queries."""
    annotations.repartitionByRange(*order_keys()).sortWithinPartitions(*order_keys()).write.partitionBy("clip_type").parquet(path)


def write_all(annotations: DataFrame, indexes: DataFrame, path: str) -> dict[str, int]:
    """json/, csv/, markdown/ and text/ of the same rows: computed, sorted and stored once; returns what was observed on the way."""
    rows, seen = stored_export(annotations)
    write_json(rows, indexes, f"{path}/json")
    write_csv(rows, f"{path}/csv")
    write_markdown(rows, f"{path}/markdown")
    write_text(rows, f"{path}/text")
    return seen
