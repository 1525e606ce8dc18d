"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a .warc.zst file of frames and, as its footer, a
skippable frame with the seek table (sizes of all frames, in the public seekable format). The index, a Parquet table, maps
each record's id to its bundle, its frame and its place in the frame; a reader takes the frame's place
from the seek table.

Tasks write bundles to the shared store under names of their own, and Spark commits the index rows of one attempt
for each task: a bundle that a lost or repeated attempt has left is in no index and never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import qualified, saved, ship, small

#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Up to so many repeated payloads (60 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "bundle string, frame int, records array<struct<record_id:string,offset:bigint,length:bigint>>"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str | None) -> int | None:
    number = (rid or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool) -> bytes:
    """A response record, or a revisit of ``first`` without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_first else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if not is_first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    block = http + payload if is_first else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, record_type, payload_bytes, payload_digest, refers_to and payload (None for a revisit) of one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload differs from its digest")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": page_of(fields.get("WARC-Refers-To")), "payload": payload if whole else None}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) sizes of a bundle's frames."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


class _Bundle:
    """A bundle that is being written."""

    def __init__(self, store, path: str) -> None:
        self.path, self.sizes, self.packed = path, [], 0
        self.out = store.open_output_stream(path, compression=None)

    def add(self, data: bytes, raw_size: int) -> int:
        """Append a frame; returns its number."""
        self.out.write(data)
        self.sizes.append((len(data), raw_size))
        self.packed += len(data)
        return len(self.sizes) - 1

    def close(self) -> None:
        self.out.write(seek_table(self.sizes))
        self.out.close()


def _store(uri: str):
    """The file system of ``uri`` and the path in it, as the executors open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _bundles(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        pack = zstandard.ZstdCompressor(level=3)
        bundle: _Bundle | None = None
        raw, index = bytearray(), []

        def close_frame() -> pa.RecordBatch:
            nonlocal bundle
            bundle = bundle or _Bundle(store, f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst")
            frame = bundle.add(pack.compress(bytes(raw)), len(raw))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([bundle.path.rpartition("/")[2]]),
                    pa.array([frame], pa.int32()),
                    pa.array([list(index)], pa.list_(pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))),
                ],
                names=["bundle", "frame", "records"],
            )
            raw.clear()
            index.clear()
            if bundle.packed >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            return out

        for batch in batches:
            for page_id, url, payload, first, is_first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first", "is_first")), strict=True):
                record = make_record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), is_first.as_py())
                index.append({"record_id": record_id(page_id.as_py()), "offset": len(raw), "length": len(record)})
                raw += record
                if len(raw) >= FRAME_BYTES:
                    yield close_frame()
        if raw:
            yield close_frame()
        if bundle:
            bundle.close()

    return run


def write_bundles(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to ``path``: bundles/ and index/.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id becomes a
    response and the others revisit it; smaller ones are all responses. A null html is an
    empty payload, a null url leaves its header out, a null page_id comes after all others and names no
    record; rows that repeat page_id and payload of a response are responses too; payloads of any length are one record;
    other columns are ignored; an empty table writes no bundle and an empty index.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    rank: Column = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("first"))
    # Only payloads that come more than once; written, so that Spark can split the rows of a frequent one in the join.
    repeated = rows.select("page_id", "digest").groupBy("digest").agg(F.min(rank).alias("f"), F.count("*").alias("c")).filter("c > 1")
    firsts = small(saved(repeated.select("digest", F.col("f.first").alias("first"), F.lit(True).alias("again")), "repeated"), BROADCAST_ROWS)
    same = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("payload") < min_bytes)
    records = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "first", same.alias("is_first"))
    records.mapInArrow(_bundles(f"{qualified(spark, path)}/bundles"), INDEX_SCHEMA).write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where every record of the archive at ``path`` lies."""
    frames = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    return frames.select("bundle", "frame", F.explode("records").alias("r")).select("r.record_id", "bundle", "frame", "r.offset", "r.length")


_FIELDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        name, bundle = None, None
        for batch in batches:
            for wanted, frame, records in zip(batch.column("bundle"), batch.column("frame"), batch.column("records"), strict=True):
                if wanted.as_py() != name:
                    name = wanted.as_py()
                    bundle = SeekableBundle(store.open_input_file(f"{folder}/{name}"))
                raw = bundle.frame(frame.as_py())
                rows = [parse_record(raw[x["offset"] : x["offset"] + x["length"]]) for x in records.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in _FIELDS.items()], names=list(_FIELDS))

    return run


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archive at ``path``.

    Each frame is found by its bundle's seek table, each record by the index; payloads are checked against their digests.
    """
    ship(spark)
    frames = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    return frames.mapInArrow(_read(f"{qualified(spark, path)}/bundles"), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


class SeekableBundle:
    """Random access to the frames of a bundle file by its seek table."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(-9, 2)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        width = 12 if flags & 0x80 else 8
        file.seek(-9 - n * width, 2)
        self.sizes = [struct.unpack("<II", file.read(width)[:8]) for _ in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        self.file.seek(self.starts[number])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[number][0]))

    def record(self, number: int, offset: int, length: int) -> dict:
        return parse_record(self.frame(number)[offset : offset + length])
