"""Fill-in-middle transformation by block rotation in place.

A text is cut into prefix, middle and suffix at two of its units. The three sentinels are inserted into a bytearray of the
text, and the order of the segments is changed by one rotation: each of two neighbouring blocks is reversed, then both
together. The inverse finds the sentinels, rotates back and takes them out, so every text is restored byte by byte. Texts
stay in their tasks: there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import fresh, ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = 3
#: Bytes that are scanned or reversed at once.
PIECE = 1 << 20
#: Texts of about so many bytes make a batch of results.
BATCH_BYTES = 4 << 20


def _units(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For the bytes [lo, hi) of UTF-8 ``data``, whether a unit starts there: a run of ASCII letters, or any other character."""
    part = data[lo:hi]
    letter = ((part | 0x20) - 0x61) < 26  # unsigned: other bytes wrap to large numbers
    starts = (part & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if lo and letter[0] and ((int(data[lo - 1]) | 0x20) - 0x61) in range(26):
        starts[0] = False
    return starts


def count_units(data: np.ndarray) -> list[int]:
    """How many units start in each piece of ``data``."""
    return [int(np.count_nonzero(_units(data, lo, min(lo + PIECE, len(data))))) for lo in range(0, len(data), PIECE)]


def unit_place(data: np.ndarray, counts: list[int], k: int) -> int:
    """The byte at which unit ``k`` (from 0) starts; the end for the number of units."""
    for i, n in enumerate(counts):
        if k < n:
            lo = i * PIECE
            return lo + int(np.flatnonzero(_units(data, lo, min(lo + PIECE, len(data))))[k])
        k -= n
    return len(data)


def _characters(data: np.ndarray, lo: int, hi: int) -> int:
    return sum(int(np.count_nonzero((data[at : min(at + PIECE, hi)] & 0xC0) != 0x80)) for at in range(lo, hi, PIECE))


def _reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse [lo, hi) in place, by exchanging pieces of both ends."""
    while hi - lo > 1:
        k = min(PIECE, (hi - lo) // 2)
        left = view[lo : lo + k].copy()
        view[lo : lo + k] = view[hi - k : hi][::-1]
        view[hi - k : hi] = left[::-1]
        lo, hi = lo + k, hi - k


def _rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks [lo, mid) and [mid, hi) in place."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, lo, mid)
    _reverse(view, mid, hi)
    _reverse(view, lo, hi)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at bytes ``first`` and ``second``, in the order of ``form`` (psm or spm)."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + SENTINEL, second + 2 * SENTINEL
    _rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def invert(output: bytes, form: str) -> bytearray:
    """The text that ``arrange`` was given; ``output`` holds each sentinel once."""
    buffer = bytearray(output)
    start = buffer.index(SUFFIX)
    mid = buffer.index(MIDDLE if form == "psm" else PREFIX, start)
    size = mid - start  # of the suffix with its sentinel
    _rotate(buffer, start, mid, len(buffer))
    at = len(buffer) - size
    del buffer[at : at + SENTINEL]
    at = buffer.index(MIDDLE)
    del buffer[at : at + SENTINEL]
    del buffer[:SENTINEL]
    return buffer


def _slices(column: pa.Array):
    """(from, to, data, offsets) of runs of texts of about BATCH_BYTES bytes; nulls have no bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield at, min(to, len(column)), data, offsets
        at = to


def _strings(values: list) -> pa.Array:
    return pa.array([bytes(v) for v in values], pa.binary()).cast(pa.string())


def _arranged(batches):
    for batch in batches:
        h1, h2, forms = (batch.column(batch.schema.get_field_index(c)) for c in ("h1", "h2", "form"))
        for lo, hi, data, offsets in _slices(batch.column(batch.schema.get_field_index("text"))):
            n, prefix, middle, output = [], [], [], []
            for i in range(lo, hi):
                text, form = data[offsets[i] : offsets[i + 1]], forms[i].as_py()
                counts = count_units(text)
                n.append(sum(counts))
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    output.append(text.tobytes())
                    continue
                first, second = sorted(unit_place(text, counts, h[i].as_py() % (n[-1] + 1)) for h in (h1, h2))
                prefix.append(_characters(text, 0, first))
                middle.append(_characters(text, first, second))
                output.append(arrange(text.tobytes(), first, second, form))
            size = hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")).slice(lo, size), pa.array(n, pa.int64()), forms.slice(lo, size), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(output)],
                names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """Every text of ``docs`` (doc_id, text and the columns of ``carry``) with its middle last.

    A unit is a run of ASCII letters or one other character. The two cuts, and whether a text is transformed (``rate`` of 100) and
    with its suffix first (``spm_rate`` of 100), come from the SHA-256 of ``seed`` and doc_id. Returns row (a struct of ``carry``),
    n (units), form (psm, spm or plain), prefix_chars, middle_chars (code points; null for plain) and output.

    Null and empty texts, and texts that hold a sentinel already, stay plain; a null id counts as an empty text in the hash; rows that
    repeat an id are cut by the same numbers; segments may be empty; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(F.col("_digest"), 8 * i + 1, 8), 16, 10).cast("bigint")
    held = [F.contains(text, F.lit(s.decode())) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (text == "") | held[0] | held[1] | held[2] | (number(2) % 100 >= rate)
    form = F.when(plain, "plain").when(number(3) % 100 < spm_rate, "spm").otherwise("psm")
    cut = docs.select(F.struct(*carry).alias("row"), text.alias("text"), digest.alias("_digest")).select("row", "text", number(0).alias("h1"), number(1).alias("h2"), form.alias("form"))
    kind = cut.schema["row"].dataType.simpleString()
    return cut.mapInArrow(_arranged, f"row {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _inverted(batches):
    for batch in batches:
        forms = batch.column(batch.schema.get_field_index("form"))
        for lo, hi, data, offsets in _slices(batch.column(batch.schema.get_field_index("output"))):
            outputs = (data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi))
            found = [x if f == "plain" else invert(x, f) for x, f in zip(outputs, forms.slice(lo, hi - lo).to_pylist(), strict=True)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, _strings(found)], names=[*batch.schema.names, ""])


def restore(made: DataFrame) -> DataFrame:
    """``made`` (output, form and any other columns) with restored: the text that each output was made of.

    The column gets underscores before its name where ``made`` has it already.
    """
    ship(made.sparkSession)
    (name,) = fresh(made, "restored")
    schema = T.StructType([*made.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in _inverted(batches):
            yield batch.rename_columns([*batch.schema.names[:-1], name])

    return made.mapInArrow(run, schema)
