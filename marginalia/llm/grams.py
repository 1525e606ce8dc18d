"""Word and n-gram hashes of many texts at once, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Texts are worked on in slices of about so many bytes: the working arrays take some 60 times that.
SLICE_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = _powers(base, 1)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_letters, _grams = _Powers(_BASE), _Powers(_GRAM)


def _word_hashes(blob: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and past-last bytes of the words; no word goes over a cut."""
    word = ~_BLANK[blob]
    edge = np.zeros(len(blob) + 1, bool)
    edge[cuts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _letters(len(blob) + 1)
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(_LETTER[blob] * up[: len(blob)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def texts(column: pa.Array, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past-last text, word hashes, word offsets by text) for slices of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        to = min(to, n)
        hashes, counts = _slice(data, offsets[at : to + 1], lower, slice_bytes)
        yield at, to, hashes, np.concatenate(([0], np.cumsum(counts)))
        at = to


def _slice(data: np.ndarray, offsets: np.ndarray, lower: bool, slice_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    parts, counts, lo, end = [], np.zeros(len(offsets) - 1, np.int64), int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + 2 * slice_bytes)
        while hi < end and not _BLANK[data[hi]]:  # a long text is cut between words
            hi += 1
        blob = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        cuts = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        h, starts, _ = _word_hashes(blob, cuts)
        owner = np.searchsorted(offsets, starts + lo, "right") - 1
        counts += np.bincount(owner, minlength=len(counts))[: len(counts)]
        parts.append(h)
        lo = hi
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = h * _GRAM + words[k : k + m]
    return mix(h)


def prefix_sums(words: np.ndarray) -> np.ndarray:
    up, _ = _grams(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [start, end), the same wherever a run stands."""
    _, down = _grams(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of a shorter text, its whole sequence."""
    if len(words) == 0:
        return words
    if len(words) < n:
        h = np.zeros(1, np.uint64) + np.uint64(len(words))
        for w in words:
            h = h * _GRAM + w
        return mix(h)
    return np.unique(ngrams(words, n))


def set_id(members: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(mix(members).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


#: 64-bit words of the parity sketch.
PARITY_WORDS = 8


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """The parities of the counts of members in PARITY_WORDS * 64 cells, as bits: two sets' sketches differ in as many as the sets do, at most."""
    cell = (mix(members) >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=64 * PARITY_WORDS).astype(np.uint8) & 1).view(np.int64)
