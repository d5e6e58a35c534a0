"""Whole-column text work over Arrow buffers: slices of bounded size, words, hashes, n-grams.

A word is a maximal run of bytes other than ASCII white space (tab, LF, VT, FF, CR, space).
Hashes are 64-bit: a polynomial over the bytes modulo 2**64, then a mixing step.
A null text is read as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are held in work arrays at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit moves about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without a copy where it has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(name)
    raw, offs = text_buffers(batch.column(at))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows, first + 20_000)
        yield batch.slice(first, last - first), raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    white = WHITE[raw]
    cut = np.empty(len(raw) + 1, dtype=bool)
    cut[0] = True
    cut[1:] = white
    inner = offs[:-1][offs[:-1] < len(raw)]
    cut[inner] = True
    starts = np.flatnonzero(cut[:-1] & ~white)
    cut[1:] = True
    cut[1:-1] = white[1:]
    cut[offs[1:][offs[1:] > 0]] = True
    ends = np.flatnonzero(cut[1:] & ~white) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and each row's first shingle (one more at the end).

    A row with fewer than ``n`` words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    weights = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(n)]
    total = len(words)
    rolled = np.zeros(total, dtype=np.uint64)
    for j, weight in enumerate(weights):
        if total > j:
            rolled[: total - j] += words[j:] * weight
    keep = np.zeros(total, dtype=bool)
    rows = np.flatnonzero(counts >= n)
    if len(rows):
        # every word that starts a whole shingle of its own row
        edge = np.zeros(total + 1, dtype=np.int64)
        np.add.at(edge, first[rows], 1)
        np.add.at(edge, first[rows] + made[rows], -1)
        keep = np.cumsum(edge[:-1]) > 0
    out = np.empty(int(begin[-1]), dtype=np.uint64)
    place = np.zeros(len(out), dtype=bool)
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[first[r] : first[r + 1]]
        with np.errstate(over="ignore"):
            out[begin[r]] = np.sum(own * np.array(weights[: len(own)], dtype=np.uint64), dtype=np.uint64) + np.uint64(len(own))
        place[begin[r]] = True
    out[~place] = rolled[keep]
    return mix(out), begin


def row_of(begin: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin))
