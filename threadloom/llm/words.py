"""Words of Arrow string columns as numpy arrays.

Texts are read as UTF-8 bytes. Every separator the operators use is ASCII, so
cutting bytes gives the same words as cutting code points. All arrays cover one
slice of a batch of a few megabytes; a longer text is a slice of its own.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

#: Bytes that belong to words: every byte but ASCII white space ...
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ... and ASCII letters, digits and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Bytes(NamedTuple):
    """``data`` holds all texts one after another; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Per word: place in ``data``, row of its text, hash. ``first[i]:first[i + 1]`` are the words of row i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def text_bytes(column: pa.Array) -> Bytes:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return Bytes(data, offsets - offsets[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cut a column into runs of rows of about ``limit`` bytes; yields (start, part)."""
    if not len(column):
        return
    ends = text_bytes(column).offsets[1:]
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, column.slice(start, stop - start)
        start = stop


def find_words(text: Bytes, member: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of member bytes within each text, with A-Z lower-cased unless ``fold`` is false."""
    data, offsets = text
    n = len(data)
    inside = member[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets, "left")
    lower = TO_LOWER[data] if fold else data
    return Words(lower, starts, ends, row, first, _hashes(lower[inside], ends - starts))


def _hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``letters``: a polynomial over mapped bytes, then mixed."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(begin, lengths)
    powers = np.full(int(lengths.max()), 0xD6E8FEB86659FD93, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    values = BYTE_VALUES[letters]
    values *= powers[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _GOLD)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words inside a text; a shorter text, not empty, is one run as a whole."""
    h, row, first = words.hashes, words.row, words.first
    counts = np.diff(first)
    n = len(h)
    out_h, out_r = [], []
    if n >= size:
        value = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            value = value * np.uint64(0xA0761D6478BD642F) + h[k : n - size + 1 + k]
        whole = row[: n - size + 1] == row[size - 1 :]
        out_h.append(value[whole])
        out_r.append(row[: n - size + 1][whole])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for x in h[first[i] : first[i + 1]]:
                value = value * np.uint64(0xA0761D6478BD642F) + x
        out_h.append(np.array([value], dtype=np.uint64))
        out_r.append(np.array([i]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(out_h)), np.concatenate(out_r).astype(np.int64)
