"""Words and shingles of Arrow text batches as flat numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``. In UTF-8 the separators are single bytes, so the bytes
of a batch are scanned without decoding. Every word gets a 64-bit polynomial hash that depends on
its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = ~_LETTER[33:127]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: ``first[i]:first[i + 1]`` are those of document i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, nulls as empty; nothing is copied for a plain array."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, cut: bool = False) -> Words:
    """Word bounds and hashes of documents laid end to end, scanned in pieces that stay in cache.

    ``lower`` folds A-Z; ``cut`` also begins a word where an ASCII mark or digit follows an ASCII letter.
    """
    if lower:
        data = _LOWER[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):
            tail = np.flatnonzero(_SEPARATOR[data[at:stop]] | begins[at:stop])
            if len(tail) and tail[-1] > 0:
                stop = at + int(tail[-1])
            else:
                rest = _SEPARATOR[data[stop:]] | begins[stop:-1]
                stop = stop + int(rest.argmax()) if rest.any() else len(data)
        piece = data[at:stop]
        gap = _SEPARATOR[piece]
        edge = begins[at:stop + 1]
        if cut:
            edge = edge.copy()
            edge[1:-1] |= _MARK[piece[1:]] & _LETTER[piece[:-1]]
        before = np.concatenate(([True], gap[:-1])) | edge[:-1]
        after = np.concatenate((gap[1:], [True])) | edge[1:]
        s = np.flatnonzero(~gap & before)
        e = np.flatnonzero(~gap & after) + 1
        power, inverse = _powers(max(PIECE + 1, 1 << (len(piece) + 1).bit_length()))
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[:len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(data, start, end, value, np.searchsorted(start, offsets))


def slices(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about ``limit`` bytes each; a longer text is alone."""
    sizes = np.diff(utf8(column)[1])
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; runs may cross documents, the caller cuts them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    base = np.uint64(_BASE)
    for j in range(width):
        total *= base
        total += values[j:j + n]
    return mix(total)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document and their offsets.

    A document with fewer words than ``width`` has one shingle, its whole sequence; one without
    words has none.
    """
    runs = rolling(words.hash, width)
    parts, sizes = [], np.zeros(len(words.first) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a >= width:
            own = np.unique(runs[a:b - width + 1])
        elif b > a:
            own = rolling(words.hash[a:b], int(b - a)) + np.uint64(b - a)
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
