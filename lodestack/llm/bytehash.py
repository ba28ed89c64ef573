"""Vectorised hashing of words and lines straight from Arrow string buffers.

All hashing works on UTF-8 bytes. ASCII white space is ``[\\x20\\x09-\\x0D]`` and lower-casing touches A-Z only, so no
character is ever decoded. Hashes are 64-bit, deterministic, and equal for equal (lower-cased) byte strings.

A span is hashed as 8-byte lanes: every lane goes with its place and the salt through a non-linear 64-bit finaliser before
the lanes are added up, so no pair of texts collides under more than one salt by construction (as spans of equal sums do in a
polynomial modulo a power of two), and two salts make a 128-bit name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = x ^ _U(salt)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _fold_table() -> np.ndarray:
    b = np.arange(256)
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


FOLD = _fold_table()
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)  # masks of a lane's first k bytes


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if arr.null_count:
        gone = np.asarray(arr.is_null())
        ends[gone] = starts[gone]
    return buf, starts, ends


def groups(starts: np.ndarray, ends: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to about ``limit`` (one long row may exceed it)."""
    i, n = 0, len(starts)
    sizes = np.cumsum(ends - starts)
    while i < n:
        before = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield i, j
        i = j


def _lanes(part: np.ndarray, lo: np.ndarray, size: np.ndarray, first: int, salt: int) -> np.ndarray:
    """Sum of each span's finalised lanes; ``part`` has 8 bytes more than the spans, places count from ``first``."""
    n = -(-size // 8)
    end = np.cumsum(n)
    total = int(end[-1])
    place = np.arange(total) - np.repeat(end - n, n)
    eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
    lane = eight[np.repeat(lo, n) + 8 * place] & _TAIL[np.minimum(np.repeat(size, n) - 8 * place, 8)]
    key = mix((np.arange(first, first + int(n.max(initial=0)), dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15), salt)
    sums = np.zeros(len(lo), _U)
    some = n > 0
    if total:
        sums[some] = np.add.reduceat(mix(lane ^ key[place]), (end - n)[some])
    return sums


def span_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0, fold: bool = True) -> np.ndarray:
    """Hash of every byte span [lo, hi) of ``buf``; spans ascend and don't overlap."""
    out = np.zeros(len(lo), _U)
    if not len(lo):
        return out

    def copy(a: int, b: int) -> np.ndarray:
        part = np.zeros(b - a + 8, np.uint8)
        part[: b - a] = FOLD[buf[a:b]] if fold else buf[a:b]
        return part

    i = 0
    with np.errstate(over="ignore"):
        while i < len(lo):
            base = int(lo[i])
            j = max(i + 1, int(np.searchsorted(hi, base + SLICE, side="right")))
            end = int(hi[j - 1])
            if end - base <= SLICE:
                out[i:j] = _lanes(copy(base, end), lo[i:j] - base, hi[i:j] - lo[i:j], 0, salt)
            else:  # one span longer than a slice: the same sum, piece by piece
                for at in range(base, end, SLICE):
                    top = min(end, at + SLICE)
                    out[i] += _lanes(copy(at, top), np.zeros(1, np.int64), np.array([top - at]), (at - base) // 8, salt)[0]
            i = j
        return mix(out + (hi - lo).astype(_U) * _U(0xD6E8FEB86659FD93), salt)


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of every maximal run of bytes outside ``gap`` (white space) in consecutive rows, in order."""
    if not len(starts) or ends[-1] <= starts[0]:
        z = np.zeros(0, np.int64)
        return z, z, z
    base, top = int(starts[0]), int(ends[-1])
    solid = ~gap[buf[base:top]]
    live = ends > starts
    first, last = starts[live] - base, ends[live] - base - 1
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    opens[first] = solid[first]
    closes[last] = solid[last]
    lo, hi = np.flatnonzero(opens) + base, np.flatnonzero(closes) + base + 1
    return np.searchsorted(ends, lo, side="right"), lo, hi


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by row and hash.

    A row with 1 to k-1 words has one shingle, its whole word sequence; a row without words has none.
    """
    row, lo, hi = words(buf, starts, ends)
    if not len(row):
        return row, np.zeros(0, _U)
    w = span_hashes(buf, lo, hi)
    n = len(w)
    with np.errstate(over="ignore"):
        h = np.zeros(n, _U)
        for i in range(k):  # hash of words i..i+k-1, or of as many as the row has left
            nxt = np.zeros(n, _U)
            nxt[: n - i] = np.where(row[i:] == row[: n - i], w[i:], _U(0)) if i else w
            h = h * _U(0xC2B2AE3D27D4EB4F) + nxt
        h = mix(h)
    counts = np.bincount(row, minlength=len(starts))
    place = np.arange(n) - (np.cumsum(counts) - counts)[row]
    keep = place <= np.maximum(counts[row] - k, 0)
    row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[fresh], h[fresh]
