"""Vectorised text primitives shared by the corpus operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words, lines and
windows are handled as positions and 64-bit hashes over the Arrow buffers of a
column, so no Python object is made per word. Work goes chunk by chunk, so memory
is bounded by ``CHUNK`` bytes of text, not by the batch or by the longest text
(a single word longer than a chunk is the one exception).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_rng = np.random.default_rng(20_240_607)
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _LOWER[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15 | 3
MULS = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for r in (_R, pow(_R, -1, 2**64)):
            t = np.full(size, r, dtype=np.uint64)
            t[0] = 1
            out.append(np.cumprod(t, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]  # a slice sees its own bytes only


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Chunks of about CHUNK bytes that end at a row's end or after white space."""
    pos, end, out = int(offsets[0]), int(offsets[-1]), []
    while pos < end:
        to = min(pos + CHUNK, end)
        if to < end:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            blank = np.flatnonzero(SPACE[data[pos:to]])
            cut = max(row, pos + int(blank[-1]) + 1 if len(blank) else pos)
            if cut <= pos:  # one word fills the chunk: go on to its end
                stop = int(offsets[np.searchsorted(offsets, to, "left")])
                at = to
                while at < stop and cut <= pos:
                    blank = np.flatnonzero(SPACE[data[at : min(at + CHUNK, stop)]])
                    cut = at + int(blank[0]) + 1 if len(blank) else pos
                    at += CHUNK
                cut = cut if cut > pos else stop
            to = cut
        out.append((pos, to))
        pos = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all rows: 64-bit hash, first byte, end byte; and words before each row (rows + 1)."""
    table = _LOWER if lower else _PLAIN
    hashes, begins, ends = [], [], []
    for lo, hi in _cuts(data, offsets):
        b = data[lo:hi]
        ink = ~SPACE[b]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        edge = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
        inner = edge[edge < hi - lo]
        first[inner] = ink[inner]
        inner = edge[edge > 0] - 1
        last[inner] = ink[inner]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        up, down = _pow_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[b] * up[: hi - lo], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        begins.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    h, s, e = np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)
    return h, s, e, np.searchsorted(s, offsets, "left")


def windows(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word window that starts at a word, and whether it lies in one row."""
    n = len(h)
    out = np.zeros(n, dtype=np.uint64)
    if n >= k:
        total = h[: n - k + 1] * MULS[0]
        for i in range(1, k):
            total = total + h[i : n - k + 1 + i] * MULS[i]
        out[: n - k + 1] = mix(total)
    row_end = np.repeat(starts[1:], np.diff(starts))
    return out, np.arange(n) + k <= row_end


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte (length + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def hand_back() -> None:
    """Gives freed memory back to the system: an idle Python worker lives on beside the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sized_batches(batches, limit: int = 2 << 20, column: str = "text"):
    """The same rows in batches of at most about ``limit`` bytes of text (one row at least)."""
    try:
        yield from _sized(batches, limit, column)
    finally:
        hand_back()


def _sized(batches, limit: int, column: str):
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
