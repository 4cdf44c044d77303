"""Vectorised 64-bit hashing of words and shingles over Arrow text columns.

The bytes of a whole batch are hashed at once: a polynomial over the bytes is
kept as a running sum, so the hash of any word is a difference of two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_MULT = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_COEF = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

CHUNK_BYTES = 1 << 19  # bytes hashed at a time: bounds the working arrays


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MULT)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def forget() -> None:
    """Drop the powers; a long text makes many."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of rows of about
    ``size`` bytes (CHUNK_BYTES); a longer text is a run of its own. Null reads
    as empty."""
    size = size or CHUNK_BYTES
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_hashes_at(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of every word (A-Z lower-cased, ASCII white space splits), the row
    it stands in, its first byte and the byte after it, in text order."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a row of 1 to
    k-1 words has its whole sequence as the only one, an empty row none."""
    words, rows, _, _ = word_hashes_at(raw, offsets)
    n_rows = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    n = len(words) - k + 1
    if n > 0:
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc += words[j:j + n] * _COEF[j]
        acc = mix(acc)
    out = []
    for r in range(n_rows):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            out.append(np.unique(acc[a:b - k + 1]))
        elif b > a:
            short = np.uint64(_MULT) * np.uint64(b - a) if b - a == 1 else _COEF[100 + b - a]
            out.append(mix((words[a:b] * _COEF[:b - a]).sum(dtype=np.uint64, keepdims=True) + short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(1, 1 << 63, n, dtype=np.uint64)


def long_array(rows: list[np.ndarray]) -> pa.ListArray:
    """list<int64> column from uint64 arrays."""
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                    pa.array(flat.view(np.int64)))
