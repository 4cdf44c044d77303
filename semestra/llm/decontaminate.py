"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are squeezed to their letters and digits in lower case. A document leaks
an item if a window of WINDOW squeezed bytes of the item (the whole item, if it
is shorter) aligns with some region of the document within the edit budget of
ERROR_RATE. By the q-gram lemma such a region shares at least
``w + 1 - q * (k + 1)`` q-grams with the window, all on diagonals at most k
apart; so shared q-grams are counted in overlapping bands of 2k diagonals, and
windows that reach the count are verified by a banded alignment.

The benchmark is searched in blocks of at most BLOCK_BYTES, whose index goes to
every task (at most 20 bytes for each byte of items, and a sieve of 16 MB); each
block is one pass over all documents.

Defined results: null or empty texts and items, and items of under MIN_BYTES
squeezed bytes, match nothing. Each row is judged by itself: null or repeated
doc_ids and item_ids are reported as they are. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.llm.hashing import mix, text_chunks
from semestra.llm.workers import tidy

Q = 12
WINDOW = 60
ERROR_RATE = 0.06
MIN_BYTES = 24
BLOCK_BYTES = 4 << 20
SIEVE_BITS = 27  # most flags before the search of an index: 16 MB

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COEF = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xA0761D6478BD642F
_STEP = np.array([pow(_BASE, j, 1 << 64) for j in range(Q)], np.uint64)


def squeeze(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept bytes in lower case (ASCII and Latin-1 letters) and their places."""
    at = np.flatnonzero(_KEEP[raw])
    out = _LOWER[raw[at]]
    if len(out) > 1:
        upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[upper] += 32
    return out, at


def qgram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes from every position on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    coded = _COEF[data]
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out += coded[j:j + n] * _STEP[j]
    return mix(out)


class Index:
    """q-grams of a block of items: sorted hashes with item and position."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.texts = [], []
        for item, text in items:
            data, _ = squeeze(np.frombuffer((text or "").encode(), np.uint8))
            if len(data) >= MIN_BYTES:
                self.ids.append(item)
                self.texts.append(data)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.window = np.minimum(sizes, WINDOW)
        budget = np.floor(self.window * ERROR_RATE).astype(np.int64)
        self.budget = np.minimum(budget, (self.window + 1) // Q - 1).clip(0)  # the lemma's count stays positive
        self.least = (self.window + 1 - Q * (self.budget + 1)).clip(1)
        parts = [qgram_hashes(t) for t in self.texts]
        hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])[order]
        self.pos = np.concatenate([*(np.arange(len(p), dtype=np.int32) for p in parts), np.zeros(0, np.int32)])[order]
        self.bits = min(SIEVE_BITS, max(10, math.ceil(math.log2(64 * len(hashes) + 1))))
        self.sieve = np.zeros(1 << (self.bits - 3), np.uint8)  # packed, eight flags a byte
        flag = self.hashes >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.sieve, flag >> np.uint64(3), np.uint8(1) << (flag & np.uint64(7)).astype(np.uint8))

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in data, item, position in item) of every shared q-gram."""
        found = qgram_hashes(data)
        flag = found >> np.uint64(64 - self.bits)
        at = np.flatnonzero((self.sieve[flag >> np.uint64(3)] >> (flag & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        low = np.searchsorted(self.hashes, found[at], "left")
        times = np.searchsorted(self.hashes, found[at], "right") - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        where = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(at, times), self.item[where].astype(np.int64), self.pos[where].astype(np.int64)

    def windows(self, row: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Columns row, item, band, first and last position in the item of
        runs of q-grams that meet the lemma's count within one window."""
        step = np.maximum(self.budget[item], 1)
        band = np.floor_divide(at - pos, step)
        table = np.stack([np.tile(row, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(pos, 2)])
        table = table[:, np.lexsort(table[::-1])]
        fresh = np.ones(table.shape[1], bool)
        fresh[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
        table = table[:, fresh]
        last = np.arange(table.shape[1]) + self.least[table[1]] - 1
        ok = last < table.shape[1]
        last = np.minimum(last, table.shape[1] - 1)
        ok &= (table[:3] == table[:3, last]).all(axis=0) & (table[3, last] - table[3] <= self.window[table[1]] - Q)
        return np.concatenate([table, table[3:4, last]])[:, ok]

    def verify(self, data: np.ndarray, item: int, band: int, first: int, last: int,
               tried: set[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(edits, start, end) of the first window of the item around the run
        that aligns with a region of ``data`` in the band; windows in ``tried``
        (band, place) have failed before."""
        w, k = int(self.window[item]), int(self.budget[item])
        text, step = self.texts[item], max(k, 1)
        low, high = max(0, last + Q - w), min(first, len(text) - w)
        for p in sorted(range(low, high + 1), key=lambda p: abs(2 * p - low - high)):
            if (band, p) in tried:
                continue
            tried.add((band, p))
            a = max(0, p + band * step - k)
            got = banded(text[p:p + w], data[a:p + (band + 2) * step + w + k])
            if got[0] <= k:
                return got[0], a + got[1], a + got[2]
        return None


def banded(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of the whole pattern within
    the region, one row of the pattern at a time over the band's width."""
    n = len(region)
    ramp = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), ramp.copy()
    for i, c in enumerate(pattern):
        diagonal = cost[:-1] + (region != c)
        best = np.concatenate([[i + 1], np.minimum(diagonal, cost[1:] + 1)])
        begin = np.concatenate([start[:1], np.where(diagonal <= cost[1:] + 1, start[:-1], start[1:])])
        slid = best - ramp
        low = np.minimum.accumulate(slid)
        src = np.maximum.accumulate(np.where(slid == low, ramp, 0))
        cost, start = low + ramp, begin[src]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def matches(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first byte, byte after the last) of the texts."""
    data, place = squeeze(raw)
    begin = np.searchsorted(place, offsets)
    at, item, pos = index.hits(data)
    row = np.searchsorted(begin, at, side="right") - 1
    inside = at + Q <= begin[row + 1]  # the q-gram is of one row
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: dict[tuple[int, int], set[tuple[int, int]]] = {}
    if not inside.any():
        return []
    row, at, item, pos = row[inside], at[inside], item[inside], pos[inside]
    for r, i, band, first, last in index.windows(row, at - begin[row], item, pos).T.tolist():
        if (r, i) not in found:
            got = index.verify(data[begin[r]:begin[r + 1]], i, band, first, last, tried.setdefault((r, i), set()))
            if got is not None:
                found[r, i] = got
    return [(r, i, edits, int(place[begin[r] + a] - offsets[r]), int(place[begin[r] + b - 1] - offsets[r]) + 1)
            for (r, i), (edits, a, b) in sorted(found.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Distinct items in blocks of about BLOCK_BYTES; one block if all fit."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def leaked_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end (characters of the document's text)
    of every leaked item of every document, its first verified region each."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start long, end long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        out = out.union(_search(docs, spark.sparkContext.broadcast(Index(block)), schema))
    return out


def _search(docs: DataFrame, shared, schema: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for top, raw, offsets in text_chunks(batch.column(1)):
                got = matches(index, raw, offsets)
                if got:
                    chars = lambda r, b: len(raw[offsets[r]:offsets[r] + b].tobytes().decode(errors="ignore"))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([top + g[0] for g in got])),
                         pa.array([index.ids[g[1]] for g in got]), pa.array([g[2] for g in got], pa.int32()),
                         pa.array([chars(g[0], g[3]) for g in got]), pa.array([chars(g[0], g[4]) for g in got])],
                        names=["doc_id", "item_id", "edits", "start", "end"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; filtered where they lie."""
    names, text = docs.columns, docs.columns.index("text")
    for block in item_blocks(benchmark):
        docs = _filter(docs, docs.sparkSession.sparkContext.broadcast(Index(block)), text)
    return docs.select(names)


def _filter(docs: DataFrame, shared, text: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for top, raw, offsets in text_chunks(batch.column(text)):
                keep = np.ones(len(offsets) - 1, bool)
                keep[[g[0] for g in matches(index, raw, offsets)]] = False
                yield batch.slice(top, len(keep)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
