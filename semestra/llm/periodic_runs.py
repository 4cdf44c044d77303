"""Periodic runs of words by an online sparse diagonal DP.

A word met again at lag d prolongs the match length of diagonal d by one; where
a diagonal ends, its run is emitted if it is long enough. What makes the DP
sparse is the choice of earlier occurrences. A word is looked up together with
the words that follow it, in windows of 1, 2, 4, 8, ... words, and only the
nearest earlier occurrence of a window of L words counts, at a lag of over L/2
and up to L words. No other lag can be the smallest period of a run there: a
nearer occurrence would give the stretch between two occurrences two periods
whose sum it reaches, hence a smaller common one (Fine and Wilf). So a word
prolongs one diagonal at most for each window size, where all its earlier
occurrences would make a text of one repeated word cost the square of its
length; and a diagonal's stretch is a run whole, with its smallest period.

Windows are named exactly, a window of 2L words by the names of its halves, and
a window that stands once in its text is never looked at again. A text of n
words takes O(n log n) steps a window size, and log n sizes at most. Each text
is worked on whole, by one task, in memory in proportion to its length.

Defined results: null and empty texts, and texts of white space, have no runs
and collapse to ''. Rows with a null or repeated doc_id are treated like any
other; an empty table gives an empty result. Columns named ``runs`` or
``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
_PART_BYTES = 2 << 20  # bytes of short texts worked on at a time
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _names(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number for each distinct word of each text, all texts one after
    another with a number of its own after each; and where each text begins."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) + 1 for words in texts], out=starts[1:])
    names = np.empty(starts[-1], np.int64)
    used = 0
    for words, a in zip(texts, starts):
        number = dict(zip(dict.fromkeys(words), range(used, used + len(words))))
        names[a:a + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        names[a + len(words)] = used + len(number)
        used += len(number) + 1
    return names, starts


def diagonals(names: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) rows of all runs in a sequence of numbers."""
    found = []
    place, key, size = np.arange(len(names)), names, 1
    while len(place):
        order = np.argsort(key, kind="stable")  # equal windows together, in text order
        at, ranked = place[order], key[order]
        again = np.zeros(len(at), bool)
        np.equal(ranked[1:], ranked[:-1], out=again[1:])
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(again[1:], at[1:] - at[:-1], 0)
        lag[(2 * lag <= size) | (lag > size)] = 0
        # The match length of a diagonal is that of a stretch of equal lags.
        hit = np.flatnonzero(lag)
        if len(hit):
            i, d = place[hit], lag[hit]
            first = np.ones(len(hit), bool)
            first[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])
            begin = np.flatnonzero(first)
            matched = np.diff(np.append(begin, len(hit)))
            d, i = d[begin], i[begin]
            length = matched + size - 1 + d
            keep = length >= np.maximum(min_length, min_exponent * d)
            found.append(np.stack([i - d, length, d], axis=1)[keep])
        # Windows of twice the size: of two that stand in the text again.
        alone = ~again
        alone[:-1] &= ~again[1:]
        number = np.full(len(names) + size, -1, np.int64)
        number[at] = np.where(alone, -1, np.cumsum(~again) - 1)
        place = place[(number[place] >= 0) & (number[place + size] >= 0)]
        key = number[place] * len(names) + number[place + size]
        size *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _work(column: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    texts = [t.split() if t else [] for t in column.cast(pa.binary()).to_pylist()]  # bytes split at ASCII white space only
    names, starts = _names(texts)
    runs = diagonals(names, min_length, min_exponent)
    of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[of]
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    collapsed = [_collapse(words, runs[a:b]).decode() for words, a, b in zip(texts, ends, ends[1:])]
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(collapsed, pa.string())


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of about _PART_BYTES of text; a longer text is a slice of its own."""
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at)])
    row = 0
    while row < len(sizes):
        base = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, base + _PART_BYTES, side="right")))
        yield batch.slice(row, end - row)
        row = end


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with runs array<struct<start, length, period>> and collapsed.

    A run is a stretch of the text's words (split at ASCII white space, numbered
    from 0) with smallest period q and at least max(min_length, min_exponent * q)
    words that no neighbouring word extends keeping that period; runs come by
    start, then period. ``collapsed`` is the text without the words that stand in
    a run after its first q. ``min_exponent`` is 3 or more."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *_work(part.column(at), min_length, min_exponent)],
                                                 names=[*names, "runs", "collapsed"])

    plain = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text; in the documents whose crc32 of doc_id ends in 0, each word
    i >= a is word a + (i - a) % p of the text, with a and p from the crc32 and
    the number of words. A null doc_id, or a text without words, changes nothing."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", code.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    sized = words.withColumns({"n": n, "a": F.when(n > 0, F.pmod(g, n))}).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), rest.cast("int"))), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The longest run (ties: smallest start, then period); null without runs."""
    order = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(order)
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
