"""Grouping of spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Every word's reduced form generates its
full neighbourhood of one edit (the form itself, each deletion, replacement and
insertion of a symbol), and the neighbourhoods are joined with the reduced
vocabulary; a pair that meets is verified on the original strings. A neighbour
is a 64-bit key worked out from running sums over the reduced word, so a word of
n letters costs time and rows in proportion to n, however long it is.

Most neighbours are no reduced word at all. A bit field of fixed size (16 MB)
over the reduced vocabulary drops them before the shuffle; the join decides, so
a field too full for a large vocabulary costs rows, never results.

Spark takes the neighbours to be as small as the vocabulary's file that they are
generated from, and would send them all through the driver to broadcast them; so
tables of words are joined by sorting, whatever Spark takes them to be.

Words are near when they differ by exactly one inserted, deleted or replaced
code point. A word's form is its near word of largest count (ties: smallest in
code-point order), if that is at least ``ratio`` times its own; its root is the
end of the chain of forms, found by pointer doubling (counts at least double
along a chain, so there are few steps).

Defined results: null and empty texts have no words. Every row of a repeated
doc_id counts. Words given twice in a vocabulary count as one with the sum of
their counts; null words, and counts that are null, are left out. An empty table
gives an empty result. Other columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.llm.hashing import mix
from semestra.session import drop_written, materialize

SYMBOLS = 8                    # size of the reduced alphabet
FIELD_BITS = 27                # bits of the field over the reduced vocabulary: 16 MB
WORD = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PART = 50_000                 # letters of short words worked on at a time


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id and word, one row for each maximal run of Latin letters of every
    whole text; only A-Z are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).withColumn(
        "word", F.translate("word", upper, upper.lower()))


def with_lost_letters(words: DataFrame) -> DataFrame:
    """``words`` where a word whose crc32 of '<doc_id>:<word>' 97 divides has
    lost the letter at crc32 modulo its length. A null doc_id changes nothing."""
    code = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = F.pmod(code, F.length("word")).cast("int")
    lost = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return words.withColumn("word", F.when(code % 97 == 0, lost).otherwise(F.col("word")))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def reduced(points: np.ndarray) -> np.ndarray:
    """Symbols 1 to SYMBOLS of code points."""
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and their offsets."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


class _Sums:
    """Keys of reduced words from running sums of symbol x base ** position."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.size = np.diff(offsets).astype(np.uint64)
        self.symbol = reduced(points)
        at = np.arange(len(points)) - offsets[self.row]
        longest = int(self.size.max()) + 2 if len(self.size) else 1
        steps = np.full(longest, _BASE, np.uint64)
        steps[0] = 1
        power = np.cumprod(steps, dtype=np.uint64)
        self.power = power[at]
        running = np.concatenate([[np.uint64(0)], np.cumsum(self.symbol * self.power, dtype=np.uint64)])
        self.total = running[offsets[1:]] - running[offsets[:-1]]
        self.before = running[:-1] - running[offsets[:-1]][self.row]
        self.end_power = power[self.size.astype(np.int64)]

    def keys(self) -> np.ndarray:
        """Key of every reduced word itself."""
        return mix(self.total + self.size * np.uint64(0xC2B2AE3D27D4EB4F))

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, key) of the whole neighbourhoods, without repeats in a row."""
        row, symbol, power, before = self.row, self.symbol, self.power, self.before
        total, size = self.total[row], self.size[row]
        after = total - before - symbol * power  # what follows the letter
        salt = np.uint64(0xC2B2AE3D27D4EB4F)
        yield np.arange(len(self.size)), self.keys()
        # Deletions: the last letter of a run of equal symbols stands for all of it.
        last = np.ones(len(row), bool)
        last[:-1] = (row[1:] != row[:-1]) | (symbol[1:] != symbol[:-1])
        shorter = before + after * _BASE_INV
        yield row[last], mix(shorter[last] + (size[last] - np.uint64(1)) * salt)
        for c in range(1, SYMBOLS + 1):
            c = np.uint64(c)
            other = symbol != c  # inserting before an equal symbol is inserting after it
            r, p, s = row[other], power[other], size[other]
            yield r, mix(total[other] + (c - symbol[other]) * p + s * salt)
            grown = (total - before)[other] * _BASE + before[other] + c * p
            yield r, mix(grown + (s + np.uint64(1)) * salt)
            yield np.arange(len(self.size)), mix(self.total + c * self.end_power + (self.size + np.uint64(1)) * salt)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about _PART letters; a longer word is a slice of its own."""
    sizes = np.array([len(w) for w in batch.column(0).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        base = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, base + _PART, side="right")))
        yield batch.slice(row, end - row)
        row = end


def _with_keys(vocabulary: DataFrame) -> DataFrame:
    """word, n, key of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                keys = _Sums(*_letters(part.column(0))).keys()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _field(keyed: DataFrame) -> np.ndarray:
    """The bit field: a bit is set where a reduced word's key falls."""
    bit = F.shiftrightunsigned("key", 64 - FIELD_BITS)
    slots = keyed.groupBy(F.shiftright(bit, 6).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    found = slots.toArrow()  # at most 2 ** (FIELD_BITS - 6) rows
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return field.view(np.uint64)


def _generated(keyed: DataFrame, field) -> DataFrame:
    """key, word, n for every neighbour whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        for batch in batches:
            for part in _parts(batch):
                for row, key in _Sums(*_letters(part.column(0))).neighbours():
                    bit = key >> np.uint64(64 - FIELD_BITS)
                    hit = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
                    if hit.any():
                        rows = pa.array(row[hit])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[hit].view(np.int64)), part.column(0).take(rows), part.column(1).take(rows)],
                            names=["key", "word", "n"])

    return keyed.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n of all ordered pairs of near words of a
    vocabulary with unique words; the vocabulary is read twice."""
    spark = vocabulary.sparkSession
    keyed = _with_keys(vocabulary)
    field = spark.sparkContext.broadcast(_field(keyed))
    reduced_words = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    return (_generated(keyed, field).join(reduced_words.hint("merge"), "key")
            .where(F.abs(F.length("word") - F.length("other")) <= 1)
            .where(F.levenshtein("word", "other", 1) == 1).drop("key"))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``vocabulary``
    (word, n)."""
    spark = vocabulary.sparkSession
    written: list[str] = []
    words = materialize(vocabulary.where(F.col("word").isNotNull() & F.col("n").isNotNull())
                        .groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary", written)
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    takes = -F.col("best.m") >= ratio * F.col("n")
    forms = materialize(words.join(best.hint("merge"), "word", "left").select(
        "word", F.when(takes, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.m")).alias("form_n")), "forms", written)
    roots = _roots(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), written)
    return (forms.join(roots.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def _roots(links: DataFrame, written: list[str]) -> DataFrame:
    """word, root: every link followed to its end, doubling the steps a round.
    Written tables that no later round reads go at once."""
    spark = links.sparkSession
    now = materialize(links, "roots", written)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "roots", written)
        moved = step.where("moved").limit(1).count()
        drop_written(spark, [written.pop(-2)])
        now = step.select("word", "root")
        if not moved:
            return now
