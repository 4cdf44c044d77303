"""Near-duplicate documents by fast similarity sketching, banding and exact
verification.

A document is the set of its distinct five-word shingles. Its sketch has ``t``
coordinates: in round i every shingle is thrown into one bin by the i-th hash
and a bin keeps the least value of the first round that reaches it; from round
t on, round t+j throws every shingle into bin j, so that after 2t rounds every
coordinate is filled. Bands of ``rows`` coordinates give bucket keys.

Documents of equal sets are one class from the start. Shingles that stand in
one class only can't be in any intersection, so a class's other shingles bound
its overlap with any class; pairs that can't reach the threshold by this bound
are never formed. Inside a bucket, classes are compared with a few leaders at a
time, those with the fewest such shingles of their own first (the text that
others were copied from comes before its altered copies); classes already in
one component are not compared again, so a bucket of m near copies costs about
m comparisons and not m^2. Leaders go on until every bucket is of one component
or every pair in it has been compared: no cap, no sampling.

Defined results: null or empty text, or text without words: no shingle, linked
with nothing, its own component. Rows with a null doc_id take no part: their
component is null and they are kept. Rows that repeat a doc_id are one document,
linked if any of its texts is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semestra.llm.components import connected_components
from semestra.llm.hashing import long_array, mix, seeds, shingles, text_chunks
from semestra.llm.workers import tidy
from semestra.session import drop_written, materialize

WORDS = 5
BANDS, ROWS = 25, 5  # a pair at 0.85 misses all 25 bands with chance 4e-7, at 0.80 with 5e-5
LEADERS = (1, 16, 256, 1000)  # of a bucket, by round; the last repeats
_LOW = np.uint64((1 << 40) - 1)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Sketches (documents x t) of non-empty shingle sets, all at once."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    seed = seeds(t, 11)
    live = np.arange(len(sets))
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(live, sizes)
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(items ^ seed[i % t] ^ np.uint64(i // t))
        if i < t:
            bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            bins = np.full(len(h), i - t)
        np.minimum.at(flat, owner * t + bins, (np.uint64(i) << np.uint64(40)) | (h & _LOW))
        if i < 8 or i % 4 == 0:
            still = (out[live] == np.iinfo(np.uint64).max).any(axis=1)
            if not still.all():
                keep = np.zeros(len(sets), bool)
                keep[live[still]] = True
                mask = keep[owner]
                items, owner, live = items[mask], owner[mask], live[still]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    coef = seeds(rows, 12) | np.uint64(1)
    cut = sketches.reshape(len(sketches), bands, rows)
    return mix((cut * coef).sum(axis=2, dtype=np.uint64) + seeds(bands, 13))


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, the 128-bit signature (s1, s2) of the set, band keys."""
    k1, k2 = seeds(2, 14)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in text_chunks(batch.column(1)):
                sets = shingles(raw, offsets, words)
                n = np.fromiter((len(s) for s in sets), np.int64, len(sets))
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(sketch(full, bands * rows), bands, rows) if full else [])
                sums = [np.array([mix(s ^ k).sum(dtype=np.uint64) for s in sets], np.uint64) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array(n),
                     *(pa.array(s.view(np.int64)) for s in sums),
                     long_array([next(keys) if m else np.zeros(0, np.uint64) for m in n])],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """node, items: the whole shingle set of every document of ``docs``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in text_chunks(batch.column(1)):
                sets = shingles(raw, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), long_array(sets)], names=["node", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "node long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return (pairs.join(right, "b").join(left, "a")
            .select("a", "b", F.size("ia").alias("na"), F.size("ib").alias("nb"), both.alias("both"))
            .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links
    are pairs with 100 * |intersection| >= percent * |union|."""
    spark = docs.sparkSession
    written: list[str] = []
    made = materialize(sketches(docs, words, bands, rows), "sketches")
    sig = ["s1", "s2", "n_shingles"]
    classes = (made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
               .groupBy(*sig).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    classes = materialize(classes, "classes", written)
    rows_ = classes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
    shared = rows_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    bucket = materialize(rows_.join(shared, "key"), "buckets", written)
    wanted = bucket.select(F.col("node").alias("doc_id")).distinct()
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), words)
                       .distinct().where(F.size("items") > 0), "sets", written)

    own = (sets.select("node", F.explode("items").alias("item")).groupBy("item")
           .agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m")).where("m = 1")
           .groupBy("node").agg(F.count(F.lit(1)).alias("own"))
           # The shingles of a doc_id's texts together bound none of its classes.
           .join(sets.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m = 1").select("node"), "node"))
    # Null where a doc_id has several texts: such a class answers in every bucket.
    bands_of = classes.groupBy("node").agg(F.when(F.count(F.lit(1)) == 1, F.min("bands")).alias("bands"))
    bucket = (bucket.join(bands_of, "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
              .where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
              .withColumn("comp", F.col("node")))
    # A doc_id with several texts links the classes of all of them.
    many = (made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(F.struct(*sig)).alias("lo"), F.max(F.struct(*sig)).alias("hi")).where("lo != hi").select("doc_id"))
    member = materialize(made.join(many, "doc_id", "left_semi").join(classes, sig).select("doc_id", "node").distinct(), "member", written)
    links = labels = None
    if not member.isEmpty():
        least = member.groupBy("doc_id").agg(F.min("node").alias("u"))
        links = materialize(member.join(least, "doc_id").where("u != node").select("u", F.col("node").alias("v")).distinct(), "links", written)
        labels = materialize(connected_components(links), "labels", written)
        bucket = bucket.drop("comp").join(labels, "node", "left").select(
            "key", "node", "n", "own", "bands", F.coalesce("component", "node").alias("comp"))
    turn = 0
    while True:
        # Buckets of one component have nothing left to compare.
        open_ = bucket.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
        live = materialize(bucket.join(open_, "key"), "live", written)
        if live.isEmpty():
            break
        most = LEADERS[min(turn, len(LEADERS) - 1)]
        turn += 1
        order = Window.partitionBy("key").orderBy("own", "node")
        first = live.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= most)
        lead = materialize(first.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa"),
                                        F.col("comp").alias("ca"), F.col("bands").alias("ba")), "lead", written)
        later = (F.col("own") > F.col("oa")) | ((F.col("own") == F.col("oa")) & (F.col("node") > F.col("a")))
        bound = F.least(F.col("na") - F.col("oa"), F.col("n") - F.col("own"))
        reachable = (100 + percent) * bound >= percent * (F.col("na") + F.col("n"))
        # Two classes may share many buckets: the first of them answers for the pair.
        here = F.coalesce(F.get(F.array_intersect("ba", "bands"), 0) == F.col("key"), F.lit(True))
        pairs = (live.join(lead, "key").where(later & (F.col("comp") != F.col("ca")) & reachable & here)
                 .select("a", F.col("node").alias("b")))
        pairs = materialize(pairs, "pairs", written)
        found = _verified(pairs, sets, percent)
        links = found if links is None else links.union(found)
        links = materialize(links, "links", written)
        labels = materialize(connected_components(links), "labels", written)
        # Leaders have met their whole bucket: they leave it.
        bucket = (live.drop("comp").join(lead.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
                  .join(labels, "node", "left").select("key", "node", "n", "own", "bands", F.coalesce("component", "node").alias("comp")))
    named = classes.select(*sig, "node")
    if labels is not None:
        named = named.join(labels, "node", "left").select(*sig, F.coalesce("component", "node").alias("c"))
    else:
        named = named.select(*sig, F.col("node").alias("c"))
    # A document with several texts is in several classes: the least names it.
    named = materialize(named.groupBy(*sig).agg(F.min("c").alias("c")), "named")
    drop_written(spark, written)
    out = made.drop("bands").join(named, sig, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least doc_id."""
    found = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
