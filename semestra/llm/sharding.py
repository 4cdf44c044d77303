"""Sharding by extendible hashing.

A row's address is a 60-bit hash of its key. The directory is indexed by a
prefix of the address; a bucket over the byte limit is split on one more bit,
and only such buckets are, until every shard fits. Splitting works on summed
bytes per prefix, never on rows. A bucket that 60 bits can't split (many rows
of one key) is split further by a hash of a row number that is written first,
so a key with a third of all rows is spread as well.

Defined results: a null text counts as empty and a null key hashes as ''. A
single row above the limit is alone in its shard, which is marked oversize.
Repeated rows are separate rows. An empty table gives no shard. Columns of the
input named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.session import materialize

LIMIT_BYTES = 4 << 20
BITS = 60
STEP = 8  # bits more when buckets outgrow the first guess
ROW_BYTES = 16  # counted for each row besides its text
ADDED = ("shard", "depth", "row_bytes", "shard_bytes", "oversize")


def address(key: Column) -> Column:
    """First 60 bits of the MD5 of the key as text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def _cell(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("long")


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell -> depth, prefix, shard_bytes, n of the shallowest ancestor between
    ``low`` and ``high`` bits that fits; null depth where none does."""
    levels = cells.select("grp", "cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = (levels.groupBy("grp", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("rows"))
            .where((F.col("shard_bytes") <= limit) | (F.col("rows") == 1)))
    best = (levels.join(fits, ["grp", "depth", "prefix"])
            .groupBy("grp", "cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s")))
    return cells.select("grp", "cell").join(best, ["grp", "cell"], "left").select("grp", "cell", "s.*")


def _assign(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with grp, h, row_bytes) with depth, prefix, shard_bytes; and
    those that all bits couldn't place."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum("row_bytes")).first()
    cols = rows.columns
    if not n:
        empty = rows.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")})
        return empty, rows
    low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + 4)
    done, rest = None, rows
    while True:
        cells = (rest.groupBy("grp", _cell(F.col("h"), high).alias("cell"))
                 .agg(F.sum("row_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
        placed = materialize(_split(cells, low, high, limit), "directory")
        rest = rest.withColumn("cell", _cell(F.col("h"), high))
        got = rest.join(placed.where("depth IS NOT NULL"), ["grp", "cell"]).select(*cols, "depth", "prefix", "shard_bytes")
        done = got if done is None else done.unionByName(got)
        over = placed.where("depth IS NULL").select("grp", "cell")
        if over.isEmpty():
            return done, rest.limit(0).select(cols)
        rest = rest.join(over, ["grp", "cell"], "left_semi").select(cols)
        if high == BITS:
            return done, rest
        low, high = high + 1, min(BITS, high + STEP)


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``df`` with shard (the directory's bits, 'all' for none), depth,
    row_bytes, shard_bytes and oversize for every row."""
    keep = [c for c in df.columns if c not in ADDED]
    inner = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)),
                     address(F.col(key)).alias("h"), row_bytes(F.col(text)).alias("row_bytes"),
                     F.lit(0).cast("long").alias("grp"))
    done, rest = _assign(rows, limit)
    name = F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))
    out = done.withColumn("shard", F.when(F.col("depth") == 0, "all").otherwise(name))
    if not rest.isEmpty():
        # One address with too many rows: split by the rows' own numbers.
        numbered = materialize(rest.withColumn("no", F.monotonically_increasing_id()), "numbered")
        more = numbered.withColumn("grp", F.col("h")).withColumn("h", address(F.col("no")))
        more, _ = _assign(more, limit)
        whole = F.lpad(F.bin("grp"), F.lit(BITS), F.lit("0"))
        sub = F.when(F.col("depth") == 0, "").otherwise(name)
        more = more.withColumn("shard", F.concat(whole, sub)).withColumn("depth", F.col("depth") + BITS).drop("no")
        out = out.unionByName(more)
    return out.select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), "shard", "depth", "row_bytes", "shard_bytes",
                      (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write one folder per shard under ``path``."""
    sharded = shard(df, key, text, limit)
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
