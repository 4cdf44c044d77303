"""Key-value table semantics over Parquet/DataFrames.

The reference keeps its results in a key-value store; here a table is a
DataFrame, a point read is a filter on the key (pushed to the Parquet scan),
and writes are either a full refresh or an upsert log resolved by
"last write per key wins".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.operators.aggregates import latest_by
from semestra.session import drop_written, materialize


BUCKETS = 64  # partitions of a stored table


def bucket_of(keys: Sequence[Column], buckets: int = BUCKETS) -> Column:
    """The partition of a key. Of a literal key it is a constant, so a filter on
    it prunes the scan to one folder."""
    return F.pmod(F.xxhash64(*[k.cast("string") for k in keys]), F.lit(buckets)).cast("int")


def write_store(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """A stored table: partitioned by the bucket of its keys, one sorted file a
    bucket, so a lookup skips row groups within it. Keys are unique."""
    _put(df.withColumn("bucket", bucket_of([F.col(k) for k in keys], buckets)), path, keys, buckets)


def _put(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    (df.repartition(buckets, "bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def scan_store(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Full scan."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(path).drop("bucket")


def lookup_store(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence, buckets: int = BUCKETS) -> DataFrame:
    """Get by key from a stored table: one partition is listed and read."""
    cond = F.col("bucket") == bucket_of([F.lit(v) for v in values], buckets)
    for k, v in zip(keys, values):
        cond = cond & (F.col(k) == F.lit(v))
    return spark.read.parquet(path).where(cond).drop("bucket")


def _replace(spark: SparkSession, path: str, rows: DataFrame, touched: list[int], keys: Sequence[str], buckets: int) -> None:
    """Rewrite the touched partitions by ``rows``; those left without rows go."""
    rows = materialize(rows, "store")  # the partitions are read and overwritten
    _put(rows, path, keys, buckets)
    kept = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most the number of buckets
    drop_written(spark, [f"{path}/bucket={b}" for b in touched if b not in kept])


def merge_store(changes: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], op_col: str = "op",
                delete_value: str = "delete", buckets: int = BUCKETS) -> list[int]:
    """S14 into a stored table: the last entry of a key wins (``upsert_latest``),
    a delete removes it. Stored rows count as older than any change, so a merge
    that is done again gives the same table. Only the partitions of changed keys
    are read and rewritten; returns them."""
    spark = changes.sparkSession
    last = materialize(latest_by(changes, keys, order)
                       .withColumn("bucket", bucket_of([F.col(k) for k in keys], buckets)), "changes")
    touched = sorted(r.bucket for r in last.select("bucket").distinct().collect())
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    kept = old.join(last.select("bucket", *keys), ["bucket", *keys], "left_anti")
    puts = last.where(F.coalesce(F.col(op_col) != F.lit(delete_value), F.lit(True)))
    rows = kept.unionByName(puts.select(*old.columns))
    if touched:
        _replace(spark, path, rows, touched, keys, buckets)
    return touched


def refresh_store(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """S13 into a stored table: afterwards it holds the rows of ``df`` and no
    others. Partitions whose rows are the same (by count and sums of row hashes)
    are left alone; returns those rewritten."""
    spark = df.sparkSession
    new = materialize(df.withColumn("bucket", bucket_of([F.col(k) for k in keys], buckets)), "refresh")
    old = spark.read.parquet(path).select(*new.columns)

    def digest(rows: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in df.columns])
        return rows.groupBy("bucket").agg(F.struct(
            F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(row, 20)).alias("high"),
            F.sum(row.bitwiseAND(F.lit((1 << 20) - 1))).alias("low"), F.bit_xor(row).alias("x")).alias(name))

    both = digest(new, "a").join(digest(old, "b"), "bucket", "full_outer")
    touched = sorted(r.bucket for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())
    if touched:
        _replace(spark, path, new.where(F.col("bucket").isin(touched)), touched, keys, buckets)
    return touched


def key_lookup(df: DataFrame, **key_values) -> DataFrame:
    """Get by key (equality filters, pushed down to the scan)."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def key_range(df: DataFrame, partition_key: str, value, sort_key: str) -> DataFrame:
    """Query one partition key, rows sorted by the sort key."""
    return df.filter(F.col(partition_key) == F.lit(value)).orderBy(sort_key)


# Defaults used when a loaded suggestion lacks a field.
DEFAULT_TERM = "2025-1"
UNKNOWN_GROUP = "UNKNOWN"


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def replace_table_rows(df: DataFrame) -> DataFrame:
    """The projection a full refresh writes: semestre_id (semestre as
    text, else '2025-1'), grupo_id (grupo, else id, else 'UNKNOWN'),
    materia_nombre (materia, else materia_nombre). Written with
    mode('overwrite')."""
    return df.select(
        "*",
        F.coalesce(_opt(df, "semestre").cast("string"), F.lit(DEFAULT_TERM)).alias("_semestre_id"),
        F.coalesce(_opt(df, "grupo").cast("string"), _opt(df, "id").cast("string"),
                   F.lit(UNKNOWN_GROUP)).alias("_grupo_id"),
        F.coalesce(_opt(df, "materia"), _opt(df, "materia_nombre")).alias("_materia_nombre"),
    ).drop(*[c for c in ("semestre_id", "grupo_id", "materia_nombre") if c in df.columns]) \
     .withColumnRenamed("_semestre_id", "semestre_id") \
     .withColumnRenamed("_grupo_id", "grupo_id") \
     .withColumnRenamed("_materia_nombre", "materia_nombre")


def upsert_latest(log: DataFrame, keys: Sequence[str], order: Sequence[str],
                  op_col: str = "op", delete_value: str = "delete") -> DataFrame:
    """Resolve a change log. For each key the last entry by ``order``
    wins; if that entry is a delete, the key is absent.

    A grouped max over a struct (partial aggregation), not a window: a key
    holding a third of the log is combined on the map side.
    """
    last = latest_by(log, keys, order)
    return last.filter(F.coalesce(F.col(op_col) != F.lit(delete_value), F.lit(True)))


def field_fallback(df: DataFrame, first: str, second: str, default) -> Column:
    """The first truthy of two fields as text, by the column's type: text
    counts unless empty, a number unless zero or NaN, a boolean if true."""
    kinds = dict(df.dtypes)

    def truthy(name: str) -> Column:
        c, kind = _opt(df, name), kinds.get(name, "string")
        if kind == "boolean":
            ok = c
        elif kind == "string":
            ok = c != ""
        elif kind in ("float", "double"):
            ok = (c != 0) & ~F.isnan(c)
        elif kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "decimal"):
            ok = c != 0
        else:
            ok = c.isNotNull()
        return F.when(ok, c.cast("string"))
    return F.coalesce(truthy(first), truthy(second), F.lit(default).cast("string"))


def coerce_for_store(df: DataFrame, text_fields: Sequence[str] = (),
                     int_fields: Sequence[str] = (), avg_field: str | None = None) -> DataFrame:
    """An average is stored as text; declared text/int fields are cast
    only when present."""
    out = df
    if avg_field and avg_field in out.columns:
        out = out.withColumn(avg_field, F.col(avg_field).cast("string"))
    for c in text_fields:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    for c in int_fields:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast(T.LongType()))
    return out
