"""Sorts, limits and top-k (T1-T5) and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int,
          tie_keys: Sequence[str] = ()) -> DataFrame:
    """The k first rows of a total order. ``orderBy + limit`` plans as
    TakeOrderedAndProject: each partition keeps its own k, then one merge of
    k x partitions rows -- never a full sort. Keys break ties."""
    return df.orderBy(*order, *[F.col(c).asc() for c in tie_keys]).limit(k)


def top_and_bottom(df: DataFrame, value: str, k: int, tie_keys: Sequence[str],
                   label_col: str = "ranking",
                   top_label: str = "Top 5", bottom_label: str = "Bottom 5") -> DataFrame:
    """K highest and k lowest rows tagged, unioned by name, sorted by
    value descending (a row may appear in both when there are < 2k rows)."""
    top = top_k(df, [F.desc(value)], k, tie_keys).withColumn(label_col, F.lit(top_label))
    bottom = top_k(df, [F.asc(value)], k, tie_keys).withColumn(label_col, F.lit(bottom_label))
    return top.unionByName(bottom).orderBy(F.desc(value), *tie_keys, label_col)


def first_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """T4: the reference's arbitrary ``limit(n)`` made deterministic."""
    return df.orderBy(key).limit(n)


def numeric_text_order(col: str) -> Column:
    """T5: sort a text key by its integer value (junk sorts last)."""
    return F.col(col).cast("string").try_cast("int").asc_nulls_last()


def union_all_by_name(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """U1/U2."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key set (keys may be arrays); the survivor is the
    smallest remaining row, so the result does not depend on partitioning."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    return (df.groupBy(*keys)
            .agg(F.min(F.struct(*[F.col(c) for c in others])).alias("_s"))
            .select(*keys, *[F.col(f"_s.{c}").alias(c) for c in others]))
