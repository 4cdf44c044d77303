"""Aggregation operators (A1-A14). All are hash aggregates with map-side
partial aggregation, so a hot key is pre-combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.functions.numeric import PASS_GRADE, safe_ratio


def count_if(cond: Column) -> Column:
    """A2/A9 building block: one-pass conditional count."""
    return F.count(F.when(cond, F.lit(1)))


def mean_of_flag(cond: Column) -> Column:
    """Mean of a 0/1 CASE; a null condition counts as 0."""
    return F.avg(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def fail_rate(grade: Column) -> Column:
    """Share of rows with grade < 70 (null grade counts as 0)."""
    return mean_of_flag(grade < PASS_GRADE)


def pass_rate(grade: Column) -> Column:
    """Share of rows with grade >= 70 (null grade counts as 0)."""
    return mean_of_flag(grade >= PASS_GRADE)


def two_level_mean(df: DataFrame, inner_keys: Sequence[str], outer_keys: Sequence[str],
                   value: str, count_col: str | None = None,
                   prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """A5: per inner group (sum, count, mean), then per outer group
    sum(sum)/sum(count) -- a weighted mean, not a mean of means.

    Returns (inner, outer). ``count_col`` is the column counted (non-null);
    by default rows are counted.
    """
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    inner = (df.groupBy(*inner_keys)
             .agg(F.sum(value).alias(f"{prefix}sum"), cnt.alias(f"{prefix}n"))
             .withColumn(f"{prefix}mean", safe_ratio(f"{prefix}sum", f"{prefix}n")))
    outer = (inner.groupBy(*outer_keys)
             .agg(F.sum(f"{prefix}sum").alias(f"{prefix}sum_total"),
                  F.sum(f"{prefix}n").alias(f"{prefix}n_total"))
             .withColumn(f"{prefix}mean_total",
                         safe_ratio(f"{prefix}sum_total", f"{prefix}n_total")))
    return inner, outer


def distinct_count(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Exact distinct count per group (Spark plans it as a two-level
    aggregate: distinct (keys, col) first, so no set is built per group)."""
    return df.groupBy(*keys).agg(F.count_distinct(col).alias(name))


def pivot_max(df: DataFrame, row_keys: Sequence[str], pivot_col: str,
              values: Sequence[str], value_col: str) -> DataFrame:
    """A10: rows x pivot columns. The value list is given, so no extra job
    discovers it; ``max`` makes "last write wins" deterministic."""
    return (df.groupBy(*row_keys).pivot(pivot_col, list(values))
            .agg(F.max(value_col)).orderBy(*row_keys))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order`` (ascending, later wins) as a max over a
    struct: a hash aggregate with partial aggregation, so a key holding a third
    of the rows is combined map-side instead of sorted in one task."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order],
                      *[F.col(c).alias(f"_v_{c}") for c in others])
    return (df.groupBy(*keys).agg(F.max(packed).alias("_last"))
            .select(*keys, *[F.col(f"_last._v_{c}").alias(c) for c in others]))


def shared_course_ids(catalogue: DataFrame, name: str = "materia_nombre",
                      career: str = "carrera") -> DataFrame:
    """F26 helper: distinct careers per course name, joined back."""
    n = catalogue.groupBy(name).agg(F.count_distinct(career).alias("_n_careers"))
    return catalogue.join(n, on=name, how="left")
