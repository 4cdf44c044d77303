"""Join operators (J1-J11) as DataFrame -> DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.functions.schedule import slot_days, slot_hours
from semestra.functions.text import upper_name


def left_zero_fill(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
                   fills: dict[str, object]) -> DataFrame:
    """Left outer join on one or more keys, then replace nulls of the
    right-side columns with the given defaults."""
    out = left.join(right, on=on, how="left")
    return out.select(
        [F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
         for c in out.columns])


def prereqs_satisfied(prereqs, passed) -> Column:
    """Relational division as an array expression: every prerequisite is
    in the passed set (an empty list is always satisfied)."""
    pre = F.col(prereqs) if isinstance(prereqs, str) else prereqs
    got = F.col(passed) if isinstance(passed, str) else passed
    got = F.coalesce(got, F.array().cast("array<string>"))
    return F.size(F.array_except(F.coalesce(pre, F.array().cast("array<string>")), got)) == 0


def not_passed(course, passed) -> Column:
    """The course is not already in the passed set."""
    c = F.col(course) if isinstance(course, str) else course
    got = F.col(passed) if isinstance(passed, str) else passed
    return ~F.coalesce(F.array_contains(got, c), F.lit(False))


def career_semester_join(students: DataFrame, courses: DataFrame,
                         student_career: str = "carrera",
                         course_career: str = "carrera_materia",
                         student_sem: str = "semestre_actual",
                         course_sem: str = "semestre_materia") -> DataFrame:
    """Student x course of the same career with the student's semester
    >= the course's semester. Written as an equi-join on career with a range
    residual (never a cross join); whether the catalogue is broadcast is left to the
    optimiser's byte threshold."""
    cond = [F.col(student_career) == F.col(course_career),
            F.col(student_sem) >= F.col(course_sem)]
    return students.join(courses, on=cond, how="inner")


def normalized_key_join(left: DataFrame, right: DataFrame, left_key: str,
                        right_key: str, how: str = "left") -> DataFrame:
    """Exact name, else trimmed upper-case name, as one equi-join on the
    normalised key. The right side keeps one row per normalised key, preferring
    an entry that is already normalised, then the smallest key."""
    rk = "_nk"
    r = right.withColumn(rk, upper_name(right_key))
    pref = F.struct((F.col(right_key) != F.col(rk)).alias("_p"), F.col(right_key).alias("_k"))
    others = [c for c in r.columns if c != rk]
    best = (r.groupBy(rk)
            .agg(F.min(F.struct(pref.alias("_o"), *[F.col(c) for c in others])).alias("_b"))
            .select(rk, *[F.col(f"_b.{c}").alias(c) for c in others]))
    return (left.withColumn(rk, upper_name(left_key))
            .join(best, on=rk, how=how).drop(rk))


def expand_slot(df: DataFrame, slot_col: str = "str") -> DataFrame:
    """Explode a slot text into (dia, hora) rows (F12 x F13)."""
    return (df.withColumn("dia", F.explode(slot_days(slot_col)))
              .withColumn("hora", F.explode(slot_hours(slot_col))))


def drop_blocked(candidates: DataFrame, blocks: DataFrame,
                 teacher_col: str = "profesor_id", slot_col: str = "str") -> DataFrame:
    """Remove candidates whose teacher has a blocked hour on a class day.

    ``blocks`` has (profesor_id, dia, hora). Only the distinct (teacher, slot)
    pairs are exploded and probed, then the candidates are anti-joined on
    (teacher, slot), so the work is proportional to distinct pairs, not
    candidates.
    """
    pairs = candidates.select(teacher_col, slot_col).distinct()
    blk = blocks.select(F.col("profesor_id").alias(teacher_col), "dia", "hora").distinct()
    blocked = (expand_slot(pairs, slot_col)
               .join(blk, on=[teacher_col, "dia", "hora"], how="left_semi")
               .select(teacher_col, slot_col).distinct())
    return candidates.join(blocked, on=[teacher_col, slot_col], how="left_anti")


def latest_key_semi(df: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` equals the table's maximum (e.g. latest term).
    The maximum is a one-row aggregate joined back as a semi join."""
    latest = df.agg(F.max(key).alias(key))
    return df.join(F.broadcast(latest), on=key, how="left_semi")
