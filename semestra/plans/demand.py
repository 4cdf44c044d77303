"""Potential demand per course (Q4 history, Q11 current).

Eligibility is a relational division: a student may take a course when every
prerequisite is among the courses passed. The catalogue is written with a
course's prerequisites as a list, small enough that Spark's own threshold
broadcasts it; a student row meets the courses of its career and is tested
against each in compiled code. The tests are added up where the students are
read, so neither a pair of student and course nor a student's state is ever
shuffled or written; what is shuffled are partial sums per course and term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semestra.session import materialize

ACTIVE = "Activo"  # fixed value: state of an enrolled student
MIN_DEMAND = 15    # fixed value: courses below 15 eligible students are not offered


def catalogue_rows(courses: DataFrame) -> tuple[DataFrame, int]:
    """(carrera_materia, materia_nombre, semestre_materia, ``open``, ``pre``: the
    prerequisites; ``open`` is false where one is null, which is never met; the
    most prerequisites of a course). Written, so that the planner knows its size."""
    pre = F.coalesce("prerequisitos", F.array().cast("array<string>"))
    rows = courses.where(F.col("carrera").isNotNull()).select(
        F.col("carrera").alias("carrera_materia"), "materia_nombre",
        F.col("semestre_materia").cast("int").alias("semestre_materia"),
        F.forall(pre, lambda x: x.isNotNull()).alias("open"),
        F.array_distinct(F.filter(pre, lambda x: x.isNotNull())).alias("pre"))
    rows = materialize(rows, "catalogue")
    return rows, rows.agg(F.max(F.size("pre"))).first()[0] or 0


def _tested(students: DataFrame, courses: DataFrame, exclude_passed: bool) -> DataFrame:
    """Active students with each course of their career up to their semester (as
    integers, D1) and ``ok``: whether they may take it. The prerequisites are
    tested one by one, without a lambda, so the test stays in compiled code."""
    rows, most = catalogue_rows(courses)
    both = students.filter(F.col("estado") == ACTIVE).join(
        rows, (F.col("carrera") == F.col("carrera_materia"))
        & (F.col("semestre_actual").cast("int") >= F.col("semestre_materia")))

    def passed(name: Column) -> Column:
        return F.coalesce(F.array_contains("materias_aprobadas", name), F.lit(False))

    ok = F.col("open")
    for k in range(most):
        ok = ok & (F.get("pre", F.lit(k)).isNull() | passed(F.get("pre", F.lit(k))))
    return both.withColumn("ok", ok & ~passed(F.col("materia_nombre")) if exclude_passed else ok)


def potential_demand_history(students: DataFrame, courses: DataFrame,
                             exclude_passed: bool = True) -> DataFrame:
    """Q4: per (course, career, course semester, term), how many active
    students could take the course: same career, semester >= the course's
    (as integers, D1), all prerequisites passed (J9) and, by default, not
    already passed (D2). Groups whose sum is 0 are kept. Not sorted."""
    rows = _tested(students, courses, exclude_passed)
    return (rows.groupBy("materia_nombre", "carrera", "semestre_materia",
                         F.col("semestre_historico").alias("periodo_historico"))
            .agg(F.sum(F.col("ok").cast("long")).alias("demanda_potencial")))


def current_demand(snapshot: DataFrame, courses: DataFrame,
                   min_demand: int = MIN_DEMAND) -> DataFrame:
    """Q11: demand of the current snapshot: eligible active students per
    (course, semester, career), kept when >= min_demand. Not sorted."""
    rows = _tested(snapshot, courses, True).where("ok")
    return (rows.groupBy("materia_nombre", "semestre_materia", "carrera_materia")
            .agg(F.count(F.lit(1)).alias("demanda_real"))
            .filter(F.col("demanda_real") >= min_demand))


def by_demand(demand: DataFrame) -> DataFrame:
    """Q11 as it is listed: the largest demand first."""
    return demand.orderBy(F.desc("demanda_real"), "materia_nombre", "carrera_materia")


def by_term(demand: DataFrame) -> DataFrame:
    """Q4 as it is listed: by term, semester and course."""
    return demand.orderBy("periodo_historico", "semestre_materia", "materia_nombre", "carrera")
