"""Dashboard tables (Q7-Q10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.functions.numeric import percent_if_fraction
from semestra.operators.aggregates import distinct_count, fail_rate, pass_rate, pivot_max
from semestra.operators.ordering import numeric_text_order, top_and_bottom, top_k
from semestra.plans.demand import ACTIVE

TOP_K = 5             # fixed value: five courses / teachers per chart
MIN_SECTIONS = 10     # fixed value: teachers need more than 10 sections


def enrolment_base(enrolments: DataFrame, sections: DataFrame) -> DataFrame:
    """Every enrolment (dropped ones included) with its section; grade as
    double."""
    return (enrolments.join(sections, "grupo_id", "inner")
            .withColumn("calificacion_final",
                        F.col("calificacion_final").cast("string").try_cast("double")))


def bottleneck_courses(enrolments: DataFrame, sections: DataFrame, k: int = TOP_K) -> DataFrame:
    """Q7: the k courses with the highest fail rate (grade < 70; a null grade
    counts as not failed but stays in the denominator, D16); ties by name."""
    base = enrolment_base(enrolments.select("grupo_id", "calificacion_final"),
                          sections.select("grupo_id", "materia_nombre"))
    rates = base.groupBy("materia_nombre").agg(
        fail_rate(F.col("calificacion_final")).alias("tasa_reprobacion"))
    return top_k(rates, [F.desc("tasa_reprobacion")], k, ["materia_nombre"])


def active_enrolment_trend(students: DataFrame) -> DataFrame:
    """Q8: distinct active students per (term, career)."""
    act = students.filter(F.col("estado") == ACTIVE)
    return (distinct_count(act, ["semestre_historico", "carrera"], "alumno_id",
                           "num_alumnos_activos")
            .orderBy("semestre_historico", "carrera"))


def enrolment_trend_pivot(trend: DataFrame, careers: Sequence[str]) -> DataFrame:
    """Q8 + A10: one row per term, one column per career."""
    return pivot_max(trend, ["semestre_historico"], "carrera", careers, "num_alumnos_activos")


def hour_bias(enrolments: DataFrame, sections: DataFrame) -> DataFrame:
    """Q9: pass rate and enrolment count per section start hour, by hour
    as a number (T5)."""
    base = enrolment_base(enrolments.select("grupo_id", "calificacion_final"),
                          sections.select("grupo_id", "hora_inicio_promedio"))
    return (base.groupBy("hora_inicio_promedio")
            .agg(pass_rate(F.col("calificacion_final")).alias("tasa_aprobacion_promedio"),
                 F.count(F.lit(1)).alias("total_inscripciones"))
            .orderBy(numeric_text_order("hora_inicio_promedio")))


def teacher_extremes(enrolments: DataFrame, sections: DataFrame, teachers: DataFrame,
                     k: int = TOP_K, min_sections: int = MIN_SECTIONS) -> DataFrame:
    """Q10: teachers with more than ``min_sections`` sections: the k best and
    k worst by mean grade, tagged, unioned and sorted (ties by teacher id)."""
    grade = F.col("calificacion_final").cast("string").try_cast("double")
    # A row per section before the join; a teacher's mean is of all grades, not of sections.
    graded = enrolments.groupBy("grupo_id").agg(F.sum(grade).alias("suma"), F.count(grade).alias("notas"))
    per = graded.join(sections.select("grupo_id", "profesor_id"), "grupo_id").groupBy("profesor_id").agg(
        F.try_divide(F.sum("suma"), F.sum("notas")).alias("calificacion_promedio"),
        F.count_distinct("grupo_id").alias("total_grupos_impartidos"))
    eligible = (per.filter(F.col("total_grupos_impartidos") > min_sections)
                .join(teachers.select("profesor_id", "nombre_profesor"), "profesor_id", "inner"))
    both = top_and_bottom(eligible, "calificacion_promedio", k, ["profesor_id"])
    return both.select("nombre_profesor", "calificacion_promedio",
                       "total_grupos_impartidos", "ranking")


def hour_bias_chart(bias: DataFrame) -> DataFrame:
    """F17 + T5: the pass-rate chart's rows: hour and rate in percent with one
    decimal, ordered by hour as a number."""
    return (bias.select("hora_inicio_promedio",
                        percent_if_fraction("tasa_aprobacion_promedio").alias("tasa_pct"))
            .orderBy(numeric_text_order("hora_inicio_promedio")))
