"""Course catalogue and student snapshot normalisation, snapshot progression
and the live enrolment context (Q1, Q2, Q18, Q19)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.functions.text import (clean_name_array, clean_str_cols, normalize_course_schema,
                                     parse_name_list, parse_prereqs, upper_name)
from semestra.operators.joins import latest_key_semi
from semestra.operators.ordering import distinct_on, union_all_by_name
from semestra.plans.demand import ACTIVE

GRADUATED = "Egresado"  # fixed value: state after passing every course


def _clean_catalogue(raw: DataFrame, career: str | None) -> DataFrame:
    """P1, P2, P3, F4 and the career tag (P4) for one raw catalogue; a
    ``carrera`` column already present is kept (cleaned) when career is None."""
    clean = clean_str_cols(raw)
    tag = F.lit(career) if career is not None else F.col("carrera")
    df = normalize_course_schema(clean.withColumn("_carrera", tag))
    return df.select(
        upper_name("materia_nombre").alias("materia_nombre"),
        F.col("semestre_materia").try_cast("int").alias("semestre_materia"),
        parse_prereqs("prerequisitos_raw").alias("prerequisitos"),
        F.col("_carrera").alias("carrera"))


def course_rows(catalogues: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """Q1 without its order, for use inside other plans: raw catalogues -> one
    clean catalogue.

    ``catalogues`` is one raw frame per career (the key is the career), or
    one frame that already carries a ``carrera`` column. P1 clean text, P2
    common schema, P3 upper-case names, F4 prerequisite arrays, P4 career
    tag, U1 union by name, U3 one row per (name, prerequisites, career) with
    a deterministic survivor.
    """
    if isinstance(catalogues, DataFrame):
        merged = _clean_catalogue(catalogues, None)
    else:
        merged = union_all_by_name([_clean_catalogue(raw, career)
                                    for career, raw in catalogues.items()])
    return distinct_on(merged, ["materia_nombre", "prerequisitos", "carrera"])


def normalize_courses(catalogues: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """Q1: the clean catalogue (``course_rows``) by semester, name and career."""
    return course_rows(catalogues).orderBy("semestre_materia", "materia_nombre", "carrera")


def normalize_students(snapshots: DataFrame) -> DataFrame:
    """Q2: passed-course text (F1) -> clean upper-case array (F2); semester
    as integer."""
    return (snapshots
            .withColumn("materias_aprobadas",
                        clean_name_array(parse_name_list("materias_aprobadas_json")))
            .withColumn("semestre_actual",
                        F.col("semestre_actual").cast("string").try_cast("int"))
            .drop("materias_aprobadas_json"))


def next_snapshot(students: DataFrame, new_passes: DataFrame,
                  courses_per_career: DataFrame,
                  keys: tuple[str, ...] = ("alumno_id",)) -> DataFrame:
    """Q18: the next term's snapshot. Newly passed courses join the passed
    set; an active student who has passed at least as many courses as the
    career has graduates, otherwise moves up one semester. Other states and
    unknown careers are unchanged.

    ``new_passes``: (keys..., materia_nombre); ``courses_per_career``:
    (carrera, total_materias). ``keys`` identify a snapshot row (add the term
    when the table holds several terms). The per-student set is bounded by
    the catalogue, and collect_set combines map-side.
    """
    keys = list(keys)
    new = new_passes.groupBy(*keys).agg(F.collect_set("materia_nombre").alias("_new"))
    s = (students.join(new, keys, "left")
         .join(courses_per_career, "carrera", "left")
         .withColumn("materias_aprobadas",
                     F.array_union(F.coalesce("materias_aprobadas", F.array().cast("array<string>")),
                                   F.coalesce("_new", F.array().cast("array<string>")))))
    moves = (F.col("estado") == ACTIVE) & F.col("total_materias").isNotNull()
    done = F.size("materias_aprobadas") >= F.col("total_materias")
    return (s.withColumn("estado", F.when(moves & done, F.lit(GRADUATED)).otherwise(F.col("estado")))
            .withColumn("semestre_actual",
                        F.when(moves & ~done, F.col("semestre_actual") + 1)
                        .otherwise(F.col("semestre_actual")))
            .drop("_new", "total_materias"))


def live_context(students: DataFrame, enrolments: DataFrame, sections: DataFrame) -> DataFrame:
    """Q19: enrolments of active students in sections of the latest term,
    with the section's columns (J7): one join with the latest term's sections."""
    active = students.filter(F.col("estado") == ACTIVE).select("alumno_id").distinct()
    current = latest_key_semi(sections, "semestre_historico")
    return enrolments.join(active, "alumno_id", "left_semi").join(current, "grupo_id")
