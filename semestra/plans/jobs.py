"""The three batch jobs a planner runs: ETL (raw files -> catalogue,
model_ready, dashboard tables), training (model_ready -> saved model) and
prediction (model + current snapshot -> timetable, KPIs, charts).

Each job is a plain function over paths; the work inside is the DataFrame
operators of this package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.functions.text import parse_name_list_loose
from semestra.operators.ordering import numeric_text_order
from semestra.plans import attendance as att
from semestra.plans import catalog, demand, features, insights, model, model_reports, timetable
from semestra.session import materialize
from semestra.sources import files


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Raw file layouts (all CSV columns arrive as text).
ROOMS = _strings("salon_id", "nombre_salon", "capacidad_base")
TEACHERS = _strings("profesor_id", "nombre_profesor", "departamento", "calidad_simulada")
SECTIONS = _strings("grupo_id", "semestre_historico", "carrera", "materia_id", "materia_nombre",
                    "materia_semestre", "profesor_id", "profesor_calidad_simulada", "salon_id",
                    "cupo_ofrecido", "horario_json", "hora_inicio_promedio",
                    "conflicto_recurso_detectado")
ENROLMENTS = _strings("inscripcion_id", "grupo_id", "alumno_id", "calificacion_final",
                      "estado_desercion")
STUDENTS = _strings("alumno_id", "carrera", "semestre_actual", "estado",
                    "materias_aprobadas_json", "anio_ingreso")
CAREER_FILES = {"IND": "materias_IND.json", "ISC": "materias_ISC.json"}


def _drop_corrupt(df: DataFrame) -> DataFrame:
    return df.drop(files.CORRUPT_COL) if files.CORRUPT_COL in df.columns else df


def read_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The raw history."""
    r = raw_dir.rstrip("/")

    def csv(name, schema):
        return _drop_corrupt(files.read_csv_permissive(spark, f"{r}/{name}", schema))

    snaps = _drop_corrupt(files.read_snapshots(spark, f"{r}/snapshots/*.csv", STUDENTS))
    return {
        "rooms": csv("catalogo_salones.csv", ROOMS),
        "sections": csv("grupos_historicos.csv", SECTIONS),
        "enrolments": csv("inscripciones.csv", ENROLMENTS),
        "teachers": csv("catalogo_profesores.csv", TEACHERS),
        "snapshots": snaps,
        "catalogues": {c: files.read_json_lines(spark, f"{r}/{f}") for c, f in CAREER_FILES.items()},
    }


def etl_job(spark: SparkSession, raw_dir: str, out_dir: str) -> dict[str, DataFrame]:
    """Raw history -> materias_normalizadas, model_ready (partitioned by term)
    and the four dashboard tables (JSON lines). Returns the written tables."""
    raw = read_raw(spark, raw_dir)
    out = out_dir.rstrip("/")
    courses = catalog.normalize_courses(raw["catalogues"])
    files.write_parquet(courses, f"{out}/materias_normalizadas")
    courses = spark.read.parquet(f"{out}/materias_normalizadas")

    students = catalog.normalize_students(raw["snapshots"])
    dem = demand.potential_demand_history(students, courses)
    mt = features.model_table(raw["sections"], raw["enrolments"], dem, raw["teachers"])
    files.write_parquet(mt, f"{out}/model_ready", partition_by=["semestre_historico"])

    sections, enrolments = raw["sections"], raw["enrolments"]
    charts = {
        "cuellos_de_botella": insights.bottleneck_courses(enrolments, sections),
        "evolucion_matricula": insights.active_enrolment_trend(raw["snapshots"]),
        "sesgo_horario": insights.hour_bias(enrolments, sections),
        "calidad_profesores": insights.teacher_extremes(enrolments, sections, raw["teachers"]),
    }
    for name, df in charts.items():
        files.write_json(df, f"{out}/graficas/{name}")
    result = {"materias_normalizadas": courses,
              "model_ready": spark.read.parquet(f"{out}/model_ready")}
    result.update({n: spark.read.json(f"{out}/graficas/{n}") for n in charts})
    return result


@dataclass
class TrainingResult:
    model: PipelineModel
    holdout_rmse: float
    train_rows: int
    test_rows: int


def training_job(spark: SparkSession, model_ready_path: str, model_path: str,
                 grid: bool = True, **train_args) -> TrainingResult:
    """model_ready -> hash split -> grid search; the held-out RMSE is measured
    (D17), then the best parameters are fitted to all rows and saved (M5)."""
    mt = model.training_frame(spark.read.parquet(model_ready_path))
    mt = materialize(mt.drop("horario_visual"), "training")
    train, test = model.hash_split(mt, "grupo_id")
    fitted = model.train_model(train, grid=grid, **train_args)
    n_test = test.count()
    rmse = model.evaluate(fitted, test) if n_test else float("nan")
    gbt = fitted.stages[-1]
    fitted = model.train_model(mt, grid=False, depth=[gbt.getOrDefault("maxDepth")], iters=[gbt.getOrDefault("maxIter")],
                               steps=[gbt.getOrDefault("stepSize")])
    model.save_model(fitted, model_path)
    return TrainingResult(fitted, rmse, train.count(), n_test)


def prediction_job(spark: SparkSession, model_path: str, snapshot_path: str,
                   catalogue_path: str, teachers_path: str, rooms_path: str,
                   sections_path: str, attendance_path: str | None,
                   restrictions: DataFrame | None, out_dir: str,
                   max_sections: int | None = timetable.MAX_SECTIONS,
                   teacher_quality: DataFrame | None = None) -> dict[str, DataFrame]:
    """Current snapshot -> demand (Q11) -> teachers of the course's department,
    rooms of its pool, five slots (Q12) -> model scores (Q13) -> attendance
    factors (Q14) -> teacher blocks (Q15) -> greedy timetable by rank join (G1) -> KPIs and feature importances (Q17). Writes JSON
    documents of the bounded results to ``out_dir``."""
    fitted = model.load_model(model_path)
    snap = files.read_csv_plain(spark, snapshot_path, STUDENTS) \
        .withColumn("materias_aprobadas", parse_name_list_loose("materias_aprobadas_json")) \
        .withColumn("semestre_actual", F.col("semestre_actual").try_cast("int"))
    courses = spark.read.parquet(catalogue_path)
    dem = demand.current_demand(snap, courses)
    teachers = files.read_csv_plain(spark, teachers_path, TEACHERS)
    rooms = files.read_csv_plain(spark, rooms_path, ROOMS) \
        .withColumn("capacidad_base", F.col("capacidad_base").try_cast("int"))
    dem_pooled, rooms_pooled = timetable.lab_pools(dem, rooms)
    pairs = timetable.department_teacher_pairs(dem, teachers)

    stats = by_hour = None
    if attendance_path:
        sections = files.read_csv_plain(spark, sections_path, SECTIONS)
        joined = att.events_with_sections(
            att.dedupe_events(files.read_text_events(spark, attendance_path)), sections)
        joined = materialize(joined, "attendance")
        stats, by_hour = att.attendance_stats(joined), att.attendance_by_hour(joined)
    blocks = timetable.restriction_blocks(restrictions) if restrictions is not None else None
    plan = materialize(model_reports.model_timetable(fitted, dem_pooled, pairs, rooms_pooled, teacher_quality,
                                                     blocks, stats, max_sections), "timetable")
    kpis = timetable.schedule_kpis(plan)
    importance = model.feature_importance(spark, fitted)

    out = out_dir.rstrip("/")
    files.write_json_document(plan, f"{out}/sugerencias_horario", ["id"])
    files.write_json_document(kpis, f"{out}/model_metrics")
    files.write_json_document(importance, f"{out}/top_features", [F.desc("importancia"), "feature"])
    result = {"demand": dem, "timetable": plan, "kpis": kpis, "importance": importance}
    if by_hour is not None:
        files.write_json_document(by_hour, f"{out}/grafica_asistencia_por_hora", [numeric_text_order("hora_inicio_promedio")])
        result["attendance_by_hour"] = by_hour
        result["attendance_stats"] = stats
    return result
