"""Planner reports over the derived academic schema: seating, slots, open
teacher hours, course ids, store refresh, filtered suggestions, file round trips.

Each report is a function of (spark, sf_dir) over whole tables; ``SQL`` holds
the same report for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semestra.functions import numeric as num
from semestra.functions import schedule as sch
from semestra.functions import text as txt
from semestra.operators.aggregates import shared_course_ids
from semestra.operators.joins import drop_blocked, normalized_key_join
from semestra.operators.ordering import first_n, union_all_by_name
from semestra.plans import catalog, demand, features, timetable
from semestra.session import scratch_path
from semestra.sources import driver as drv
from semestra.sources import files, snapshots, store


def _slot_of(key: str) -> F.Column:
    """One of the offered slots by a number."""
    names = F.array(*[F.lit(s) for s, _ in sch.DEFAULT_SLOTS])
    return F.get(names, F.pmod(F.col(key), F.lit(len(sch.DEFAULT_SLOTS))).cast("int"))


def section_seating(spark: SparkSession, d: str) -> DataFrame:
    """F10, F14, F16, F18, F19, F28, F29 on every section."""
    f = features.section_features(drv.sections(spark, d), drv.enrolments(spark, d))
    pct = F.col("TA_g") * 100
    f = f.select("*", num.seats_text("num_inscritos", "cupo_ofrecido").alias("demanda"), pct.alias("pct"))
    seats = num.split_seats("demanda")
    return f.select(
        "grupo_id", "demanda", seats["seats"].alias("ocupados"), seats["capacity"].alias("capacidad"),
        num.cap_ratio(F.col("num_inscritos") * 20).alias("factor_demanda"),
        num.clip(F.col("pct") * 1.5 - 25).alias("score"),
        num.occupancy_factor("num_inscritos", "cupo_ofrecido").alias("ocupacion"),
        num.score_tier("pct").alias("nivel"), num.teacher_tier("pct").alias("nivel_profesor"),
        num.effective_capacity("materia_semestre", "cupo_ofrecido").alias("capacidad_efectiva"),
        num.load_class("materia_semestre", F.lit(3)).alias("carga"))


def section_slots(spark: SparkSession, d: str) -> DataFrame:
    """Days and hours of a section's slot, hours of its own schedule."""
    s = drv.sections(spark, d).select("grupo_id", _slot_of("grupo_id").alias("horario"),
                                      txt.parse_schedule("horario_json").alias("propio"))
    hours = F.transform(sch.slot_hours("horario"), lambda h: h.cast("string"))
    return s.select("grupo_id", "horario", F.array_join(sch.slot_days("horario"), ",").alias("dias"),
                    F.array_join(hours, ",").alias("horas"),
                    txt.first_start_hour("propio").alias("primera_hora"),
                    txt.mean_start_hour("propio").alias("hora_media"))


def open_teacher_slots(spark: SparkSession, d: str) -> DataFrame:
    """(teacher, slot) without a blocked hour; every user teaches."""
    users = drv.read(spark, d, "events", F.col("user_id").alias("profesor_id")).where("profesor_id IS NOT NULL").distinct()
    pairs = users.withColumn("str", F.explode(timetable.slot_array()["str"]))
    return drop_blocked(pairs, timetable.restriction_blocks(drv.restrictions(spark, d))).select("profesor_id", "str")


def course_ids(spark: SparkSession, d: str) -> DataFrame:
    """id of a course, shared by careers or not, and its prerequisites."""
    raw = drv.course_catalogue(spark, d)
    c = raw.select(txt.upper_name("nombre").alias("materia_nombre"), "carrera",
                   F.array_join(txt.prereqs_any_form(raw, "prerrequisito"), ",").alias("prerequisitos"))
    return shared_course_ids(c).select(
        "materia_nombre", "carrera", "prerequisitos",
        sch.shared_course_id("materia_nombre", "carrera", "_n_careers").alias("curso_id"))


def store_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Sections as a full refresh of the store writes them."""
    base = drv.sections(spark, d).select(F.col("grupo_id").alias("id"), F.col("materia_semestre").alias("semestre"),
                                         F.col("materia_nombre").alias("materia"), "carrera")
    base = base.withColumn("etiqueta", store.field_fallback(base, "semestre", "carrera", "-"))
    out = store.coerce_for_store(store.replace_table_rows(base), text_fields=["semestre"], int_fields=["id"])
    return out.select("id", "semestre", "semestre_id", "grupo_id", "materia_nombre", "etiqueta")


def career_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of one career, by key."""
    s = drv.sections(spark, d).select("grupo_id", "carrera", "semestre_historico", "materia_nombre")
    return store.key_range(s, "carrera", "BUILDING", "grupo_id")


def filtered_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """P11 over all sections as suggestions: a career, a semester, a text."""
    s = drv.sections(spark, d).join(drv.teachers(spark, d), "profesor_id", "left").select(
        F.col("grupo_id").alias("id"), "carrera", F.col("materia_semestre").alias("semestre"),
        F.col("materia_nombre").alias("materia"), F.col("nombre_profesor").alias("profesor"))
    return timetable.filter_suggestions(s, "BUILDING", "3", "brand#1")


def brand_parts(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue courses and the parts of their brand, joined on the clean name."""
    parts = drv.read(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("partes"))
    courses = drv.course_catalogue(spark, d).select("nombre", "carrera")
    return normalized_key_join(courses, parts, "nombre", "p_brand").select("nombre", "carrera", "partes")


def people(spark: SparkSession, d: str) -> DataFrame:
    """Teachers and students in one table; columns one side lacks are null."""
    return union_all_by_name([
        drv.read(spark, d, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre")),
        drv.read(spark, d, "customer", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("carrera"))])


def first_teachers(spark: SparkSession, d: str) -> DataFrame:
    """T4: the first twenty teachers by key (the report's own size)."""
    return first_n(drv.teachers(spark, d), 20, "profesor_id")


def customers_by_csv(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV; the permissive reader's rows joined
    to the plain reader's text."""
    df = drv.read(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "csv")
    df.write.option("header", True).option("escape", '"').csv(path)
    typed = files.read_csv_permissive(spark, path, df.schema)
    plain = files.read_csv_plain(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"),
                                                     F.col("c_name").alias("texto"))
    return typed.where(F.col(files.CORRUPT_COL).isNull()).drop(files.CORRUPT_COL).join(plain, "c_custkey")


def orders_by_json(spark: SparkSession, d: str) -> DataFrame:
    """Orders through partitioned Parquet, then JSON lines."""
    df = drv.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    parquet, lines = scratch_path(spark, "parquet"), scratch_path(spark, "json")
    files.write_parquet(df, parquet, ["o_orderstatus"])
    files.write_json(files.read_parquet(spark, parquet), lines)
    return files.read_json_lines(spark, lines, df.schema)


def orders_document(spark: SparkSession, d: str) -> DataFrame:
    """Orders through one ordered JSON document."""
    df = drv.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "document")
    files.write_json_document(df, path, ["o_orderkey"])
    return files.read_json_document(spark, path, df.schema)


def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """The older half of the events resolved into a stored table, the
    newer half merged into it, the table read back."""
    log = drv.read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value") \
        .withColumn("op", F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put")))
    cut = log.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2))
                  .alias("cut")).scalar()
    path, key, order = scratch_path(spark, "store"), ["user_id"], ["ts", "event_id"]
    older = store.upsert_latest(log.where(F.col("ts").cast("timestamp") < cut), key, order).select("user_id", "event_id", "event_type", "value")
    store.write_store(older, path, key)
    store.merge_store(log.where(F.coalesce(F.col("ts").cast("timestamp") >= cut, F.lit(True))), path, key, order)
    return store.scan_store(spark, path)


def term_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Student snapshots as one file a term, the first terms read, then the
    new files only; the table read back."""
    src, table = scratch_path(spark, "terms"), scratch_path(spark, "snapshots")
    raw = drv.student_snapshots(spark, d)
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    schema = raw.drop("semestre_historico").schema
    files.write_csv_by(raw, src, "semestre_historico")
    snapshots.ingest_snapshots(spark, f"{src}/*_199[0-4]-*.csv", table, schema)
    snapshots.ingest_snapshots(spark, f"{src}/*.csv", table, schema)
    return catalog.normalize_students(snapshots.read_table(spark, table, schema)).select(
        F.col("alumno_id").cast("long").alias("alumno_id"), "carrera", "estado", "semestre_actual", "semestre_historico",
        F.size("materias_aprobadas").alias("n_aprobadas"))


def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """department and room pool by title, names of a list in any form."""
    c = drv.course_titles(spark, d)
    return c.select("p_partkey", "titulo", sch.department_of("titulo", "carrera").alias("departamento"),
                    sch.needs_lab("titulo").alias("laboratorio"), sch.is_lab_room("titulo").alias("sala_laboratorio"),
                    F.array_join(txt.parse_name_list_loose("lista"), ",").alias("nombres"))


def course_rooms(spark: SparkSession, d: str) -> DataFrame:
    """courses in demand and the rooms of their pool: the demand
    as a factor, the groups it takes, and the seats a group has in each room."""
    students = catalog.normalize_students(drv.student_snapshots(spark, d, latest=True))
    dem = demand.current_demand(students, catalog.course_rows(drv.course_catalogue(spark, d)))
    size = F.when(F.col("semestre_materia") > num.SMALL_GROUP_SEMESTER, num.SMALL_GROUP).otherwise(num.LARGE_GROUP)
    pool = F.pmod(drv.brand_number(F.col("materia_nombre")), F.lit(5)).alias("room_pool")
    return (dem.select("*", size.alias("tamano"), pool).join(drv.rooms(spark, d), "room_pool")
            .select("materia_nombre", "carrera_materia", "salon_id", num.cap_ratio("demanda_real").alias("factor_demanda"),
                    num.sections_needed("demanda_real", "semestre_materia").alias("grupos"),
                    num.effective_capacity("tamano", "capacidad_base").alias("capacidad_efectiva")))


def student_load(spark: SparkSession, d: str) -> DataFrame:
    """enrolments by term and career, as backlog or regular load of each
    student's own semester."""
    students = catalog.normalize_students(drv.student_snapshots(spark, d)).select("alumno_id", "semestre_historico", "semestre_actual")
    taken = drv.customer_enrolments(spark, d).select("grupo_id", "alumno_id").join(
        drv.sections(spark, d).select("grupo_id", "carrera", "semestre_historico", "materia_semestre"), "grupo_id")
    both = taken.join(students, ["alumno_id", "semestre_historico"])
    return (both.groupBy("semestre_historico", "carrera", num.load_class("materia_semestre", "semestre_actual").alias("carga"))
            .agg(F.count(F.lit(1)).alias("inscripciones")))


QUERIES = {f.__name__: f for f in (
    section_seating, section_slots, open_teacher_slots, course_ids, store_refresh, career_sections,
    filtered_suggestions, brand_parts, people, first_teachers, customers_by_csv, orders_by_json,
    orders_document, store_merge, term_snapshots, name_rules, course_rooms, student_load)}

SLOTS = "[" + ", ".join(f"'{s}'" for s, _ in sch.DEFAULT_SLOTS) + "]"
_DAY_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sch.DAY_NAMES.items()) + "}"
SLOT_DAYS = f"list_transform(string_split(split_part(slot, ' ', 1), '-'), lambda x: {_DAY_MAP}[x])"
SLOT_HOURS = """range(CAST(substr(split_part(slot, ' ', 2), 1, 2) AS INTEGER),
             CAST(substr(split_part(slot, ' ', 2), 7, 2) AS INTEGER))"""

_TITLE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in drv.TITLE_WORDS.items()) + "}"

SQL = {
    "section_seating": drv.sql_with("sec", "enr") + """,
cnt AS (
  SELECT grupo_id, count(*) AS ni, count(CASE WHEN calificacion_final >= 70 THEN 1 END) AS na
  FROM enr WHERE estado_desercion = 'False' GROUP BY grupo_id
),
f AS (
  SELECT s.grupo_id, materia_semestre, cupo_ofrecido AS cap, coalesce(ni, 0) AS n,
         CASE WHEN coalesce(ni, 0) > 0 THEN na / ni ELSE 0.0 END * 100 AS pct
  FROM sec s LEFT JOIN cnt c ON s.grupo_id = c.grupo_id
)
SELECT grupo_id, n || '/' || cap AS demanda, CAST(n AS INTEGER) AS ocupados, CAST(cap AS INTEGER) AS capacidad,
       CASE WHEN n * 20 > 100 THEN 1.0 ELSE n * 20 / 100 END AS factor_demanda,
       greatest(0.0, least(100.0, pct * 1.5 - 25)) AS score,
       CASE WHEN n / cap < 0.5 THEN n / cap ELSE 1.0 END AS ocupacion,
       CASE WHEN pct >= 90 THEN 'success' WHEN pct >= 80 THEN 'warning' ELSE 'danger' END AS nivel,
       CASE WHEN pct >= 80 THEN 'good' ELSE 'low' END AS nivel_profesor,
       least(materia_semestre, cap) AS capacidad_efectiva,
       CASE WHEN materia_semestre < 3 THEN 'backlog' WHEN materia_semestre = 3 THEN 'regular' END AS carga
FROM f""",
    "section_slots": drv.sql_with("sec") + f""",
x AS (SELECT *, {SLOTS}[grupo_id % 5 + 1] AS slot FROM sec)
SELECT grupo_id, slot AS horario, array_to_string({SLOT_DAYS}, ',') AS dias,
       array_to_string({SLOT_HOURS}, ',') AS horas,
       hora_inicio_promedio AS primera_hora, CAST(hora_inicio_promedio AS DOUBLE) AS hora_media
FROM x""",
    "open_teacher_slots": f"""
WITH b AS (
  SELECT DISTINCT user_id, hour(ts) AS hora,
         ['DOMINGO','LUNES','MARTES','MIERCOLES','JUEVES','VIERNES','SABADO'][dayofweek(ts) + 1] AS dia
  FROM events WHERE event_type = 'error'
    AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
),
u AS (SELECT DISTINCT user_id, unnest({SLOTS}) AS slot FROM events WHERE user_id IS NOT NULL),
busy AS (
  SELECT u.user_id, u.slot FROM u JOIN b USING (user_id)
  WHERE list_contains({SLOT_DAYS}, b.dia) AND list_contains({SLOT_HOURS}, b.hora)
)
SELECT user_id AS profesor_id, slot AS str FROM u
WHERE NOT EXISTS (SELECT 1 FROM busy WHERE busy.user_id = u.user_id AND busy.slot = u.slot)""",
    "course_ids": drv.sql_with("crs") + """,
n AS (SELECT materia_nombre, count(DISTINCT carrera) AS k FROM crs GROUP BY materia_nombre)
SELECT c.materia_nombre, carrera, array_to_string(prerequisitos, ',') AS prerequisitos,
       CASE WHEN k > 1 THEN 'CB' ELSE carrera END || '-' || c.materia_nombre AS curso_id
FROM crs c JOIN n ON c.materia_nombre = n.materia_nombre""",
    "store_refresh": drv.sql_with("sec") + """
SELECT grupo_id AS id, CAST(materia_semestre AS VARCHAR) AS semestre,
       coalesce(CAST(materia_semestre AS VARCHAR), '2025-1') AS semestre_id,
       CAST(grupo_id AS VARCHAR) AS grupo_id, materia_nombre,
       coalesce(CAST(nullif(materia_semestre, 0) AS VARCHAR), nullif(carrera, ''), '-') AS etiqueta
FROM sec""",
    "career_sections": drv.sql_with("sec") + """
SELECT grupo_id, carrera, semestre_historico, materia_nombre FROM sec WHERE carrera = 'BUILDING'""",
    "filtered_suggestions": drv.sql_with("sec", "tea") + """
SELECT grupo_id AS id, carrera, materia_semestre AS semestre, materia_nombre AS materia, nombre_profesor AS profesor
FROM sec LEFT JOIN tea USING (profesor_id)
WHERE carrera = 'BUILDING' AND materia_semestre = 3
  AND (contains(lower(materia_nombre), 'brand#1') OR contains(lower(nombre_profesor), 'brand#1'))""",
    "brand_parts": drv.sql_with("crs") + """,
p AS (SELECT upper(p_brand) AS b, count(*) AS partes FROM part GROUP BY ALL)
SELECT upper(materia_nombre[1]) || lower(materia_nombre[2:]) AS nombre, carrera, partes
FROM crs JOIN p ON materia_nombre = b""",
    "people": """
SELECT s_suppkey AS id, s_name AS nombre, NULL AS carrera FROM supplier
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""",
    "first_teachers": """
SELECT s_suppkey AS profesor_id, s_name AS nombre_profesor FROM supplier ORDER BY s_suppkey LIMIT 20""",
    "customers_by_csv": """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_name AS texto FROM customer""",
    "orders_by_json": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""",
    "orders_document": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""",
    "store_merge": """
WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
)
SELECT user_id, event_id, event_type, value FROM last WHERE rn = 1 AND event_type <> 'error'""",
    "term_snapshots": drv.sql_with("stu") + """
SELECT alumno_id, carrera, estado, semestre_actual, semestre_historico, CAST(len(materias_aprobadas) AS INTEGER) AS n_aprobadas
FROM stu""",
    "name_rules": f"""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part),
t AS (
  SELECT p_partkey, ws, upper(array_to_string(list_transform(ws, lambda x: coalesce({_TITLE_MAP}[x], x)), ' ')) AS titulo,
         CASE p_partkey % 3 WHEN 0 THEN 'ISC' WHEN 1 THEN 'IND' ELSE 'OTRA' END AS carrera
  FROM w
)
SELECT p_partkey, titulo,
       CASE WHEN regexp_matches(titulo, '{"|".join(sch.BASIC_SCIENCE_WORDS)}') THEN 'Ciencias Basicas'
            WHEN carrera = 'ISC' THEN 'Sistemas' WHEN carrera = 'IND' THEN 'Industrial'
            WHEN regexp_matches(titulo, '{"|".join(sch.ADMIN_WORDS)}') THEN 'Administracion'
            ELSE 'Desarrollo Humano' END AS departamento,
       regexp_matches(titulo, 'LAB|TALLER|DIBUJO') AS laboratorio, regexp_matches(titulo, 'LAB|CC') AS sala_laboratorio,
       CASE WHEN p_partkey % 4 = 3 THEN '' ELSE upper(array_to_string(ws, ',')) END AS nombres
FROM t""",
    "course_rooms": drv.sql_with("stu", "crs") + """,
d AS (
  SELECT c.materia_nombre, c.semestre_materia, c.carrera, count(*) AS n,
         CAST(regexp_extract(c.materia_nombre, '#(\\d+)', 1) AS INTEGER) % 5 AS pool
  FROM stu s JOIN crs c ON s.carrera = c.carrera AND s.semestre_actual >= c.semestre_materia
  WHERE s.semestre_historico = (SELECT max(semestre_historico) FROM stu) AND s.estado = 'Activo'
    AND list_has_all(s.materias_aprobadas, c.prerequisitos) AND NOT list_contains(s.materias_aprobadas, c.materia_nombre)
  GROUP BY ALL HAVING count(*) >= 15
)
SELECT materia_nombre, carrera AS carrera_materia, 'R' || n_nationkey AS salon_id,
       CASE WHEN n > 100 THEN 1.0 ELSE n / 100 END AS factor_demanda,
       CAST(ceil(n / CASE WHEN semestre_materia > 5 THEN 25 ELSE 35 END) AS BIGINT) AS grupos,
       CAST(least(CASE WHEN semestre_materia > 5 THEN 25 ELSE 35 END, 25 + 5 * n_regionkey) AS INTEGER) AS capacidad_efectiva
FROM d JOIN nation ON n_regionkey = pool""",
    "student_load": drv.sql_with("sec", "stu") + """
SELECT sec.semestre_historico, sec.carrera,
       CASE WHEN materia_semestre < semestre_actual THEN 'backlog' WHEN materia_semestre = semestre_actual THEN 'regular' END AS carga,
       count(*) AS inscripciones
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sec ON grupo_id = o_orderkey
JOIN stu ON stu.alumno_id = o_custkey AND stu.semestre_historico = sec.semestre_historico
GROUP BY ALL""",
}
