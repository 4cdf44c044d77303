"""The academic schema derived from the driver's TPC-H-style tables.

Every planning query runs on the academic schema (sections, enrolments,
students, courses, teachers, attendance). On the driver's tables these are
derived, by Spark, from whole tables:

  section     = an order (term = half-year of the order date, career = the
                customer's market segment; course = brand of the part and
                teacher = supplier of its first line, the least (number, part,
                supplier); room = the customer's nation); an order without
                lines is a section without course, teacher and students
  enrolment   = a line item (grade = 2 x quantity, dropped = return flag R)
  student     = a customer in each term they ordered (semester = how many
                terms so far, passed = brands bought with grade >= 70 in
                earlier terms, state Desercion when the balance is negative)
  course      = a brand offered in a segment (semester = brand group of 5,
                prerequisite = the brand five numbers lower)
  teacher     = a supplier
  attendance  = an event (present unless the event is an error; hour of ts)

``SQL_VIEWS`` holds the same derivations as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semestra.session import hadoop_path

SECTION_SEATS = 7          # an order holds at most 7 lines
BRANDS_PER_SEMESTER = 5


_SCHEMAS: dict[tuple, StructType] = {}


def read(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """A table of ``d``. Its schema is found out once while the file is the same:
    a plan reads a table several times, and each finding is a job."""
    path = f"{d}/{name}.parquet"
    fs, p = hadoop_path(spark, path)
    status = fs.getFileStatus(p)
    key = path, status.getLen(), status.getModificationTime()
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[key]).parquet(path)
    return df.select(*cols) if cols else df


def table_state(spark: SparkSession, d: str) -> tuple:
    """(name, length, time of change) of every file of the tables in ``d``: what
    was derived from them holds as long as this is the same."""
    fs, folder = hadoop_path(spark, d)
    out = []
    for table in fs.listStatus(folder):
        inner = fs.listStatus(table.getPath()) if table.isDirectory() else [table]
        out += [(f"{table.getPath().getName()}/{f.getPath().getName()}", f.getLen(), f.getModificationTime()) for f in inner]
    return tuple(sorted(out))


def term_of(ts: Column) -> Column:
    """Half-year term like 1997-2."""
    return F.concat(F.year(ts).cast("string"), F.lit("-"),
                    F.when(F.month(ts) <= 6, F.lit("1")).otherwise(F.lit("2")))


def brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, r"#(\d+)", 1).try_cast("int")


def brand_semester(brand: Column) -> Column:
    return (F.floor((brand_number(brand) - 1) / BRANDS_PER_SEMESTER) + 1).cast("int")


def sections(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # (order, line number) is no key: one first line is chosen of all lines.
    l1 = (read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
          .groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first"))
          .select("l_orderkey", "first.l_partkey", "first.l_suppkey"))
    p = read(spark, d, "part", "p_partkey", "p_brand")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    s = (o.join(l1, o.o_orderkey == l1.l_orderkey, "left")
         .join(p, F.col("l_partkey") == p.p_partkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left"))
    hour = (F.lit(7) + F.lit(2) * (F.dayofmonth("o_orderdate") % 7)).cast("int")
    day = F.upper(F.date_format("o_orderdate", "EEEE"))
    return s.select(
        F.col("o_orderkey").alias("grupo_id"),
        term_of(F.col("o_orderdate")).alias("semestre_historico"),
        F.col("c_mktsegment").alias("carrera"),
        F.upper("p_brand").alias("materia_nombre"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.upper("p_brand")).alias("materia_id"),
        brand_semester(F.col("p_brand")).alias("materia_semestre"),
        F.col("l_suppkey").alias("profesor_id"),
        F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("salon_id"),
        F.lit(SECTION_SEATS).alias("cupo_ofrecido"),
        F.concat(F.lit('{"'), day, F.lit('": "'), hour.cast("string"), F.lit("-"),
                 (hour + 2).cast("string"), F.lit('"}')).alias("horario_json"),
        hour.alias("hora_inicio_promedio"),
        F.when(F.col("o_orderstatus") == "P", F.lit("True")).otherwise(F.lit("False"))
        .alias("conflicto_recurso_detectado"),
    )


def enrolments(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
              "l_quantity", "l_returnflag")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("inscripcion_id"),
        F.col("l_orderkey").alias("grupo_id"),
        F.col("l_partkey").alias("alumno_id"),
        (F.col("l_quantity") * 2).alias("calificacion_final"),
        F.when(F.col("l_returnflag") == "R", F.lit("True")).otherwise(F.lit("False"))
        .alias("estado_desercion"),
    )


def customer_enrolments(spark: SparkSession, d: str) -> DataFrame:
    """Enrolments keyed by the student (the order's customer)."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey")
    e = enrolments(spark, d)
    return e.join(o, e.grupo_id == o.o_orderkey).drop("alumno_id", "o_orderkey") \
        .withColumnRenamed("o_custkey", "alumno_id")


def term_passes(spark: SparkSession, d: str) -> DataFrame:
    """(alumno_id, semestre_historico, materia_nombre): brands a customer
    bought with grade >= 70 in a term (the term's newly passed courses)."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    p = read(spark, d, "part", "p_partkey", "p_brand")
    return (li.filter(F.col("l_quantity") * 2 >= 70)
            .join(o, li.l_orderkey == o.o_orderkey)
            .join(p, F.col("l_partkey") == p.p_partkey)
            .select(F.col("o_custkey").alias("alumno_id"),
                    term_of(F.col("o_orderdate")).alias("semestre_historico"),
                    F.upper("p_brand").alias("materia_nombre")))


def teachers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier", "s_suppkey", "s_name").select(
        F.col("s_suppkey").alias("profesor_id"), F.col("s_name").alias("nombre_profesor"))


def student_snapshots(spark: SparkSession, d: str, latest: bool = False) -> DataFrame:
    """Raw snapshots: passed courses arrive as JSON text (parsed by Q2). With
    ``latest`` those of the last term only: the history is then read for the
    customers who ordered in it.

    The per-customer window runs over (customer, term) rows that were
    aggregated first, so a customer holding a third of all orders still has
    at most one row per term in it.
    """
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate") \
        .withColumn("term", term_of(F.col("o_orderdate")))
    li = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    p = read(spark, d, "part", "p_partkey", "p_brand")
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    if latest:
        known = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        last = known.agg(F.max("term").alias("term"))  # one row
        o = o.join(o.join(F.broadcast(last), "term", "left_semi").select("o_custkey").distinct(), "o_custkey", "left_semi")
    passed_now = (li.filter(F.col("l_quantity") * 2 >= 70)
                  .join(o, li.l_orderkey == o.o_orderkey)
                  .join(p, F.col("l_partkey") == p.p_partkey)
                  .groupBy("o_custkey", "term")
                  .agg(F.collect_set(F.upper("p_brand")).alias("now")))
    terms = o.select("o_custkey", "term").distinct().join(passed_now, ["o_custkey", "term"], "left")
    by_cust = Window.partitionBy("o_custkey").orderBy("term")
    before = by_cust.rowsBetween(Window.unboundedPreceding, -1)
    snap = terms.select(
        "o_custkey", "term",
        F.row_number().over(by_cust).alias("semestre_actual"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("now").over(before)))).alias("passed"))
    if latest:
        snap = snap.join(F.broadcast(last), "term", "left_semi")
    return (snap.join(c, snap.o_custkey == c.c_custkey)
            .select(F.col("o_custkey").alias("alumno_id"),
                    F.col("c_mktsegment").alias("carrera"),
                    F.col("semestre_actual").cast("string").alias("semestre_actual"),
                    F.when(F.col("c_acctbal") < 0, F.lit("Desercion"))
                    .otherwise(F.lit("Activo")).alias("estado"),
                    F.to_json("passed").alias("materias_aprobadas_json"),
                    F.col("term").alias("semestre_historico")))


def course_catalogue(spark: SparkSession, d: str, taught: DataFrame | None = None) -> DataFrame:
    """Raw catalogue rows (carrera, nombre, semestre text, prerrequisito JSON
    text or null): the brands sold in each segment. One scan of the sections
    (``taught``, where they are at hand) for all careers."""
    s = (sections(spark, d) if taught is None else taught).filter(F.col("materia_nombre").isNotNull())
    raw = s.select("carrera", F.col("materia_nombre").alias("b")).distinct()
    k = brand_number(F.col("b"))
    raw = raw.select(
        "carrera",
        F.initcap(F.col("b")).alias("nombre"),
        brand_semester(F.col("b")).cast("string").alias("semestre"),
        F.when(k > BRANDS_PER_SEMESTER,
               F.concat(F.lit('["Brand#'), (k - BRANDS_PER_SEMESTER).cast("string"), F.lit('"]')))
        .alias("prerrequisito"))
    return raw


def attendance_records(e: DataFrame) -> DataFrame:
    """Event rows -> attendance records (all text, as the stream delivers
    them): present unless the event is an error."""
    return e.select(
        F.col("event_id").cast("string").alias("asistencia_id"),
        F.col("user_id").cast("string").alias("alumno_id"),
        F.col("user_id").cast("string").alias("grupo_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("fecha_hora_evento"),
        F.when(F.col("event_type") == "error", F.lit("Ausencia")).otherwise(F.lit("Entrada"))
        .alias("tipo_evento"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_ingesta"))


def attendance_events(spark: SparkSession, d: str) -> DataFrame:
    return attendance_records(read(spark, d, "events", "event_id", "ts", "user_id", "event_type"))


def attendance_event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream (the Parquet file is the source)."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # A glob path: for a plain file path the source would take the file as
    # its partition base directory and fail.
    raw = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return attendance_records(raw)


def attendance_sections(spark: SparkSession, d: str) -> DataFrame:
    """The attendance stand-in's sections: one per user, teacher = the user,
    start hour = the hour of the user's first event (a grouped min)."""
    e = read(spark, d, "events", "user_id", "ts")
    return (e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
            .select(F.col("user_id").cast("string").alias("grupo_id"),
                    F.col("user_id").cast("string").alias("profesor_id"),
                    F.hour("first_ts").cast("string").alias("hora_inicio_promedio")))


# ---------------------------------------------------------------------------
# The same derivations in DuckDB SQL (for the oracle).

SQL_VIEWS = {
    "sec": """
sec AS (
  SELECT o.o_orderkey AS grupo_id,
         CAST(year(o.o_orderdate) AS VARCHAR) || '-' ||
           CASE WHEN month(o.o_orderdate) <= 6 THEN '1' ELSE '2' END AS semestre_historico,
         c.c_mktsegment AS carrera,
         upper(p.p_brand) AS materia_nombre,
         c.c_mktsegment || '-' || upper(p.p_brand) AS materia_id,
         CAST(floor((CAST(regexp_extract(p.p_brand, '#(\\d+)', 1) AS INTEGER) - 1) / 5) + 1 AS INTEGER)
           AS materia_semestre,
         l.l_suppkey AS profesor_id,
         'R' || CAST(c.c_nationkey AS VARCHAR) AS salon_id,
         7 AS cupo_ofrecido,
         upper(dayname(o.o_orderdate)) AS dia,
         CAST(7 + 2 * (dayofmonth(o.o_orderdate) % 7) AS INTEGER) AS hora_inicio_promedio,
         CASE WHEN o.o_orderstatus = 'P' THEN 'True' ELSE 'False' END AS conflicto_recurso_detectado
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
  ) l ON o.o_orderkey = l.l_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)""",
    "enr": """
enr AS (
  SELECT l_orderkey AS grupo_id, l_partkey AS alumno_id,
         l_quantity * 2 AS calificacion_final,
         CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END AS estado_desercion
  FROM lineitem
)""",
    "tea": """
tea AS (SELECT s_suppkey AS profesor_id, s_name AS nombre_profesor FROM supplier)""",
    "stu": """
ord_t AS (
  SELECT o_orderkey, o_custkey,
         CAST(year(o_orderdate) AS VARCHAR) || '-' ||
           CASE WHEN month(o_orderdate) <= 6 THEN '1' ELSE '2' END AS term
  FROM orders
),
passed_now AS (
  SELECT o.o_custkey, o.term, list_distinct(list(upper(p.p_brand))) AS now
  FROM lineitem l JOIN ord_t o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_quantity * 2 >= 70
  GROUP BY o.o_custkey, o.term
),
terms AS (
  SELECT t.o_custkey, t.term, coalesce(pn.now, []::VARCHAR[]) AS now
  FROM (SELECT DISTINCT o_custkey, term FROM ord_t) t
  LEFT JOIN passed_now pn ON t.o_custkey = pn.o_custkey AND t.term = pn.term
),
snap AS (
  SELECT o_custkey, term,
         row_number() OVER (PARTITION BY o_custkey ORDER BY term) AS semestre_actual,
         coalesce(list_sort(list_distinct(flatten(list(now) OVER (
           PARTITION BY o_custkey ORDER BY term
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))), []::VARCHAR[]) AS passed
  FROM terms
),
stu AS (
  SELECT s.o_custkey AS alumno_id, c.c_mktsegment AS carrera,
         CAST(s.semestre_actual AS INTEGER) AS semestre_actual,
         CASE WHEN c.c_acctbal < 0 THEN 'Desercion' ELSE 'Activo' END AS estado,
         s.passed AS materias_aprobadas, s.term AS semestre_historico
  FROM snap s JOIN customer c ON s.o_custkey = c.c_custkey
)""",
    "crs": """
crs AS (
  SELECT DISTINCT materia_nombre, carrera, materia_semestre AS semestre_materia,
         CASE WHEN CAST(regexp_extract(materia_nombre, '#(\\d+)', 1) AS INTEGER) > 5
              THEN ['BRAND#' || CAST(CAST(regexp_extract(materia_nombre, '#(\\d+)', 1) AS INTEGER) - 5
                                     AS VARCHAR)]
              ELSE []::VARCHAR[] END AS prerequisitos
  FROM sec WHERE materia_nombre IS NOT NULL
)""",
    "att": """
att AS (
  SELECT CAST(event_id AS VARCHAR) AS asistencia_id, CAST(user_id AS VARCHAR) AS grupo_id,
         CASE WHEN event_type = 'error' THEN 'Ausencia' ELSE 'Entrada' END AS tipo_evento,
         ts
  FROM events
),
att_sec AS (
  SELECT CAST(user_id AS VARCHAR) AS grupo_id, CAST(user_id AS VARCHAR) AS profesor_id,
         CAST(hour(min(ts)) AS VARCHAR) AS hora_inicio_promedio
  FROM events GROUP BY user_id
)""",
}


def sql_with(*views: str) -> str:
    """WITH clause holding the named views (dependencies first)."""
    deps = {"crs": ["sec"]}
    order: list[str] = []
    for v in views:
        for dep in deps.get(v, []) + [v]:
            if dep not in order:
                order.append(dep)
    return "WITH " + ",\n".join(SQL_VIEWS[v].strip() for v in order)


# ---------------------------------------------------------------------------
# Timetable inputs

# Spanish day names by Spark's dayofweek (1 = Sunday).
WEEKDAYS = ["DOMINGO", "LUNES", "MARTES", "MIERCOLES", "JUEVES", "VIERNES", "SABADO"]
ROOM_BASE_SEATS, ROOM_SEATS_PER_REGION = 25, 5


def rooms(spark: SparkSession, d: str) -> DataFrame:
    """A room per nation; capacity grows with the region key; the room pool
    is the region."""
    n = read(spark, d, "nation", "n_nationkey", "n_regionkey")
    return n.select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("salon_id"),
                    (F.lit(ROOM_BASE_SEATS) + F.lit(ROOM_SEATS_PER_REGION) * F.col("n_regionkey"))
                    .cast("int").alias("capacidad_base"),
                    F.col("n_regionkey").cast("int").alias("room_pool"))


def qualified_teachers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that have supplied a brand may teach it; their mean grade
    for it (2 x quantity) is the candidate's score."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity")
    p = read(spark, d, "part", "p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .groupBy(F.col("l_suppkey").alias("profesor_id"),
                     F.upper("p_brand").alias("materia_nombre"))
            .agg(F.round(F.avg(F.col("l_quantity") * 2), 1).alias("score_predicho")))


# The subject words that stand in for the first words of part names.
TITLE_WORDS = {"hot": "LAB", "cold": "TALLER", "new": "DIBUJO", "red": "CÁLCULO", "blue": "ÁLGEBRA",
               "small": "ECONOMÍA"}


def course_titles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as courses with a spoken title, a career, and a text that lists the
    words of the name in one of the forms such lists arrive in."""
    p = read(spark, d, "part", "p_partkey", "p_name")
    words = F.split("p_name", " ")
    subject = F.create_map(*[F.lit(x) for kv in TITLE_WORDS.items() for x in kv])
    title = F.upper(F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(subject, w), w)), " "))
    k = F.col("p_partkey") % 4
    listed = (F.when(k == 0, F.to_json(words)).when(k == 1, F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")))
              .when(k == 2, F.array_join(words, " , ")).otherwise(F.lit("")))
    career = F.when(F.col("p_partkey") % 3 == 0, "ISC").when(F.col("p_partkey") % 3 == 1, "IND").otherwise("OTRA")
    return p.select("p_partkey", title.alias("titulo"), career.alias("carrera"), listed.alias("lista"))


def restrictions(spark: SparkSession, d: str) -> DataFrame:
    """Teacher restriction records (S14's table): a user's error events block
    that weekday and hour; the record is active when the user ever bought."""
    e = read(spark, d, "events", "user_id", "ts", "event_type")
    day = F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.dayofweek("ts"))
    per_day = (e.filter(F.col("event_type") == "error")
               .groupBy("user_id", day.alias("dia"))
               .agg(F.array_sort(F.collect_set(F.hour("ts").cast("string"))).alias("horas")))
    blocks = per_day.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("dia", "horas"))).alias("bloqueos"))
    active = e.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("_p"))
    return (blocks.join(active, "user_id")
            .select(F.lit("profesor").alias("tipo_restriccion"),
                    F.col("user_id").alias("profesor_id"),
                    F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("nombre_visual"),
                    "bloqueos",
                    F.when(F.col("_p") == 1, F.lit("True")).otherwise(F.lit("false")).alias("activo")))
