"""Joins, aggregates, ordering and key-value semantics on fixture rows."""

from pyspark.sql import functions as F

from semestra.operators import aggregates as A
from semestra.operators import joins as J
from semestra.operators import ordering as O
from semestra.plans import catalog, demand, insights
from semestra.plans.timetable import restriction_blocks
from semestra.sources.files import parse_events
from semestra.sources.store import key_lookup, key_range, replace_table_rows, upsert_latest


def test_prereqs_division_j9(spark):
    df = spark.createDataFrame([([], ["P"]), (["P"], ["P"]), (["P", "Q"], ["P"])],
                               "pre array<string>, got array<string>")
    assert [r[0] for r in df.select(J.prereqs_satisfied("pre", "got")).collect()] == [True, True, False]


def test_drop_blocked_j10(spark):
    cands = spark.createDataFrame([(1, "L-Mi-V 07:00-09:00"), (1, "Ma-Ju 11:00-13:00")],
                                  "profesor_id int, str string")
    blocks = spark.createDataFrame([(1, "LUNES", 8)], "profesor_id int, dia string, hora int")
    assert [r.str for r in J.drop_blocked(cands, blocks).collect()] == ["Ma-Ju 11:00-13:00"]


def test_restriction_blocks_q15(spark):
    df = spark.createDataFrame(
        [("p", 1, "A", {"LUNES": ["8", "9"]}, "True"), ("p", 2, "B", {"LUNES": ["x"]}, "true"),
         ("p", 3, "C", {"MARTES": ["7"]}, "false")],
        "tipo_restriccion string, profesor_id int, nombre_visual string, "
        "bloqueos map<string,array<string>>, activo string")
    got = sorted(tuple(r) for r in restriction_blocks(df).collect())
    assert got == [(1, "LUNES", 8), (1, "LUNES", 9)]


def test_fail_and_pass_rate_a7(spark):
    df = spark.createDataFrame([(60.0,), (70.0,), (None,)], "g double")
    r = df.agg(A.fail_rate(F.col("g")), A.pass_rate(F.col("g"))).first()
    assert abs(r[0] - 1 / 3) < 1e-12 and abs(r[1] - 1 / 3) < 1e-12


def test_two_level_mean_a5(spark):
    df = spark.createDataFrame([("g1", "t", 100.0), ("g2", "t", 50.0), ("g2", "t", 50.0),
                                ("g2", "t", 50.0)], "g string, t string, v double")
    inner, outer = A.two_level_mean(df, ["g", "t"], ["t"], "v")
    assert outer.first()["mean_total"] == 62.5   # not (100 + 50) / 2


def test_top_and_bottom_t3(spark):
    rows = [(i, float(80 + (i % 3))) for i in range(7)]
    df = spark.createDataFrame(rows, "profesor_id int, v double")
    out = O.top_and_bottom(df, "v", 5, ["profesor_id"]).collect()
    top = [r.profesor_id for r in out if r.ranking == "Top 5"]
    assert top == [2, 5, 1, 4, 0]


def test_distinct_on_u3_is_deterministic(spark):
    df = spark.createDataFrame([("A", ["P"], "ISC", 3), ("A", ["P"], "ISC", 2),
                                ("A", ["P"], "IND", 5)], "n string, p array<string>, c string, s int")
    got = sorted(tuple(r) for r in O.distinct_on(df, ["n", "p", "c"]).collect())
    assert got == [("A", ["P"], "IND", 5), ("A", ["P"], "ISC", 2)]


def test_upsert_latest_s14(spark):
    log = spark.createDataFrame([("k", 1, "put", "a"), ("k", 2, "put", "b"), ("k", 3, "delete", None),
                                 ("k", 4, "put", "d"), ("j", 1, "put", "x"), ("j", 2, "delete", None)],
                                "key string, t int, op string, v string")
    got = [tuple(r) for r in upsert_latest(log, ["key"], ["t"]).select("key", "v").collect()]
    assert got == [("k", "d")]


def test_key_lookup_range_and_refresh_s12_s13(spark):
    df = spark.createDataFrame([("2025-1", 2, "X"), ("2025-1", 1, "Y"), ("2024-2", 1, "Z")],
                               "semestre_id string, id int, materia string")
    assert key_lookup(df, semestre_id="2024-2").count() == 1
    assert [r.id for r in key_range(df, "semestre_id", "2025-1", "id").collect()] == [1, 2]
    r = replace_table_rows(df.drop("semestre_id")).orderBy("id", "materia").first()
    assert (r.semestre_id, r.grupo_id, r.materia_nombre) == ("2025-1", "1", "Y")


def test_parse_events_s5(spark):
    good = '{"asistencia_id":"1","grupo_id":"G1","tipo_evento":"Entrada","timestamp_ingesta":"t1"}'
    two = good + good.replace('"1"', '"2"')
    lines = spark.createDataFrame([(good,), ("not json",), ('{"grupo_id":"G1"}',), (two,), (good,)],
                                  "value string")
    got = [r.asistencia_id for r in parse_events(lines).collect()]
    assert sorted(got) == ["1", "1", "1", "2"]


def test_demand_semester_as_int_and_fanout_d1_d5(spark):
    students = spark.createDataFrame(
        [("s1", "ISC", 10, "Activo", [], "2020-1"), ("s2", "IND", 3, "Activo", ["A"], "2020-1")],
        "alumno_id string, carrera string, semestre_actual int, estado string, "
        "materias_aprobadas array<string>, semestre_historico string")
    courses = spark.createDataFrame(
        [("A", 2, [], "ISC"), ("A", 1, [], "IND"), ("B", 3, ["A"], "IND")],
        "materia_nombre string, semestre_materia int, prerequisitos array<string>, carrera string")
    got = sorted(tuple(r) for r in demand.potential_demand_history(students, courses).collect())
    # s1 (semester 10 >= 2) is eligible for A in ISC; s2 passed A already
    # and is eligible for B.
    assert got == [("A", "IND", 1, "2020-1", 0), ("A", "ISC", 2, "2020-1", 1),
                   ("B", "IND", 3, "2020-1", 1)]


def test_next_snapshot_q18(spark):
    students = spark.createDataFrame(
        [("a", "ISC", 4, "Activo", ["X"]), ("b", "ISC", 4, "Activo", []),
         ("c", "ISC", 2, "Desercion", [])],
        "alumno_id string, carrera string, semestre_actual int, estado string, "
        "materias_aprobadas array<string>")
    new = spark.createDataFrame([("a", "Y"), ("b", "X")], "alumno_id string, materia_nombre string")
    totals = spark.createDataFrame([("ISC", 2)], "carrera string, total_materias int")
    got = {r.alumno_id: (r.estado, r.semestre_actual)
           for r in catalog.next_snapshot(students, new, totals).collect()}
    assert got == {"a": ("Egresado", 4), "b": ("Activo", 5), "c": ("Desercion", 2)}


def test_normalize_courses_q1(spark):
    isc = spark.createDataFrame([(" cálculo  i ", "1", None), ("redes", "5", '["Cálculo I"]')],
                                "nombre string, semestre string, prerrequisito string")
    ind = spark.createDataFrame([("Cálculo I", "2", "[]")],
                                "nombre string, semestre string, prerequisitos string")
    out = catalog.normalize_courses({"ISC": isc, "IND": ind}).collect()
    assert [(r.materia_nombre, r.semestre_materia, r.prerequisitos, r.carrera) for r in out] == [
        ("CÁLCULO I", 1, [], "ISC"), ("CÁLCULO I", 2, [], "IND"), ("REDES", 5, ["CÁLCULO I"], "ISC")]


def test_bottleneck_top_k_tie_break_q7(spark):
    sec = spark.createDataFrame([(i, f"M{i}") for i in range(7)], "grupo_id int, materia_nombre string")
    enr = spark.createDataFrame([(i, 50.0) for i in range(7)], "grupo_id int, calificacion_final double")
    got = [r.materia_nombre for r in insights.bottleneck_courses(enr, sec).collect()]
    assert got == ["M0", "M1", "M2", "M3", "M4"]


def test_filter_suggestions_p11(spark):
    from semestra.plans.timetable import filter_suggestions
    df = spark.createDataFrame([("REDES", "Ana Ruiz", "ISC", 5), ("CÁLCULO", "Beto", "IND", 1)],
                               "materia string, profesor string, carrera string, semestre int")
    assert filter_suggestions(df, text="ruiz").count() == 1
    assert filter_suggestions(df, carrera="IND", semestre="1").count() == 1
    assert filter_suggestions(df, carrera="IND", semestre="5").count() == 0
    assert filter_suggestions(df).count() == 2


def test_shared_course_id_f26(spark):
    from semestra.functions.schedule import shared_course_id
    cat = spark.createDataFrame([("ÉTICA", "ISC"), ("ÉTICA", "IND"), ("REDES", "ISC")],
                                "materia_nombre string, carrera string")
    out = A.shared_course_ids(cat).select(
        "materia_nombre", "carrera",
        shared_course_id("materia_nombre", "carrera", "_n_careers").alias("id")).collect()
    assert sorted(r.id for r in out) == ["CB-ÉTICA", "CB-ÉTICA", "ISC-REDES"]


def test_prereqs_any_form_f27(spark):
    from semestra.functions.text import prereqs_any_form
    arr = spark.createDataFrame([([" a ", "b"],), (None,)], "p array<string>")
    txt = spark.createDataFrame([('["a", "b"]',), (None,)], "p string")
    assert [r[0] for r in arr.select(prereqs_any_form(arr, "p")).collect()] == [["A", "B"], []]
    assert [r[0] for r in txt.select(prereqs_any_form(txt, "p")).collect()] == [["A", "B"], []]


def test_field_fallback_and_coerce_p12_p13(spark):
    from semestra.sources.store import coerce_for_store, field_fallback
    df = spark.createDataFrame([(None, "G7", "12", 1.5), ("", None, "x", 2.0)],
                               "grupo_id string, grupo string, anio string, promedio double")
    got = [r[0] for r in df.select(field_fallback(df, "grupo_id", "grupo", "N/A")).collect()]
    assert got == ["G7", "N/A"]
    out = coerce_for_store(df, int_fields=["anio", "missing"], avg_field="promedio").collect()
    assert [(r.anio, r.promedio) for r in out] == [(12, "1.5"), (None, "2.0")]
