"""Rows on which an earlier version gave wrong or incomplete answers."""

import random


from semestra.functions.text import parse_name_list, parse_name_list_loose
from semestra.operators.greedy import rank_key
from semestra.plans import features, timetable
from semestra.sources import driver as drv
from semestra.sources.files import parse_events
from semestra.sources.store import field_fallback, replace_table_rows

SF = "/root/testdata/sf0.001"


def test_every_line_is_in_exactly_one_section(spark):
    sections = drv.sections(spark, SF)
    n = sections.count()
    assert n == sections.select("grupo_id").distinct().count() == drv.read(spark, SF, "orders").count()
    enr = drv.enrolments(spark, SF)
    assert enr.join(sections, "grupo_id").count() == enr.count() == drv.read(spark, SF, "lineitem").count()


def test_section_tables_have_one_row_per_section(spark):
    sections, enr = drv.sections(spark, SF), drv.enrolments(spark, SF)
    _, quality = features.teacher_quality(sections, enr)
    for out in (features.section_features(sections, enr), quality):
        assert out.count() == out.select("grupo_id").distinct().count()


def test_name_lists_are_json_only_as_a_whole(spark):
    rows = ["12 MONKEYS, B", '"X", B', "true, B", '{"a":1}, B', '["A"], B', '["A","B"]', '{"a":1}', "A, B,", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string").orderBy("i")
    got = [r[0] for r in df.select(parse_name_list("v")).collect()]
    assert got == [["12 MONKEYS", "B"], ['"X"', "B"], ["true", "B"], ['{"a":1}', "B"], ['["A"]', "B"], ["A", "B"], [],
                   ["A", "B"], [], []]
    assert df.select(parse_name_list_loose("v")).collect()[4][0] == ["A", "B"]


def test_event_text_with_braces_keeps_its_record(spark):
    line = '{"asistencia_id":"1","alumno_id":"a}{b"}{"asistencia_id":"2"} {"asistencia_id":"3","alumno_id":"q\\"}{"}'
    rows = parse_events(spark.createDataFrame([(line,)], "value string")).select("asistencia_id", "alumno_id").collect()
    assert [tuple(r) for r in rows] == [("1", "a}{b"), ("2", None), ("3", 'q"}{')]


def test_refresh_derives_its_keys(spark):
    df = spark.createDataFrame([(5, "g", "M", "old"), (None, None, None, "n")],
                               "semestre int, grupo string, materia string, materia_nombre string")
    rows = replace_table_rows(df).select("semestre_id", "grupo_id", "materia_nombre").collect()
    assert [tuple(r) for r in rows] == [("5", "g", "M"), ("2025-1", "UNKNOWN", "n")]


def test_truth_of_a_field_follows_its_type(spark):
    df = spark.createDataFrame([(0.0, "0", True), (1.5, "", False), (None, "false", None)], "d double, s string, b boolean")
    pick = lambda a, b: [r[0] for r in df.select(field_fallback(df, a, b, "-")).collect()]
    assert pick("d", "s") == ["0", "1.5", "false"] and pick("b", "s") == ["true", "-", "false"]


def test_course_of_a_bare_department_gets_all_teachers(spark):
    courses = spark.createDataFrame([("CÁLCULO", "ISC")], "materia_nombre string, carrera_materia string")
    teachers = spark.createDataFrame([(1, "A", "Otro"), (2, "B", "Nada")], "profesor_id int, nombre_profesor string, departamento string")
    assert {r.profesor_id for r in timetable.department_teacher_pairs(courses, teachers).collect()} == {1, 2}


def test_capped_timetable_is_a_prefix_of_the_whole(spark):
    rng = random.Random(4)
    rows = [(f"C{rng.randrange(6)}", rng.randrange(8), f"R{rng.randrange(5)}", f"S{rng.randrange(3)}",
             rng.choice([None, 1.0, 2.0, 3.0, 3.0]), 20, 60) for _ in range(300)]
    df = spark.createDataFrame(sorted(set(rows), key=str), "course string, teacher int, room string, slot string, score double, "
                               "cap int, demand long").withColumn("rk", rank_key("score", ["course", "teacher", "room", "slot"]))
    from semestra.operators.greedy import greedy_select
    run = lambda n, factor: [(r.course, r.teacher, r.room, r.slot, r.seats) for r in greedy_select(
        df, ["course"], "teacher", "room", "slot", "rk", "cap", "demand", max_sections=n, prefix_factor=factor)[0].orderBy("_ord").collect()]
    whole = run(None, 64)
    for n, factor in ((3, 1), (5, 64), (len(whole), 1)):
        assert run(n, factor) == whole[:n]


def test_late_records_count_in_the_stream(spark, tmp_path):
    from semestra.plans import attendance as att
    from semestra.streaming import attendance as stream
    days = ["2024-05-09", "2024-01-01", "2024-05-10", "2023-01-01"]
    for n, day in enumerate(days):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(
            f'{{"asistencia_id":"{n}","grupo_id":"g","tipo_evento":"Entrada","fecha_hora_evento":"{day}T08:00:00.000000","timestamp_ingesta":"{day}"}}')
    sections = spark.createDataFrame([("g", "p", "8")], "grupo_id string, profesor_id string, hora_inicio_promedio string")
    events = stream.read_event_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    stream.run_attendance_stream(events, sections, str(tmp_path / "counts"), str(tmp_path / "ckpt")).awaitTermination()
    got = stream.stats_from_counts(stream.read_counts(spark, str(tmp_path / "counts"))).first()
    batch = att.attendance_stats(att.events_with_sections(parse_events(spark.read.text(str(tmp_path / "in"))), sections)).first()
    assert got.total == batch.total == 4
