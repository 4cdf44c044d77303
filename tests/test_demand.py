"""Demand by bits equals a plain division, student by student."""

import collections
import random

import pytest

from semestra.plans import demand

STUDENT = "alumno_id long, carrera string, estado string, semestre_actual int, semestre_historico string, materias_aprobadas array<string>"
COURSE = "materia_nombre string, carrera string, semestre_materia int, prerequisitos array<string>"


def brute(students, courses, exclude):
    out = collections.Counter()
    for _, car, state, sem, term, passed in students:
        for name, c_car, c_sem, pre in courses:
            if state != "Activo" or car is None or car != c_car or sem is None or c_sem is None or sem < c_sem:
                continue
            got = set(passed or [])
            out[name, car, c_sem, term] += set(pre or []) <= got and not (exclude and name in got)
    return dict(out)


def case(rng, n_courses, n_students):
    names = [f"M{i:03}" for i in range(n_courses)]
    courses = [(n, c, rng.choice([1, 2, 3, None]) if rng.random() < .1 else rng.randint(1, 4),
                rng.choice([None, [], rng.sample(names, min(n_courses, rng.randint(1, 3))), ["elsewhere"]]))
               for c in "AB" for n in names if rng.random() < .9]
    courses.append((names[0], "A", 1, [names[-1]]))  # one name with two prerequisite lists
    students = [(i, rng.choice(["A", "B", "C", None]), rng.choice(["Activo", "Activo", "Baja", None]),
                 rng.choice([1, 2, 3, 4, 10, None]), rng.choice(["2024-1", "2024-2"]),
                 rng.choice([None, [], rng.sample(names, rng.randint(0, n_courses)), [*names, "elsewhere", None]]))
                for i in range(n_students)]
    return students, courses


@pytest.mark.parametrize("n_courses", [3, 62, 130])
@pytest.mark.parametrize("exclude", [True, False])
def test_history_equals_plain_division(spark, n_courses, exclude):
    students, courses = case(random.Random(n_courses), n_courses, 120)
    got = {(r.materia_nombre, r.carrera, r.semestre_materia, r.periodo_historico): r.demanda_potencial
           for r in demand.potential_demand_history(spark.createDataFrame(students, STUDENT), spark.createDataFrame(courses, COURSE),
                                                    exclude).collect()}
    assert got == brute(students, courses, exclude)


def test_current_demand_equals_plain_division(spark):
    students, courses = case(random.Random(2), 20, 400)
    want = collections.Counter()
    for (name, car, sem, _), n in brute(students, courses, True).items():
        want[name, sem, car] += n
    out = demand.current_demand(spark.createDataFrame(students, STUDENT), spark.createDataFrame(courses, COURSE), 15)
    got = {(r.materia_nombre, r.semestre_materia, r.carrera_materia): r.demanda_real for r in out.collect()}
    assert got == {k: n for k, n in want.items() if n >= 15} and got
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(carrera#" not in plan  # no shuffle on the career alone


def test_no_courses_and_no_students(spark):
    students, courses = case(random.Random(4), 5, 20)
    s, c = spark.createDataFrame(students, STUDENT), spark.createDataFrame(courses, COURSE)
    assert demand.potential_demand_history(s.limit(0), c).count() == 0
    assert demand.potential_demand_history(s, c.limit(0)).count() == 0
    odd = spark.createDataFrame([("X", "A", 1, ["Y", None]), ("Z", None, 1, [])], COURSE)
    assert {r.demanda_potencial for r in demand.potential_demand_history(s, odd).collect()} == {0}


def test_students_are_tested_in_compiled_code_without_lambdas(spark):
    students, courses = case(random.Random(6), 20, 50)
    out = demand.potential_demand_history(spark.createDataFrame(students, STUDENT), spark.createDataFrame(courses, COURSE))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "hashpartitioning(carrera#" not in out._jdf.queryExecution().toString()


def test_course_with_no_many_and_repeated_prerequisites(spark):
    courses = [("A", "X", 1, None), ("B", "X", 1, ["A", "A"]), ("C", "X", 1, ["A", "B", "D", "E"]), ("D", "X", 1, ["A", None]), (None, "X", 1, ["A"])]
    students = [(i, "X", "Activo", 1, "2024-1", p) for i, p in enumerate([None, [], ["A"], ["A", None], ["A", "B", "D", "E"], ["D", "E", "B", "A", "A"]])]
    out = demand.potential_demand_history(spark.createDataFrame(students, STUDENT), spark.createDataFrame(courses, COURSE))
    assert {r.materia_nombre: r.demanda_potencial for r in out.collect()} == {"A": 2, "B": 2, "C": 2, "D": 0, None: 4}
