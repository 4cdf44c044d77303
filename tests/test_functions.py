"""Edge rows from FIXTURES.md for the scalar functions and small operators."""

from pyspark.sql import functions as F

from semestra.functions import numeric as N
from semestra.functions import schedule as S
from semestra.functions import text as X


def col1(spark, values, ddl, expr):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_parse_name_list_f1(spark):
    got = col1(spark, [None, '["A"]', '{"a":1}', "A, B,", ""], "s string",
               X.parse_name_list("s"))
    assert got == [[], ["A"], [], ["A", "B"], []]


def test_parse_prereqs_f4(spark):
    got = col1(spark, ['["x","y"]', "x , y", None, "[]", '["NULL"]'], "s string",
               X.parse_prereqs("s"))
    assert got == [["X", "Y"], ["X", "Y"], [], [], []]


def test_parse_schedule_f5(spark):
    got = col1(spark, ['{"Lunes":"7-9","Viernes":"x"}', "bad", None, '{"Martes":"7-x"}'],
               "s string", X.parse_schedule("s"))
    assert [[tuple(e) for e in r] for r in got] == [
        [("LUNES", 7, 9), ("VIERNES", None, None)], [], [], [("MARTES", None, None)]]


def test_parse_name_list_loose_f3(spark):
    got = col1(spark, ["", "['a', 'b ']", '[" c "]', None], "s string",
               X.parse_name_list_loose("s"))
    assert got == [[], ["A", "B"], ["C"], []]


def test_clean_name_array_f2(spark):
    df = spark.createDataFrame([(["  cálculo   i ", "", " x"],)], "a array<string>")
    assert df.select(X.clean_name_array("a")).first()[0] == ["CÁLCULO I", "X"]


def test_safe_ratio_f6(spark):
    df = spark.createDataFrame([(3, 0), (3, 4)], "n int, d int")
    assert [r[0] for r in df.select(N.safe_ratio("n", "d")).collect()] == [0.0, 0.75]


def test_not_dropped_p6(spark):
    df = spark.createDataFrame([("True",), ("False",), ("false",), (None,)], "f string")
    assert [r[0] for r in df.select(N.not_dropped("f")).collect()] == [False, True, True, False]


def test_first_start_hour_p9(spark):
    df = spark.createDataFrame([([],), ([("LUNES", 11, 13)],), (None,)],
                               "h array<struct<dia:string,inicio:int,fin:int>>")
    assert [r[0] for r in df.select(X.first_start_hour("h")).collect()] == [7, 11, 7]


def test_attendance_adjustment_f15(spark):
    df = spark.createDataFrame([(10, 6, 4), (8, 3, 5), (2, 1, 1), (0, 0, 0)], "t int, p int, a int")
    got = [r[0] for r in df.select(N.attendance_adjustment("t", "p", "a")).collect()]
    assert got == [0.5, -0.5, 0.0, 0.0]


def test_occupancy_factor_f16(spark):
    df = spark.createDataFrame([(10, 35), (20, 35), (18, 36)], "s int, c int")
    got = [r[0] for r in df.select(N.occupancy_factor("s", "c")).collect()]
    assert abs(got[0] - 10 / 35) < 1e-12 and got[1:] == [1.0, 1.0]


def test_rounding_f11(spark):
    df = spark.createDataFrame([(0.25,), (2.5,)], "x double")
    r = df.select(N.round_half_up("x", 1), N.round_half_even("x", 1),
                  N.round_half_even("x", 0)).collect()
    assert (r[0][0], r[0][1]) == (0.3, 0.2) and r[1][2] == 2.0


def test_slot_days_hours_f12_f13(spark):
    df = spark.createDataFrame([("L-Mi-V 07:00-09:00",), ("Ma-Ju 11:00-13:00",), ("X 09:00-09:00",)],
                               "s string")
    r = df.select(S.slot_days("s"), S.slot_hours("s")).collect()
    assert r[0][0] == ["LUNES", "MIERCOLES", "VIERNES"] and r[0][1] == [7, 8]
    assert r[1][0] == ["MARTES", "JUEVES"] and r[1][1] == [11, 12]
    assert r[2][1] == []


def test_block_map_ints_f21_a11_a14(spark):
    df = spark.createDataFrame([({"LUNES": ["8", " 9 "], "MARTES": ["x"]},)],
                               "b map<string,array<string>>")
    r = df.select(S.block_map_ints("b").alias("m")).select(
        "m", S.blocks_text("m"), S.hours_blocked_per_day("m")).first()
    assert r[0] == {"LUNES": [8, 9]} and r[1] == "LUNES: 8, 9" and r[2] == {"LUNES": 2}


def test_department_and_rooms_f22_f23(spark):
    df = spark.createDataFrame([("CÁLCULO I", "ISC"), ("REDES", "ISC"), ("CONTABILIDAD", "X"),
                                ("ÉTICA", "X"), ("LAB DE FÍSICA", "IND")], "c string, k string")
    r = df.select(S.department_of("c", "k"), S.needs_lab("c")).collect()
    assert [x[0] for x in r] == ["Ciencias Basicas", "Sistemas", "Administracion",
                                 "Desarrollo Humano", "Ciencias Basicas"]
    assert [x[1] for x in r] == [False, False, False, False, True]


def test_sections_needed_and_capacity_f24_f28_f29(spark):
    df = spark.createDataFrame([(40, 3, 30, 3), (51, 6, 20, 6)], "d int, s int, r int, cur int")
    r = df.select(N.sections_needed("d", "s"), N.effective_capacity(F.lit(35), "r"),
                  N.load_class("s", F.lit(4))).collect()
    assert [tuple(x) for x in r] == [(2, 30, "backlog"), (3, 20, None)]


def test_tiers_and_seats_f17_f18_f19(spark):
    df = spark.createDataFrame([(0.456, 91.0), (55.0, 80.0), (1.0, 10.0)], "v double, s double")
    r = df.select(N.percent_if_fraction("v"), N.score_tier("s"),
                  N.split_seats(N.seats_text(F.lit(5), F.lit(35)))).collect()
    assert [x[0] for x in r] == [45.6, 55.0, 100.0]
    assert [x[1] for x in r] == ["success", "warning", "danger"]
    assert tuple(r[0][2]) == (5, 35)


def test_mean_start_hour_f25(spark):
    df = spark.createDataFrame([([("L", 7, 9), ("M", 9, 11)],), ([],)],
                               "h array<struct<dia:string,inicio:int,fin:int>>")
    assert [r[0] for r in df.select(X.mean_start_hour("h")).collect()] == [8.0, None]


def test_clean_str_cols_p1(spark):
    df = spark.createDataFrame([("  a \t b  ", 3)], "x string, y int")
    assert tuple(X.clean_str_cols(df).first()) == ("a b", "3")
