"""File scans and sinks (S1-S4, S6, S8-S10) and the two-step key join."""

import collections
import json
import random
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.operators.joins import normalized_key_join
from semestra.sources import files

ROOMS = T.StructType([T.StructField("salon_id", T.StringType()),
                      T.StructField("nombre_salon", T.StringType()),
                      T.StructField("capacidad_base", T.IntegerType())])


def test_permissive_csv_with_bom_multiline_and_corrupt_row(spark, tmp_path):
    p = tmp_path / "salones.csv"
    p.write_bytes("﻿salon_id,nombre_salon,capacidad_base\n"
                  'S1,"Aula ""A""\nplanta 1",35\nS2,LAB 2,x\n'.encode("utf-8"))
    rows = files.read_csv_permissive(spark, str(p), ROOMS).orderBy("salon_id").collect()
    assert rows[0].salon_id == "S1" and rows[0].nombre_salon == 'Aula "A"\nplanta 1'
    assert rows[0].capacidad_base == 35 and rows[0][files.CORRUPT_COL] is None
    assert rows[1].capacidad_base is None and rows[1][files.CORRUPT_COL] is not None


def test_plain_csv_and_snapshots_term_from_file_name(spark, tmp_path):
    d = tmp_path / "snapshots"
    d.mkdir()
    for term, n in (("2019-1", 2), ("2019-2", 1)):
        lines = ["alumno_id,carrera,semestre_actual,estado,materias_aprobadas_json,anio_ingreso"]
        lines += [f'A{i},ISC,1,Activo,"[""X""]",2019' for i in range(n)]
        (d / f"alumnos_{term}.csv").write_text("\n".join(lines) + "\n")
    df = files.read_snapshots(spark, str(d / "*.csv"))
    got = sorted((r.semestre_historico, r.alumno_id, r.materias_aprobadas_json) for r in df.collect())
    assert got == [("2019-1", "A0", '["X"]'), ("2019-1", "A1", '["X"]'), ("2019-2", "A0", '["X"]')]


def test_json_lines_mixed_prereq_types_infer_text(spark, tmp_path):
    p = tmp_path / "materias.json"
    p.write_text("\n".join(json.dumps(x) for x in [
        {"nombre": "A", "semestre": 1, "prerrequisito": None},
        {"nombre": "B", "semestre": 2, "prerrequisito": ["A"]},
        {"nombre": "C", "semestre": 3, "prerrequisito": "B"}]) + "\n")
    df = files.read_json_lines(spark, str(p))
    assert isinstance(df.schema["prerrequisito"].dataType, T.StringType)


def test_parquet_and_json_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2025-1", 1, "x"), ("2025-2", 2, "y")], "t string, id int, v string")
    files.write_parquet(df, str(tmp_path / "pq"), partition_by=["t"])
    back = files.read_parquet(spark, str(tmp_path / "pq"), ["id", "v", "t"]).filter(F.col("t") == "2025-2")
    assert [tuple(r) for r in back.collect()] == [(2, "y", "2025-2")]
    files.write_json(df.repartition(2), str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2   # every part file is read
    files.write_json_document(df, str(tmp_path / "doc"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "doc"), wholetext=True).collect())
    assert sorted(x["id"] for x in json.loads(text)) == [1, 2]


def test_literal_table(spark):
    df = files.literal_table(spark, [("L-Mi-V 07:00-09:00", 7)], "str string, inicio int")
    assert df.first().inicio == 7


def test_normalized_key_join_j11(spark):
    left = spark.createDataFrame([("Cálculo I ",), ("REDES",), ("otra",)], "materia string")
    right = spark.createDataFrame([("CÁLCULO I", ["X"]), ("Redes", ["Y"]), ("REDES", ["Z"])],
                                  "materia_nombre string, prerequisitos array<string>")
    got = {r.materia: r.prerequisitos
           for r in normalized_key_join(left, right, "materia", "materia_nombre").collect()}
    assert got == {"Cálculo I ": ["X"], "REDES": ["Z"], "otra": None}


def _random_line(rng):
    texts = ["x", "a}{b", '"}{"', "\\", '\\"', "}", "{", "} {", "é}  {", ""]
    out, records = "", []
    for i in range(rng.randint(0, 6)):
        record = {"asistencia_id": str(i), "alumno_id": rng.choice(texts), "grupo_id": rng.choice(texts)}
        if rng.random() < .2:
            record["extra"] = {"a": {"b": rng.choice(texts)}}
        records.append((record["asistencia_id"], record["alumno_id"], record["grupo_id"]))
        out += rng.choice(["", "", " ", "\t "]) + json.dumps(record, ensure_ascii=rng.random() < .5)
    return out, records


def test_records_back_to_back_equal_a_json_decoder(spark):
    rng = random.Random(6)
    lines = [_random_line(rng) for _ in range(400)]
    df = spark.createDataFrame([(n, line) for n, (line, _) in enumerate(lines)], "n int, value string")
    got = collections.defaultdict(list)
    split = df.select("n", F.posexplode(files.split_concatenated_json("value")).alias("k", "j")).select(
        "n", "k", F.from_json("j", files.ATTENDANCE_SCHEMA).alias("r"))
    for r in split.orderBy("n", "k").collect():
        got[r.n].append((r.r.asistencia_id, r.r.alumno_id, r.r.grupo_id))
    assert [got[n] for n in range(len(lines))] == [records for _, records in lines]


def test_broken_records_do_not_take_others_along(spark):
    good = '{"asistencia_id":"%d"}'
    lines = [good % 1 + '{"asistencia_id":"2","alumno_id":"open}' + good % 3, None, "", "no json", good % 4 + "}" + good % 5]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {r.asistencia_id for r in files.parse_events(df).collect()} >= {"1", "3", "4"}


def test_splitting_is_linear_in_the_line(spark, tmp_path):
    record = json.dumps({c: "x" * 20 for c in files.ATTENDANCE_SCHEMA.fieldNames()})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(record * 50_000)
    events = files.read_text_events(spark, str(tmp_path / "in"))
    events.count()
    begun = time.time()
    assert events.count() == 50_000
    assert time.time() - begun < 10  # the quadratic form took 38 s for 4,000


def test_a_large_single_line_csv_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "rooms.csv"
    path.write_text("salon_id,nombre_salon,capacidad_base\n" + "".join(f'S{i},"Aula, {i}",{i % 50}\n' for i in range(200_000)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        split = files.read_csv_permissive(spark, str(path), ROOMS, multi_line=False)
        whole = files.read_csv_permissive(spark, str(path), ROOMS)
        parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
        assert parts(split) > 3 and parts(whole) == 1
        assert split.exceptAll(whole).count() == 0 and split.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
