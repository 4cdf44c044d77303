"""End to end on raw files: ETL -> training -> prediction."""

import json
import random

from pyspark.sql import functions as F

from semestra.plans import jobs

ISC = [("Cálculo I", 1, None), ("Programación", 1, None), ("Redes", 2, "Programación"),
       ("Lab de Física", 2, "Cálculo I")]
IND = [("Cálculo I", 1, None), ("Contabilidad", 1, None), ("Ética", 2, ["Contabilidad"])]
TEACHERS = [("P1", "Ana", "Ciencias Basicas"), ("P2", "Beto", "Ciencias Basicas"),
            ("P3", "Carla", "Sistemas"), ("P4", "Dario", "Sistemas"), ("P5", "Eva", "Industrial"),
            ("P6", "Fede", "Administracion"), ("P7", "Gina", "Desarrollo Humano")]
ROOMS = [("A1", "Aula 1", 35), ("A2", "Aula 2", 30), ("L1", "LAB CC1", 25)]
TERMS = ["2024-1", "2024-2"]


def write_csv(path, header, rows, bom=False):
    lines = [",".join(header)] + [",".join(f'"{str(v)}"' if isinstance(v, str) and ("," in v or '"' in v)
                                           else str(v) for v in r) for r in rows]
    text = "\n".join(lines) + "\n"
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")


def q(v):
    return '"' + v.replace('"', '""') + '"'


def build_raw(tmp):
    rnd = random.Random(3)
    raw = tmp / "raw"
    (raw / "snapshots").mkdir(parents=True)
    (raw / "materias_ISC.json").write_text("\n".join(
        json.dumps({"nombre": n, "semestre": s, "prerrequisito": p}, ensure_ascii=False)
        for n, s, p in ISC) + "\n", encoding="utf-8")
    (raw / "materias_IND.json").write_text("\n".join(
        json.dumps({"nombre": n, "semestre": s, "prerequisitos": p}, ensure_ascii=False)
        for n, s, p in IND) + "\n", encoding="utf-8")
    write_csv(raw / "catalogo_profesores.csv",
              ["profesor_id", "nombre_profesor", "departamento", "calidad_simulada"],
              [(a, b, c, "Media") for a, b, c in TEACHERS], bom=True)
    write_csv(raw / "catalogo_salones.csv", ["salon_id", "nombre_salon", "capacidad_base"],
              ROOMS, bom=True)
    students = {c: [f"{c}{i:03d}" for i in range(60)] for c in ("ISC", "IND")}
    for term in TERMS:
        rows = []
        for career, ids in students.items():
            first = [n.upper() for n, s, p in (ISC if career == "ISC" else IND) if s == 1]
            for i, a in enumerate(ids):
                passed = first[: i % 3] if term == "2024-2" else []
                estado = "Desercion" if i % 17 == 0 else "Activo"
                rows.append((a, career, 2 if term == "2024-2" else 1, estado,
                             q(json.dumps(passed, ensure_ascii=False)), 2024))
        write_csv(raw / "snapshots" / f"alumnos_{term}.csv",
                  ["alumno_id", "carrera", "semestre_actual", "estado",
                   "materias_aprobadas_json", "anio_ingreso"], rows)
    sections, enrol, gid = [], [], 0
    for term in TERMS:
        for career, cat in (("ISC", ISC), ("IND", IND)):
            for n, s, _ in cat:
                for k in range(2):
                    gid += 1
                    t = rnd.choice([x for x in TEACHERS])
                    room = ROOMS[gid % 3]
                    hour = rnd.choice([7, 9, 11, 15])
                    sched = q(json.dumps({"Lunes": f"{hour}-{hour + 2}",
                                          "Miercoles": f"{hour}-{hour + 2}"}))
                    sections.append((f"G{gid}", term, career, f"{career}-{n.upper()}", n.upper(), s,
                                     t[0], "Media", room[0], 30, sched, hour,
                                     rnd.choice(["True", "False", "false"])))
                    for j in range(12):
                        grade = rnd.randint(40, 100)
                        enrol.append((f"I{gid}-{j}", f"G{gid}", students[career][j * 4 % 60],
                                      grade, "True" if grade < 60 else "False"))
    write_csv(raw / "grupos_historicos.csv", jobs.SECTIONS.fieldNames(), sections)
    write_csv(raw / "inscripciones.csv", jobs.ENROLMENTS.fieldNames(), enrol)
    att = tmp / "asistencia"
    att.mkdir()
    recs = []
    for i in range(80):
        g = sections[-1 - (i % 10)]
        recs.append(json.dumps({"asistencia_id": str(9000000 + i), "alumno_id": "x", "grupo_id": g[0],
                                "fecha_hora_evento": "2024-09-01T08:00:00.000000",
                                "tipo_evento": "Ausencia" if i % 4 == 0 else "Entrada",
                                "timestamp_ingesta": "2024-09-01T08:00:01.000000"}))
    (att / "part-0.txt").write_text("\n".join(recs + recs[:5]) + "\n")
    return raw, att


def test_etl_training_prediction(spark, tmp_path):
    raw, att = build_raw(tmp_path)
    out = tmp_path / "out"
    etl = jobs.etl_job(spark, str(raw), str(out))
    assert etl["materias_normalizadas"].count() == len(ISC) + len(IND)
    mr = etl["model_ready"]
    assert mr.count() == 2 * 2 * (len(ISC) + len(IND))
    assert mr.filter(F.col("demanda_raw_historica") > 0).count() > 0
    assert etl["cuellos_de_botella"].count() == 5

    res = jobs.training_job(spark, str(out / "model_ready"), str(out / "model"), grid=False,
                            depth=[3], iters=[5])
    assert res.train_rows + res.test_rows == mr.count()

    restrictions = spark.createDataFrame(
        [("profesor", "P3", "Carla", {"LUNES": ["8"]}, "True")],
        "tipo_restriccion string, profesor_id string, nombre_visual string, "
        "bloqueos map<string,array<string>>, activo string")
    pred = jobs.prediction_job(
        spark, str(out / "model"), str(raw / "snapshots" / "alumnos_2024-2.csv"),
        str(out / "materias_normalizadas"), str(raw / "catalogo_profesores.csv"),
        str(raw / "catalogo_salones.csv"), str(raw / "grupos_historicos.csv"), str(att),
        restrictions, str(tmp_path / "pred"))
    plan = pred["timetable"].collect()
    assert plan
    assert len({(r.profesor_id, r.horario) for r in plan}) == len(plan)
    assert len({(r.salon, r.horario) for r in plan}) == len(plan)
    assert not [r for r in plan if r.profesor_id == "P3" and r.horario == "L-Mi-V 07:00-09:00"]
    demand = {(r.materia_nombre, r.carrera_materia): r.demanda_real for r in pred["demand"].collect()}
    seated = {}
    for r in plan:
        seated[(r.materia, r.carrera)] = seated.get((r.materia, r.carrera), 0) + r.inscritos
    assert all(v <= demand[k] for k, v in seated.items())
    # labs only in the LAB room, other courses never there
    assert all((r.salon == "L1") == ("LAB" in r.materia) for r in plan)
    k = pred["kpis"].first()
    assert k.num_grupos == len(plan)
    assert pred["attendance_stats"].agg(F.sum("total")).first()[0] == 80
