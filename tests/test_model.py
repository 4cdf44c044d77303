"""M1-M8, Q13 on the sf0.001 model table."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as E
from semestra.plans import model
from semestra.session import ensure_checkpoint_dir, materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    mt = model.training_frame(E._model_ready(spark, SF)).drop("horario_visual")
    return materialize(mt, "test-model-ready")


def test_grid_search_fit_save_load_and_rmse(spark, ready):
    train, test = model.hash_split(ready, "grupo_id")
    n_train, n_test = train.count(), test.count()
    assert n_train + n_test == ready.count() and n_test > 0
    fitted = model.train_model(train, grid=True, folds=2, depth=[2, 3], iters=[5], parallelism=2)
    rmse = model.evaluate(fitted, test)
    mean = train.agg(F.avg(model.LABEL)).first()[0]
    base = math.sqrt(test.agg(F.avg((F.col(model.LABEL) - F.lit(mean)) ** 2)).first()[0])
    assert rmse < base
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-model"
    model.save_model(fitted, path)
    again = model.load_model(path)
    a = model.score_candidates(fitted, test).orderBy("grupo_id").select("prediction").collect()
    b = model.score_candidates(again, test).orderBy("grupo_id").select("prediction").collect()
    assert a == b
    imp = model.feature_importance(spark, fitted).collect()
    assert imp and all(r.importancia > 0.1 for r in imp)
    assert [r.importancia for r in imp] == sorted((r.importancia for r in imp), reverse=True)


def test_hash_split_is_stable(spark, ready):
    a, _ = model.hash_split(ready, "grupo_id")
    b, _ = model.hash_split(ready.repartition(7), "grupo_id")
    assert sorted(r[0] for r in a.select("grupo_id").collect()) == \
        sorted(r[0] for r in b.select("grupo_id").collect())


def test_safe_cast_requires_columns(spark):
    df = spark.createDataFrame([("1.5",)], "a string")
    with pytest.raises(ValueError):
        model.safe_cast_double(df, ["a", "b"])
    assert model.safe_cast_double(df, ["a"]).first()[0] == 1.5


def test_serving_features_q13(spark):
    cands = spark.createDataFrame([(1, "M", 150, 35, 7, 3), (2, "N", 40, 30, 9, 6)],
                                  "profesor_id int, materia_nombre string, demanda_real int, "
                                  "capacidad_base int, inicio int, semestre_materia int")
    q = spark.createDataFrame([(1, 91.0)], "profesor_id int, Calidad_Profesor double")
    r = {x.profesor_id: x for x in model.serving_features(cands, q).collect()}
    assert (r[1].X_Cp_Profesor, r[1].X_Factor_Demanda_Normalizado) == (91.0, 1.0)
    assert (r[2].X_Cp_Profesor, r[2].X_Factor_Demanda_Normalizado) == (85.0, 0.4)


def test_grid_points_of_one_fit_equal_their_own_fits(spark, ready):
    train, _ = model.hash_split(ready, "grupo_id")
    found = model.grid_search(train, folds=2, depth=[2], iters=[3, 6], parallelism=2)
    assert [p["rmse"] for p in found] == sorted(p["rmse"] for p in found) and len(found) == 2
    stages = model.feature_stages(train)
    table = model.with_fold(stages.transform(train), "grupo_id", 2)
    for p in found:
        for fold in range(2):
            alone = model._booster(model._bins(stages), 2, p["maxIter"], 0.1).fit(table.where(F.col("fold") != fold))
            rmse = model.rmse_evaluator().evaluate(alone.transform(table.where(F.col("fold") == fold)))
            assert math.isclose(rmse, p["folds"][fold], rel_tol=1e-6)


def test_folds_do_not_depend_on_partitions(spark, ready):
    a = model.with_fold(ready, "grupo_id").select("grupo_id", "fold").collect()
    b = model.with_fold(ready.repartition(5), "grupo_id").select("grupo_id", "fold").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and {r.fold for r in a} == {0, 1, 2}


def test_permutation_importance_finds_the_feature_that_counts(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("grupo_id"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100.0).alias("X_Cp_Profesor"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 100.0).alias("X_Factor_Demanda_Normalizado"),
        F.lit(30.0).alias("X_capacidad_salon"), F.lit(7.0).alias("X_Hora_Inicio"), F.lit(1.0).alias("X_Semestre_Num"),
        F.concat(F.lit("M"), (F.col("id") % 3).cast("string")).alias("materia_nombre_visual"))
    rows = rows.withColumn(model.LABEL, 3 * F.col("X_Cp_Profesor") + F.when(F.col("materia_nombre_visual") == "M1", 0.5).otherwise(0.0))
    fitted = model.train_model(rows, grid=False, depth=[3], iters=[10])
    out = {r.feature: r for r in model.permutation_importance(fitted, rows).collect()}
    assert set(out) == set(model.FEATURE_LABELS.values())
    teacher, course = out["Ranking Profesor"], out["Materia (Dificultad)"]
    assert teacher.importancia > course.importancia > 1 and teacher.rise > 0.5
    assert abs(out["Horario Preferido"].rise) < 1e-9 and out["Horario Preferido"].importancia == 0
    assert 99 < sum(r.importancia for r in out.values()) < 101


def test_scored_timetable_equals_scoring_every_candidate(spark, ready):
    from semestra.plans import model_reports, timetable
    fitted, loaded, test = model_reports.fitted_model(ready, depth=3, iters=5)
    a, b = (model.score_candidates(m, test).select("prediction").orderBy("grupo_id").collect() for m in (fitted, loaded))
    assert a == b
    courses = spark.createDataFrame([(f"BRAND#{i}", "BUILDING", 1 + i % 6, 30 + 20 * i, i % 2) for i in range(1, 7)],
                                    "materia_nombre string, carrera_materia string, semestre_materia int, demanda_real long, room_pool int")
    pairs = courses.select("materia_nombre", "carrera_materia").crossJoin(
        spark.createDataFrame([(t, f"T{t}") for t in range(4)], "profesor_id long, nombre_profesor string"))
    rooms = spark.createDataFrame([(f"R{r}", [20, 30][r % 3 == 0], r % 2) for r in range(6)],
                                  "salon_id string, capacidad_base int, room_pool int")
    quality = spark.createDataFrame([(t, 60.0 + 9 * t) for t in range(3)], "profesor_id long, Calidad_Profesor double")
    got = model_reports.model_timetable(loaded, courses, pairs, rooms, quality)
    cands = timetable.candidate_sections(courses, pairs, rooms)
    scored = model.score_candidates(loaded, model.serving_features(cands, quality))
    want, _ = timetable.greedy_timetable(scored)
    cols = [c for c in want.columns if c != "round"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() > 5


def test_training_rows_measure_the_sections_once(spark):
    from semestra.plans import features
    from semestra.sources import driver as drv
    dem = spark.createDataFrame([("BRAND#11", "BUILDING", 1, "1995-1", 40), ("BRAND#11", "NOWHERE", 1, "1995-1", 400)],
                                "materia_nombre string, carrera string, semestre_materia int, periodo_historico string, demanda_potencial long")
    rows = features.model_table(drv.sections(spark, SF), drv.enrolments(spark, SF), dem, drv.teachers(spark, SF))
    assert "lineitem.parquet" not in rows._jdf.queryExecution().toString()
    top = rows.groupBy("demanda_raw_historica").agg(F.max("X_Factor_Demanda_Normalizado").alias("f"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.demanda_raw_historica, r.f) for r in top} <= {(0, 0.0), (40, 1.0)}  # 400 is no section's demand
    assert sum(r.n for r in top) == drv.sections(spark, SF).count()


def _rows(spark, n, courses=3, label="pmod(hash(id, 2), 1000) / 1000 + pmod(id, 3)"):
    """Sections with a quality of their own each, two hours, and a few null or NaN features."""
    return spark.range(n).selectExpr(
        "id grupo_id", f"{label} {model.LABEL}", f"concat('M', pmod(id, {courses})) materia_nombre_visual",
        "CASE WHEN id % 97 = 5 THEN NULL WHEN id % 97 = 6 THEN double('NaN') ELSE pmod(hash(id), 9973) - 300.5 END X_Cp_Profesor",
        "pmod(hash(id, 1), 5) / 5 X_Factor_Demanda_Normalizado", "7.0D X_capacidad_salon",
        "double(7 + 4 * pmod(id, 2)) X_Hora_Inicio", "double(1 + pmod(id, 2)) X_Semestre_Num")


def test_fits_work_on_cells_not_rows(spark, monkeypatch):
    rows = materialize(_rows(spark, 12_000), "test-rows")
    seen, fit = [], model.GBTRegressor._fit

    def counting(self, df):
        seen.append(df.count())
        return fit(self, df)

    monkeypatch.setattr(model.GBTRegressor, "_fit", counting)
    found = model.grid_search(rows, folds=2, depth=[2], iters=[2], parallelism=2)
    model.train_model(rows, grid=False, depth=[2], iters=[2])
    assert len(found) == 1 and len(seen) == 3
    assert max(seen) <= 32 * 5 * 2 * 3 < 2_000  # bins of quality and demand, hours (they fix the semester), courses


@pytest.mark.parametrize("quality", [None, 1.0])
def test_a_fit_on_cells_equals_one_on_rows(spark, quality):
    rows = _rows(spark, 3_000)  # few enough that a fit on rows looks at all of them for its bins
    if quality:  # a cell a course: fewer than Spark wants examples
        rows = rows.withColumns({f: F.lit(1.0) for f in model.ORDERED})
    rows = materialize(rows, "test-rows")
    stages = model.feature_stages(rows)
    plain = PipelineModel(stages=[*stages.stages, model._booster(model._bins(stages), 3, 4, 0.1).fit(stages.transform(rows))])
    fitted = model.train_model(rows, grid=False, depth=[3], iters=[4])
    odd = rows.limit(300).withColumns({"grupo_id": -F.col("grupo_id") - 1, "materia_nombre_visual": F.lit("new"), "X_Hora_Inicio": F.lit(9.0)})
    both = rows.unionByName(odd)  # hour 9 is a split point
    a, b = ({r.grupo_id: r.prediction for r in m.transform(both).select("grupo_id", "prediction").collect()} for m in (plain, fitted))
    assert a.keys() == b.keys() and len(a) == (3_300 if quality else both.where("X_Cp_Profesor IS NOT NULL AND NOT isnan(X_Cp_Profesor)").count())
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9 and len(set(a.values())) > 2
    assert fitted.stages[-1].featureImportances.toArray() == pytest.approx(plain.stages[-1].featureImportances.toArray(), abs=1e-9)


def test_a_fit_on_cells_refuses_null_labels(spark):
    rows = _rows(spark, 200, label="CASE WHEN id = 150 THEN NULL ELSE id / 200 END")
    with pytest.raises(Exception, match="(?i)label"):
        model.train_model(rows, grid=False, depth=[2], iters=[2])
