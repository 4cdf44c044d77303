"""Reports on the section-score model over the derived academic schema: its
features, folds, grid, importances and the timetable it ranks.

Each report takes the training rows (``training_frame``); those that SQL can
express have an oracle beside the model table's.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.plans import model, timetable
from semestra.session import drop_written, materialize, scratch_path

KEY = "grupo_id"


def feature_table(rows: DataFrame) -> DataFrame:
    """Every section's split, fold and six features as the
    model's vector holds them; the course index is fitted on the training part."""
    train, test = model.hash_split(rows, KEY)
    stages = model.feature_stages(train)
    both = stages.transform(train).withColumn("parte", F.lit("train")).unionByName(
        stages.transform(test).withColumn("parte", F.lit("test")))
    v = vector_to_array("features")
    return model.with_fold(both, KEY).select(
        KEY, "parte", "fold", F.col(model.LABEL).alias("objetivo"), *[v[i].alias(f) for i, f in enumerate(model.FEATURES)])


def fold_sizes(rows: DataFrame) -> DataFrame:
    """Rows of every part and fold."""
    train, test = model.hash_split(rows, KEY)
    both = train.withColumn("parte", F.lit("train")).unionByName(test.withColumn("parte", F.lit("test")))
    return model.with_fold(both, KEY).groupBy("parte", "fold").agg(F.count(F.lit(1)).alias("n"))


def grid_report(rows: DataFrame) -> DataFrame:
    """M4, M5, M8: the four grid points with their mean RMSE over three folds;
    the chosen one also with its RMSE on the held-out part, and that of
    predicting the training mean there."""
    train, test = model.hash_split(rows, KEY)
    found = model.grid_search(train, KEY)
    best = found[0]
    fitted = model.train_model(train, grid=False, depth=[best["maxDepth"]], iters=[best["maxIter"]], steps=[best["stepSize"]])
    mean = train.agg(F.avg(model.LABEL)).first()[0]
    spread = test.agg(F.sqrt(F.avg((F.col(model.LABEL) - F.lit(mean)) ** 2))).first()[0]
    held = model.evaluate(fitted, test)
    return rows.sparkSession.createDataFrame(
        [(p["maxDepth"], p["maxIter"], p["stepSize"], p["rmse"], p is best, held if p is best else None,
          spread if p is best else None) for p in found],
        "maxDepth int, maxIter int, stepSize double, rmse double, elegido boolean, rmse_prueba double, rmse_media double")


def fitted_model(rows: DataFrame, depth: int = 5, iters: int = 20):
    """A model of given parameters on the training part, saved and loaded again."""
    train, test = model.hash_split(rows, KEY)
    fitted = model.train_model(train, grid=False, depth=[depth], iters=[iters], by_rows=True)
    path = scratch_path(rows.sparkSession, "model")
    model.save_model(fitted, path)
    loaded = model.load_model(path)
    drop_written(rows.sparkSession, [path])
    return fitted, loaded, test


def importances(rows: DataFrame) -> DataFrame:
    """M7: the trees' own importance of every feature beside the measured one
    (rise of the held-out RMSE when the feature is shuffled)."""
    _, loaded, test = fitted_model(rows)
    own = model.feature_importance(rows.sparkSession, loaded, min_importance=-1.0) \
        .withColumnRenamed("importancia", "importancia_arbol")
    return model.permutation_importance(loaded, test, KEY).join(own, "feature", "left")


def reloaded_scores(rows: DataFrame) -> DataFrame:
    """Held-out sections scored by the fitted model and by its saved
    and loaded copy."""
    fitted, loaded, test = fitted_model(rows)
    a = model.score_candidates(fitted, test).select(KEY, model.LABEL, "prediction", "score_predicho")
    b = model.score_candidates(loaded, test).select(KEY, F.col("prediction").alias("prediction_leida"))
    return a.join(b, KEY).withColumn("igual", F.col("prediction") == F.col("prediction_leida"))


def offers_of(courses: DataFrame, pairs: DataFrame, rooms: DataFrame, slots=timetable.DEFAULT_SLOTS) -> DataFrame:
    """Q13 input: a row for each course and teacher at each hour and each room
    capacity of the course's pool, the features a score depends on. A pool has
    a few capacities, so this is far less than every room."""
    sizes = rooms.select("room_pool", "capacidad_base").distinct()
    slot = F.explode(timetable.slot_array(slots)).alias("_slot")
    both = courses.join(pairs, ["materia_nombre", "carrera_materia"]).join(sizes, "room_pool")
    return both.select("*", slot).select("*", F.col("_slot.str").alias("str"), F.col("_slot.inicio").alias("inicio")).drop("_slot")


def model_timetable(fitted, courses: DataFrame, pairs: DataFrame, rooms: DataFrame, quality: DataFrame | None = None,
                    blocks: DataFrame | None = None, attendance: DataFrame | None = None,
                    max_sections: int | None = timetable.MAX_SECTIONS) -> DataFrame:
    """Q13 and Q16: every offer scored once by the model, then the timetable in
    the order of those scores."""
    scored = model.score_candidates(fitted, model.serving_features(offers_of(courses, pairs, rooms), quality))
    offers = materialize(scored.select(
        "materia_nombre", "carrera_materia", "semestre_materia", "demanda_real", "profesor_id", "nombre_profesor",
        "room_pool", "capacidad_base", "str", "score_predicho"), "scored")
    plan, _ = timetable.rank_join_timetable(offers, rooms, ["room_pool", "capacidad_base", "str"],
                                            blocks, attendance, max_sections)
    return plan


#: DuckDB: split and fold by md5 of the key, as ``model.row_number_of`` has them.
SPLIT_SQL = f"""CASE WHEN CAST('0x' || substr(md5(concat_ws(':', CAST({KEY} AS VARCHAR), '{model.SEED}')), 1, 8) AS BIGINT) % 1000 < 800
     THEN 'train' ELSE 'test' END"""
FOLD_SQL = f"CAST(CAST('0x' || substr(md5(concat_ws(':', CAST({KEY} AS VARCHAR), 'fold')), 1, 8) AS BIGINT) % {model.FOLDS} AS INTEGER)"
