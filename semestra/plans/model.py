"""The section-score model (M1-M8, Q13): Spark ML pipeline, trained and served
with the same fitted indexer (D9)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semestra.functions.numeric import cap_ratio, round_half_even, round_half_up
from semestra.functions.text import first_start_hour
from semestra.session import drop_written, materialize

LABEL = "Y_TOO_Historica"
# Model features in vector order and their display labels.
FEATURES = ["X_Cp_Profesor", "X_Factor_Demanda_Normalizado", "X_capacidad_salon",
            "X_Hora_Inicio", "X_Semestre_Num", "X_Materia_Index"]
FEATURE_LABELS = {
    "X_Cp_Profesor": "Ranking Profesor",
    "X_Factor_Demanda_Normalizado": "Demanda Estudiantil",
    "X_capacidad_salon": "Capacidad Salon",
    "X_Hora_Inicio": "Horario Preferido",
    "X_Semestre_Num": "Semestre",
    "X_Materia_Index": "Materia (Dificultad)",
}
ORDERED = FEATURES[:-1]  # all but the course index, which is a category
BINS = [f"_bin_{f}" for f in ORDERED]
_TASK_CELLS = 20_000  # cells for which another task is worth its start
# Grid search space and training settings.
GRID_DEPTH, GRID_ITER, GRID_STEP = [3, 5], [20, 60], [0.1]
FOLDS, SEED, MIN_BINS = 3, 42, 32
DEFAULT_TEACHER_QUALITY = 85.0  # serving default when a teacher has no history


def safe_cast_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every listed column must exist; each is cast to double."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.select(*[F.col(c).cast("string").try_cast("double").alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def training_frame(model_ready: DataFrame) -> DataFrame:
    """Features of ``model_ready``: P8 casts, P9 first start hour (default 7),
    P10 semester default 1.0."""
    df = safe_cast_double(model_ready, [LABEL, "X_Cp_Profesor",
                                        "X_Factor_Demanda_Normalizado", "X_capacidad_salon"])
    return (df.withColumn("X_Hora_Inicio", first_start_hour("horario_visual").cast("double"))
            .withColumn("X_Semestre_Num",
                        F.coalesce(F.col("semestre_visual").cast("string").try_cast("double"),
                                   F.lit(1.0))))


def row_number_of(key: str, salt: object) -> Column:
    """A number below 2**32 by md5 of a row key: the same in every engine, for
    every partitioning and after a lost executor."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, train_fraction: float = 0.8,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M3: train/test split by a hash of the row key."""
    bucket = row_number_of(key, seed) % 1000
    cut = int(round(train_fraction * 1000))
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def with_fold(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """``df`` with ``fold``: 0 to folds - 1 by a hash of the row key."""
    return df.withColumn("fold", (row_number_of(key, "fold") % folds).cast("int"))


def feature_stages(train: DataFrame, course_col: str = "materia_nombre_visual") -> PipelineModel:
    """M1 and M2 fitted: the course index by frequency (ties by name, unknown
    courses and nulls after the last) and the vector of the six features; rows
    with a null feature are skipped."""
    indexer = StringIndexer(inputCol=course_col, outputCol="X_Materia_Index", handleInvalid="keep")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[indexer, assembler]).fit(train)


def _bins(stages: PipelineModel) -> int:
    """A categorical feature needs a bin for each of its values, and one for others."""
    return max(MIN_BINS, len(stages.stages[0].labels) + 2)


def _booster(bins: int, depth: int, iters: int, step: float) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=LABEL, seed=SEED, maxBins=bins,
                        maxDepth=depth, maxIter=iters, stepSize=step)


# A tree sees a row's ordered features only by their bins, and the squared loss of
# rows with the same bins and course only by their number and mean label (their own
# spread is the same in every tree). So bins are fixed first, by the boosting's own
# rule over all rows, and it runs over cells: one row with a weight for all rows of
# the same bins and course. A fit then costs what its cells cost: at most the product
# of the bins, never more than the rows.


class _Splits:
    """Split points of one feature, by the rule of Spark's trees: between all its
    values if there are at most ``bins``, else where about an even share of the
    rows has gone by. Values come in ascending order with their numbers of rows."""

    def __init__(self, rows: int, bins: int):
        self.most = min(bins, rows) - 1
        self.stride = self.target = rows / max(1, self.most + 1)
        self.seen = self.values = 0
        self.last = 0.0
        self.every: list[float] = []
        self.even: list[float] = []

    def add(self, value: float, n: int) -> None:
        if self.values:
            middle = (self.last + value) / 2
            if self.values <= self.most:
                self.every.append(middle)
            if abs(self.seen - self.target) < abs(self.seen + n - self.target):
                self.even.append(middle)
                self.target += self.stride
        self.last, self.seen, self.values = value, self.seen + n, self.values + 1

    def points(self) -> list[float]:
        found = self.every if self.values - 1 <= self.most else self.even
        return sorted({p for p in found if math.isfinite(p)})


def split_points(table: DataFrame, folds: int, bins: int) -> list[list[list[float]]]:
    """For every fold and ordered feature the split points of the rows of all other
    folds. Values are counted by Spark; the driver walks them in order and holds a
    part of them at a time."""
    outside = [F.count_if(F.col("fold") != k).alias(f"n{k}") for k in range(folds)]
    rows = table.agg(*outside).first()
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
                               for i, c in enumerate(ORDERED)]))
    counted = table.select("fold", each.alias("x")).groupBy("x.f", "x.v").agg(*outside).orderBy("f", "v")
    found = [[_Splits(rows[k], bins) for _ in ORDERED] for k in range(folds)]
    for f, value, *counts in counted.toLocalIterator():
        for k, n in enumerate(counts):
            if n:
                found[k][f].add(value, n)
    return [[s.points() for s in of_fold] for of_fold in found]


def _bucketizer(points: list[list[list[float]]], names: Sequence[str], invalid: str) -> Bucketizer:
    """The bins of every ordered feature, for each given set of split points. A
    value that equals a point lies below it, as in a tree; a feature without
    points is not split, wherever its two bins meet."""
    edges = [[-math.inf, *(math.nextafter(p, math.inf) for p in of or [0.0]), math.inf] for each in points for of in each]
    return Bucketizer(inputCols=ORDERED * len(points), outputCols=list(names), splitsArray=edges, handleInvalid=invalid)


def cells(table: DataFrame, points: list[list[list[float]]]) -> DataFrame:
    """``table`` (ORDERED, course index, label, fold) as cells of every set of split
    points: fold k, whether its rows are held out (those of the fold itself), the
    bins, number of rows, mean label and the sum of squares about it."""
    names = [[f"_b{k}_{i}" for i in range(len(ORDERED))] for k in range(len(points))]
    binned = _bucketizer(points, sum(names, []), "keep").transform(table)
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("fold") == k).alias("held"),
                                        *[F.col(c).cast("int").alias(b) for c, b in zip(names[k], BINS)])
                               for k in range(len(points))]))
    label = F.coalesce(F.col(LABEL).cast("double"), F.lit(math.nan))  # a fit refuses both
    rows = binned.select("X_Materia_Index", label.alias("y"), sets.alias("s")).select("X_Materia_Index", "y", "s.*")
    n = F.count(F.lit(1)).cast("double")
    return (rows.groupBy("k", "held", *BINS, "X_Materia_Index")
            .agg(n.alias("n"), F.avg("y").alias(LABEL), (F.var_pop("y") * n).alias("within"))
            .withMetadata("X_Materia_Index", table.schema["X_Materia_Index"].metadata))


def _cell_assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[*BINS, "X_Materia_Index"], outputCol="features", handleInvalid="skip")


def _cell_fit(found: DataFrame, courses: int, bins: int, depth: int, iters: int, step: float) -> GBTRegressionModel:
    """A fit of weighted cells. All of them are looked at for their bins, whatever
    their number. Spark refuses fewer examples than there are courses; a table
    with enough rows but fewer cells has each in several equal parts."""
    size, rows = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    parts = -(-courses // size) if 0 < size < courses <= rows else 1
    if parts > 1:
        found = found.withColumn("n", F.col("n") / parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    tasks = max(1, min(found.sparkSession.sparkContext.defaultParallelism, size // _TASK_CELLS))
    found = found.repartition(tasks, *BINS, "X_Materia_Index").sortWithinPartitions(*BINS, "X_Materia_Index")
    booster = _booster(max(bins, math.isqrt(size * parts) + 1), depth, iters, step).setWeightCol("n")
    return booster.fit(_cell_assembler().transform(found))


def grid_search(train: DataFrame, key: str = "grupo_id", folds: int = FOLDS, depth: Sequence[int] = GRID_DEPTH,
                iters: Sequence[int] = GRID_ITER, steps: Sequence[float] = GRID_STEP,
                parallelism: int = 4) -> list[dict]:
    """M4: every grid point's RMSE on each fold (by row hash) and their mean,
    best first.

    Features are worked out once and written; every fold's rows become cells in
    one pass. Boosting adds a tree an iteration, so a fit of the most iterations
    holds all shorter ones: one fit for each depth, step and fold, scored after
    each number of iterations on the cells held out, with the spread in them."""
    spark = train.sparkSession
    written: list[str] = []
    stages = feature_stages(train)
    table = materialize(with_fold(stages.transform(train), key, folds)
                        .select(*FEATURES, LABEL, "fold"), "grid", written)
    bins, longest = _bins(stages), max(iters)
    courses = len(stages.stages[0].labels) + 1
    found_cells = materialize(cells(table, split_points(table, folds, bins)), "cells", written)
    spread = {r["k"]: r["within"] / r["n"] for r in found_cells.where("held").groupBy("k").agg(
        F.sum("within").alias("within"), F.sum("n").alias("n")).collect()}

    def fit(point: tuple[int, float, int]) -> list[float]:
        d, step, fold = point
        of_fold = found_cells.where(F.col("k") == fold)
        fitted = _cell_fit(of_fold.where("not held"), courses, bins, d, longest, step)
        losses = fitted.evaluateEachIteration(_cell_assembler().transform(of_fold.where("held")), "squared")
        return [math.sqrt(losses[n - 1] + spread.get(fold, 0.0)) for n in iters]

    points = list(product(depth, steps, range(folds)))
    pool = ThreadPool(min(parallelism, len(points)))
    try:
        found = dict(zip(points, pool.map(fit, points)))
    finally:
        pool.close()
    drop_written(spark, written)
    out = []
    for d, step in product(depth, steps):
        for k, n in enumerate(iters):
            rmse = [found[d, step, f][k] for f in range(folds)]
            out.append({"maxDepth": d, "maxIter": n, "stepSize": step, "folds": rmse, "rmse": sum(rmse) / folds})
    return sorted(out, key=lambda p: (p["rmse"], p["maxDepth"], p["maxIter"]))


def train_model(train: DataFrame, grid: bool = True, folds: int = FOLDS,
                depth: Sequence[int] = GRID_DEPTH, iters: Sequence[int] = GRID_ITER,
                steps: Sequence[float] = GRID_STEP, parallelism: int = 4, key: str = "grupo_id",
                by_rows: bool = False) -> PipelineModel:
    """M4 + M5: grid search with k-fold RMSE, then one fit of the best
    parameters on every training row. Returns one PipelineModel (indexer, bins,
    assembler, GBT) so serving reuses the fitted course index and bins. With
    ``by_rows`` the last fit runs on the rows themselves, and there are no bins."""
    best = {"maxDepth": depth[0], "maxIter": iters[0], "stepSize": steps[0]}
    if grid and (len(depth) * len(iters) * len(steps) > 1):
        best = grid_search(train, key, folds, depth, iters, steps, parallelism)[0]
    stages = feature_stages(train)
    indexer, bins = stages.stages[0], _bins(stages)
    if by_rows:
        fitted = _booster(bins, best["maxDepth"], best["maxIter"], best["stepSize"]).fit(stages.transform(train))
        return PipelineModel(stages=[*stages.stages, fitted])
    written: list[str] = []
    table = stages.transform(train).select(*FEATURES, LABEL, F.lit(1).alias("fold"))  # none is held out of fold 0
    points = split_points(table, 1, bins)
    found = materialize(cells(table, points), "cells", written)
    fitted = _cell_fit(found, len(indexer.labels) + 1, bins, best["maxDepth"], best["maxIter"], best["stepSize"])
    drop_written(train.sparkSession, written)
    return PipelineModel(stages=[indexer, _bucketizer(points, BINS, "skip"), _cell_assembler(), fitted])


def rmse_evaluator() -> RegressionEvaluator:
    """M8."""
    return RegressionEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="rmse")


def evaluate(model: PipelineModel, test: DataFrame) -> float:
    """M8 on held-out rows."""
    return rmse_evaluator().evaluate(model.transform(test))


def save_model(model: PipelineModel, path: str) -> None:
    """S11."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S11."""
    return PipelineModel.load(path)


def serving_features(candidates: DataFrame, quality: DataFrame | None = None,
                     demand_col: str = "demanda_real") -> DataFrame:
    """Q13 inputs: candidate sections -> model features. Teacher quality comes
    from Q5 when given (D8), else the fixed default; demand uses F10 (D7)."""
    c = candidates
    if quality is not None:
        c = c.join(quality.select("profesor_id", F.col("Calidad_Profesor").alias("_q")),
                   "profesor_id", "left")
    else:
        c = c.withColumn("_q", F.lit(None).cast("double"))
    return (c.withColumn("X_Cp_Profesor", F.coalesce("_q", F.lit(DEFAULT_TEACHER_QUALITY)))
            .drop("_q")
            .withColumn("X_Factor_Demanda_Normalizado", cap_ratio(demand_col))
            .withColumn("X_capacidad_salon", F.col("capacidad_base").cast("double"))
            .withColumn("X_Hora_Inicio", F.col("inicio").cast("double"))
            .withColumn("X_Semestre_Num", F.col("semestre_materia").cast("double"))
            .withColumn("materia_nombre_visual", F.col("materia_nombre")))


def score_candidates(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M6: predict; score = prediction x 100 with one decimal."""
    out = model.transform(features)
    return (out.withColumn("score_predicho", round_half_up(F.col("prediction") * 100, 1))
            .drop("features", "X_Materia_Index", *BINS))


def feature_importance(spark: SparkSession, model: PipelineModel,
                       min_importance: float = 0.001) -> DataFrame:
    """M7: the GBT's feature importances above the threshold, labelled, in
    percent with one decimal, largest first (a six-row table)."""
    gbt = model.stages[-1]
    values = gbt.featureImportances.toArray().tolist()
    rows = [(FEATURE_LABELS.get(n, n), float(v)) for n, v in zip(FEATURES, values)]
    df = spark.createDataFrame(rows, "feature string, value double")
    return (df.filter(F.col("value") > min_importance)
            .select("feature", round_half_even(F.col("value") * 100, 1).alias("importancia"))
            .orderBy(F.desc("importancia"), "feature"))


_BUCKET_ROWS = 1000  # rows among which a feature is shuffled


def permutation_importance(model: PipelineModel, rows: DataFrame, key: str = "grupo_id") -> DataFrame:
    """M7 measured: for each feature its label, the RMSE on ``rows`` with the
    feature shuffled, how much that is over the RMSE as it is, and the share of
    the whole rise in percent (0 where shuffling does not hurt).

    A feature is shuffled by handing each row the value of the next one in the
    order of a hash of the key, in a circle within buckets of about
    _BUCKET_ROWS rows; all features are rescored in one job."""
    inputs = ["materia_nombre_visual" if f == "X_Materia_Index" else f for f in FEATURES]
    buckets = max(1, rows.count() // _BUCKET_ROWS)
    order = Window.partitionBy("_b").orderBy("_h", key)
    values = F.struct(*inputs)
    paired = (rows.select(key, LABEL, *inputs)
              .withColumns({"_b": row_number_of(key, "bucket") % buckets, "_h": row_number_of(key, "order")})
              .withColumn("_own", values)
              .withColumn("_next", F.coalesce(F.lead("_own").over(order), F.first("_own").over(order))))
    variants = [F.struct(F.lit(-1).alias("n"), *[F.col(f"_own.{c}").alias(c) for c in inputs])]
    for n, f in enumerate(inputs):
        variants.append(F.struct(F.lit(n).alias("n"), *[
            F.col(f"_next.{c}" if c == f else f"_own.{c}").alias(c) for c in inputs]))
    scored = model.transform(paired.select(LABEL, F.explode(F.array(*variants)).alias("v")).select(LABEL, "v.*"))
    error = F.sqrt(F.avg((F.col(LABEL) - F.col("prediction")) ** 2))
    per = scored.groupBy("n").agg(error.alias("rmse"))
    names = F.element_at(F.array(*[F.lit(FEATURE_LABELS.get(f, f)) for f in FEATURES]), F.col("n") + 1)
    seven = Window.partitionBy()  # of the seven rows
    rise = (per.withColumn("base", F.max(F.when(F.col("n") == -1, F.col("rmse"))).over(seven)).where("n >= 0")
            .select(names.alias("feature"), "rmse", (F.col("rmse") - F.col("base")).alias("rise")))
    lifted = F.greatest("rise", F.lit(0.0))
    total = F.sum(lifted).over(seven)
    return rise.select("feature", "rmse", "rise", F.when(total > 0, round_half_even(lifted / total * 100, 1)).otherwise(F.lit(0.0)).alias("importancia"))
