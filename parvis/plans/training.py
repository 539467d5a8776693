"""Fitting, comparing, saving and applying price models with Spark ML."""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from parvis import constants as C
from parvis.functions import pricing
from parvis.operators.boosting import boost
from parvis.operators.encodings import Encodings
from parvis.operators.evaluation import scorecard
from parvis.operators.features import featurise, validation_flag
from parvis.sources.publish import current, new_run, publish

LABEL, VALID, WEIGHT = "_label", "_valid", "_weight"


@dataclass
class PriceModel:
    """A fitted pipeline with what is needed to apply it to new rows."""

    pipeline: PipelineModel
    columns: list[str]
    log_target: bool = True
    name: str = "model"
    rmse: float | None = None
    encodings: Encodings | None = None
    defaults: dict[str, float] = field(default_factory=dict)  # medians of the training rows

    def predict(self, features: DataFrame, output: str = "prix_m2_predit") -> DataFrame:
        """Add the predicted €/m² to rows that carry the feature columns."""
        scored = self.pipeline.transform(features)
        raw = F.col("prediction")
        made = [s for s in scored.columns if s not in features.columns]
        return scored.withColumn(output, F.expm1(raw) if self.log_target else raw).drop(*[m for m in made if m != output])

    def matrix(self, rows: DataFrame) -> DataFrame:
        """Lookups and features of raw rows, which are kept as they are in ``_row``. A
        point that is missing counts as the centre, any other missing feature as its
        median in training, so no row is lost."""
        featured = featurise(rows.select("*", F.struct("*").alias("_row")), self.encodings)
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.defaults.get(c, 0.0))).alias(c) for c in self.columns]
        return featured.select("_row", *filled)

    def score(self, rows: DataFrame, output: str = "prix_m2_predit") -> DataFrame:
        """Lookups, features, model and inverse target for raw rows, see ``matrix``."""
        return self.predict(self.matrix(rows), output).select("_row.*", output)


@dataclass
class Recipe:
    """What to fit: a name, pipeline stages and the treatment of the target."""

    name: str
    stages: list
    log_target: bool = True
    weighted: bool = False
    early_stop: bool = False
    huber: bool = False
    columns: list[str] = field(default_factory=lambda: list(C.FEATURES))


def _assembler(columns, output="features"):
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def linear(columns=None, name="LinearRegression", log_target=False, loss="squaredError", weighted=False, l2=0.0) -> Recipe:
    columns = list(columns or C.FEATURES)
    options = {"weightCol": WEIGHT} if weighted else {}
    if loss == "huber":
        options |= {"loss": "huber", "epsilon": 1.35}
    stages = [
        _assembler(columns, "raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LinearRegression(labelCol=LABEL, maxIter=60, regParam=l2, **options),
    ]
    return Recipe(name, stages, log_target, weighted, columns=columns)


def boosted_trees(columns=None, name="GBT", loss="absolute", iterations=None, depth=5, step=0.1,
                  log_target=True, weighted=False, seed=42, min_rows=20) -> Recipe:
    """Boosted trees; ``loss`` is absolute, squared or huber. Without ``iterations`` the
    validation rows end the fit (``best_prefix``), with it there are just so many rounds."""
    columns, huber = list(columns or C.FEATURES), loss == "huber"
    options = {"weightCol": WEIGHT} if weighted or huber else {}
    trees = GBTRegressor(
        labelCol=LABEL, lossType="squared" if huber else loss, maxIter=iterations or 1, maxDepth=depth, stepSize=step, seed=seed,
        minInstancesPerNode=min_rows, subsamplingRate=0.8, checkpointInterval=10, **options,
    )
    return Recipe(name, [_assembler(columns), trees], log_target, weighted, iterations is None, huber, columns)


def forest(columns=None, name="RandomForest", trees=20, depth=8, log_target=True, seed=42) -> Recipe:
    columns = list(columns or C.FEATURES)
    model = RandomForestRegressor(labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=20)
    return Recipe(name, [_assembler(columns), model], log_target, columns=columns)


# columns of the additive model: smooth, factor, linear
SMOOTH = ["surface_reelle_bati", "nombre_pieces_principales", "nombre_lots"]
FACTORS = ["arrondissement", "mois"]
STRAIGHT = ["longitude", "latitude"]


def additive(train: DataFrame, knots: int = 5, name="GAM") -> tuple[Recipe, dict]:
    """Piecewise-linear smooths, one-hot factors and straight terms, ridge-fitted.

    Knots are approximate quantiles: their place does not change the result's
    meaning, only where the curve may bend.
    """
    probs = [i / (knots + 1) for i in range(1, knots + 1)]
    found = train.agg(*[F.percentile_approx(c, probs, 1000).alias(c) for c in SMOOTH]).first()
    return Recipe(name, [], False, columns=list(C.BASE_FEATURES)), {c: sorted(set(found[c])) for c in SMOOTH}


def hinge_columns(df: DataFrame, knots: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """``max(x - knot, 0)`` columns: the basis of the piecewise-linear smooths."""
    hinges = {f"{c}_k{i}": F.greatest(F.col(c) - k, F.lit(0.0)) for c, ks in knots.items() for i, k in enumerate(ks)}
    return df.withColumns(hinges), list(hinges)


def fit_additive(train: DataFrame, test: DataFrame, knots: int = 5) -> tuple[PipelineModel, DataFrame]:
    recipe, places = additive(train, knots)
    wide_train, names = hinge_columns(train, places)
    wide_test, _ = hinge_columns(test, places)
    stages = [
        OneHotEncoder(inputCols=FACTORS, outputCols=[f"{c}_1h" for c in FACTORS], handleInvalid="keep"),
        _assembler([*SMOOTH, *names, *STRAIGHT, *[f"{c}_1h" for c in FACTORS]]),
        LinearRegression(labelCol=C.TARGET, regParam=0.1, elasticNetParam=0.0, maxIter=60),
    ]
    model = Pipeline(stages=stages).fit(wide_train)
    scored = model.transform(wide_test).withColumnRenamed("prediction", "prix_predit")
    return model, scored.select(F.lit(recipe.name).alias("model"), "id_mutation", F.col(C.TARGET).alias("prix_reel"), "prix_predit")


def prepared(train: DataFrame, recipe: Recipe, key: str = "id_mutation") -> DataFrame:
    """Target, validation marks and weights, each computed on the row itself. A row without key is no validation row."""
    out = train.withColumn(LABEL, F.log1p(C.TARGET) if recipe.log_target else F.col(C.TARGET))
    if recipe.early_stop:
        out = out.withColumn(VALID, F.coalesce(validation_flag(train, key=key), F.lit(False)))
    if recipe.weighted or recipe.huber:
        out = out.withColumn(WEIGHT, pricing.recency_weight("annee") if recipe.weighted else F.lit(1.0))
    return out


def cut_to(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` trees; Spark has no such call, but its constructor takes trees and weights."""
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    kept = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    made = GBTRegressionModel(java.copyValues(kept, java.extractParamMap()))
    made._resetUid(java.uid())
    return made


def best_prefix(learn: DataFrame, valid: DataFrame, trees: GBTRegressor) -> GBTRegressionModel:
    """Boost until the error of the validation rows has not fallen for the patience, and keep the rounds up to its least.

    Patience and the limit of rounds are counted in rounds times step, so a small step
    gets more rounds. A fit goes on to twice the rounds while its best round is too near
    its end. Without validation rows all rounds before the first doubling stay.
    """
    step = trees.getStepSize()
    patience, limit = math.ceil(C.PATIENCE_TRAVEL / step), math.ceil(C.BOOST_TRAVEL / step)
    rounds = min(math.ceil(4 / 3 * patience), limit)
    if (model := boost(learn, valid, trees, rounds, patience, limit)) is not None:
        return model
    blind = valid.isEmpty()
    while True:  # many rows: Spark's own trees, a fit is repeated with twice the rounds; the seed makes the first ones the same
        model = trees.copy({trees.maxIter: rounds}).fit(learn)
        if blind:
            return model
        errors = model.evaluateEachIteration(valid, trees.getLossType())
        best = min(range(len(errors)), key=errors.__getitem__) + 1
        if best + patience <= rounds or rounds == limit:
            return cut_to(model, best)
        rounds = min(2 * rounds, limit)


def huber_loss(residual: Column, delta: float) -> Column:
    size = F.abs(residual)
    return F.when(size <= delta, residual * residual / 2).otherwise(delta * (size - delta / 2))


def fit_huber(learn: DataFrame, valid: DataFrame, trees: GBTRegressor) -> tuple[GBTRegressionModel, list[float]]:
    """Boosted trees for Huber's loss by iteratively reweighted squared fits, with the mean loss after each fit.

    Delta is the ``C.HUBER_QUANTILE`` of the first fit's absolute residuals. Rows beyond
    it are weighted with delta / |residual| in the next fit, which is kept if the loss
    falls; the fits end when it falls by less than a hundredth.
    """
    residual = F.col(LABEL) - F.col("prediction")
    model, delta, losses = best_prefix(learn, valid, trees), None, []
    while True:
        scored = model.transform(learn)
        if delta is None:
            delta = scored.agg(F.percentile_approx(F.abs(residual), C.HUBER_QUANTILE, 1000)).first()[0]
            if not delta:
                return model, losses
            kept = model
        losses.append(scored.agg(F.avg(huber_loss(residual, delta))).first()[0])
        if len(losses) > 1 and losses[-1] >= losses[-2]:
            return kept, losses[:-1]
        kept = model
        if len(losses) > 1 and losses[-1] > 0.99 * losses[-2]:
            return kept, losses
        weight = F.col(WEIGHT) * F.least(F.lit(1.0), F.try_divide(F.lit(delta), F.abs(residual)))
        again = scored.withColumn(WEIGHT, weight).drop("prediction")
        model = best_prefix(again, valid, trees)


def _fit_trees(rows: DataFrame, recipe: Recipe) -> PipelineModel:
    *before, trees = recipe.stages
    front = Pipeline(stages=before).fit(rows)
    ready = front.transform(rows).select("features", LABEL, VALID, *([WEIGHT] if recipe.weighted or recipe.huber else []))
    learn, valid = ready.where(~F.col(VALID)), ready.where(VALID)
    model = fit_huber(learn, valid, trees)[0] if recipe.huber else best_prefix(learn, valid, trees)
    return PipelineModel([*front.stages, model])


def fit(
    train: DataFrame, recipe: Recipe, enc: Encodings | None = None, key: str = "id_mutation", held_out: DataFrame | None = None,
) -> PriceModel:
    """A fitted model. With ``enc`` it can score raw rows and keeps the training medians
    for missing features; with ``held_out`` rows it carries their error for price bands."""
    rows = prepared(train, recipe, key)
    fitted = _fit_trees(rows, recipe) if recipe.early_stop else Pipeline(stages=recipe.stages).fit(rows)
    model = PriceModel(fitted, recipe.columns, recipe.log_target, recipe.name, encodings=enc)
    if enc is not None:
        medians = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in recipe.columns]).first()
        model.defaults = {c: v for c, v in medians.asDict().items() if v is not None}
    if held_out is not None:
        error = F.pow(F.col("prix_predit") - F.col("prix_reel"), 2)
        model.rmse = predictions(model, held_out, key).agg(F.sqrt(F.avg(error))).first()[0]
    return model


def predictions(model: PriceModel, test: DataFrame, key: str = "id_mutation") -> DataFrame:
    scored = model.predict(test, "prix_predit")
    return scored.select(F.lit(model.name).alias("model"), key, F.col(C.TARGET).alias("prix_reel"), "prix_predit")


def ensemble_mean(stacked: DataFrame, name: str = "Ensemble", key: str = "id_mutation") -> DataFrame:
    """Average of the stacked predictions of several models per row."""
    return stacked.groupBy(key).agg(
        F.lit(name).alias("model"), F.first("prix_reel").alias("prix_reel"), F.avg("prix_predit").alias("prix_predit")
    ).select("model", key, "prix_reel", "prix_predit")


def tournament(train: DataFrame, test: DataFrame, recipes: list[Recipe], ensemble: bool = True) -> tuple[dict[str, PriceModel], DataFrame]:
    """Fit each recipe on the same split; one scorecard pass over all predictions."""
    models = {r.name: fit(train, r) for r in recipes}
    stacked = None
    for model in models.values():
        scored = predictions(model, test)
        stacked = scored if stacked is None else stacked.unionByName(scored)
    if ensemble and len(models) > 1:
        stacked = stacked.unionByName(ensemble_mean(stacked))
    return models, scorecard(stacked, by=["model"])


def random_settings(trials: int, seed: int = 42) -> list[dict]:
    """Seeded random settings of boosted trees."""
    draw = random.Random(seed)
    return [
        {"step": round(10 ** draw.uniform(-1.5, -0.5), 4), "depth": draw.randint(3, 6), "min_rows": draw.randint(5, 50)} for _ in range(trials)
    ]


_TRIALS = "rung int, trial int, share double, setting string, MAE double"


def _tried(spark: SparkSession, state: str | None) -> dict[tuple[int, str], float]:
    """Results of earlier trials by rung and setting, of trials that were written whole."""
    if state is None:
        return {}
    try:
        rows = spark.read.schema(_TRIALS).parquet(f"{state}/*").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {(r.rung, r.setting): r.MAE for r in rows}


def successive_halving(
    train: DataFrame, settings: list[dict] | None = None, key: str = "id_mutation", state: str | None = None, together: int = 4,
    recipe_of=boosted_trees,
) -> tuple[dict, list[dict]]:
    """The best of ``settings`` (default: ``C.SEARCH_TRIALS`` random ones), raced on growing shares of the rows.

    Every rung fits its settings on a share of the rows (by a hash of the key, so each
    share holds the one before), judges them by the mean absolute error on all held-out
    rows, drops the worse half and doubles the share; the last rung has all rows and at
    most two settings. A rung costs about as much as the last one, however many settings
    there are. The fits of a rung run ``together`` at a time, each in its own scheduler
    pool. With ``state`` (a folder of Parquet tables) each result is written as it comes, and
    a search that was cut short goes on where it stopped. Returns the best setting and all
    trials as (rung, trial, share, setting, MAE).
    """
    spark = train.sparkSession
    settings = settings or random_settings(C.SEARCH_TRIALS)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    fold = F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(100))
    learn, judge = train.where(F.coalesce(fold >= 15, F.lit(True))), train.where(fold < 15)
    rungs = max(1, math.ceil(math.log2(len(settings))))
    known, log, alive = _tried(spark, state), [], list(enumerate(settings))

    def run(rung: int, trial: int, setting: dict, share: float, rows: DataFrame) -> dict:
        named = json.dumps(setting, sort_keys=True)
        if (rung, named) not in known:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{trial}")
            model = fit(rows, recipe_of(name=f"trial{trial}", **setting), key=key)
            error = predictions(model, judge, key).agg(F.avg(F.abs(F.col("prix_predit") - F.col("prix_reel")))).first()[0]
            if state is not None:
                row = spark.createDataFrame([(rung, trial, share, named, error)], _TRIALS)
                row.coalesce(1).write.mode("overwrite").parquet(f"{state}/{rung}-{trial}")  # a folder each: writers do not meet
            known[rung, named] = error
        return {"rung": rung, "trial": trial, "share": share, "setting": setting, "MAE": known[rung, named]}

    for rung in range(rungs):
        share = 2.0 ** (rung + 1 - rungs)
        rows = learn.where(F.coalesce(place, F.lit(0)) < int(share * (1 << 20)))
        with ThreadPoolExecutor(together) as pool:
            jobs = [pool.submit(inheritable_thread_target(spark)(run), rung, trial, setting, share, rows) for trial, setting in alive]
            done = [j.result() for j in jobs]
        log += done
        done.sort(key=lambda t: (math.inf if t["MAE"] is None or math.isnan(t["MAE"]) else t["MAE"], t["trial"]))
        alive = [(t["trial"], t["setting"]) for t in done[: math.ceil(len(done) / 2)]]
    return done[0]["setting"], log


# -- reading a fitted model ---------------------------------------------------------------------


def _last(model: PriceModel):
    return model.pipeline.stages[-1]


def feature_importance(spark: SparkSession, model: PriceModel, top: int = 15) -> DataFrame:
    """Shares of the strongest features; one row per feature of the model."""
    last = _last(model)
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(sum(values)) or 1.0
    rows = [(c, float(v) / total) for c, v in zip(model.columns, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


# -- artifact ---------------------------------------------------------------------------------------


_TABLES = ["district", "street", "grid", "street_recent", "district_recent"]
_META = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("columns", T.StringType()),
    T.StructField("log_target", T.BooleanType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("global_mean", T.DoubleType()), T.StructField("defaults", T.StringType()),
    T.StructField("tables", T.StringType()),
])


def save_model(model: PriceModel, path: str, spark: SparkSession) -> None:
    """Write a model as a published run: pipeline, lookup tables and one metadata row.

    The model saved before is the valid one until all of the new one is written.
    """
    run, enc = new_run(path), model.encodings
    model.pipeline.write().save(f"{run}/pipeline")
    names = [n for n in _TABLES if enc is not None and getattr(enc, n) is not None]
    for name in names:
        getattr(enc, name).write.parquet(f"{run}/{name}")
    mean = None
    if enc is not None:
        mean = float(spark.range(1).select(enc.mean.alias("m")).first()["m"])
    meta = [(model.name, json.dumps(model.columns), model.log_target, model.rmse, mean, json.dumps(model.defaults), json.dumps(names))]
    spark.createDataFrame(meta, _META).coalesce(1).write.parquet(f"{run}/metadata")
    publish(spark, path, run)


def load_model(spark: SparkSession, path: str) -> PriceModel:
    """The model published in ``path``."""
    run = current(spark, path)
    if run is None:
        raise FileNotFoundError(f"no model in {path}")
    meta = spark.read.schema(_META).parquet(f"{run}/metadata").first()
    named = json.loads(meta["tables"])
    tables = {name: spark.read.parquet(f"{run}/{name}") if name in named else None for name in _TABLES}
    mean = meta["global_mean"]
    enc = None if mean is None else Encodings(overall=mean, **tables)
    return PriceModel(
        PipelineModel.load(f"{run}/pipeline"), json.loads(meta["columns"]), meta["log_target"],
        meta["name"], meta["rmse"], enc, json.loads(meta["defaults"]),
    )
