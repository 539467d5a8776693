"""Queries over predictions: scorecards, error segments, run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.functions.pricing import confidence_band
from parvis.operators import evaluation as ev
from parvis.operators.features import split_train_test

_CARD = """count(*) AS n, avg(abs(prix_predit - prix_reel)) AS "MAE", sqrt(avg((prix_predit - prix_reel) * (prix_predit - prix_reel))) AS "RMSE",
 1 - sum((prix_predit - prix_reel) * (prix_predit - prix_reel)) / (var_pop(prix_reel) * count(*)) AS "R2",
 avg(CASE WHEN prix_reel > 0 THEN abs((prix_predit - prix_reel) / prix_reel) END) * 100 AS "MAPE",
 avg(CASE WHEN abs(prix_predit - prix_reel) <= 1000 THEN 100.0e0 ELSE 0.0e0 END) AS pct_within_1000,
 avg(CASE WHEN abs(prix_predit - prix_reel) <= 2000 THEN 100.0e0 ELSE 0.0e0 END) AS pct_within_2000"""
_CARD_DIGITS = {"MAE RMSE MAPE pct_within_1000 pct_within_2000": 4, "R2": 7}


@query(views="predictions", sql=f"SELECT {_CARD} FROM predictions", digits=_CARD_DIGITS)
def scorecard(spark, d):
    return ev.scorecard(V.predictions(spark, d))


def _models(spark, d):
    """Three stand-in models on the test rows, stacked."""
    train, test = split_train_test(V.clean(spark, d))
    overall = train.agg(F.avg("prix_m2")).scalar()
    base = V.predictions(spark, d).select("id_mutation", "prix_reel", "prix_predit")
    flat = base.withColumn("prix_predit", overall)
    mixed = base.withColumn("prix_predit", F.col("prix_predit") * 0.5 + overall * 0.5)
    named = [base.withColumn("model", F.lit("district")), flat.withColumn("model", F.lit("flat")), mixed.withColumn("model", F.lit("mixed"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


_MODELS = """models AS (SELECT 'district' AS model, prix_reel, prix_predit FROM predictions
 UNION ALL SELECT 'flat', prix_reel, (SELECT avg(prix_m2) FROM train) FROM predictions
 UNION ALL SELECT 'mixed', prix_reel, prix_predit * 0.5e0 + (SELECT avg(prix_m2) FROM train) * 0.5e0 FROM predictions)"""
_RUNS = f"{_MODELS}, runs AS (SELECT model, {_CARD} FROM models GROUP BY model)"


def _runs(spark, d):
    return ev.scorecard(_models(spark, d), by=["model"])


@query(views="predictions", sql=f"WITH {_RUNS} SELECT * FROM runs", digits=_CARD_DIGITS)
def scorecard_by_model(spark, d):
    return _runs(spark, d)


@query(
    views="predictions",
    sql="""SELECT id_mutation, prix_reel, prix_predit, prix_predit - prix_reel AS erreur, abs(prix_predit - prix_reel) AS erreur_abs,
 (prix_predit - prix_reel) / prix_reel * 100 AS erreur_pct FROM predictions""",
    digits={"prix_predit erreur erreur_abs erreur_pct": 4},
)
def error_table(spark, d):
    return ev.with_errors(V.predictions(spark, d)).select(
        "id_mutation", "prix_reel", "prix_predit", "erreur", "erreur_abs", "erreur_pct"
    )


_SEGMENT = "avg(abs(prix_predit - prix_reel)) AS mae, avg(prix_predit - prix_reel) AS bias, count(*) AS n FROM predictions"
_RESIDUALS = f"""SELECT 'arrondissement' AS dimension, CAST(arrondissement AS STRING) AS bucket, {_SEGMENT} GROUP BY 2
UNION ALL SELECT 'surface', CASE WHEN surface_reelle_bati < 30 THEN '<30m2' WHEN surface_reelle_bati < 60 THEN '30-60m2'
 WHEN surface_reelle_bati < 100 THEN '60-100m2' ELSE '>100m2' END, {_SEGMENT} GROUP BY 2
UNION ALL SELECT 'price_tier', CASE WHEN prix_reel < 7000 THEN '<7k' WHEN prix_reel < 10000 THEN '7-10k'
 WHEN prix_reel < 14000 THEN '10-14k' ELSE '>14k' END, {_SEGMENT} GROUP BY 2"""


@query(views="predictions", sql=_RESIDUALS, digits={"mae bias": 4})
def residuals_by_segment(spark, d):
    return ev.residuals_by_segment(V.predictions(spark, d))


@query(
    views="predictions",
    sql=f"SELECT * FROM ({_RESIDUALS}) WHERE dimension = 'arrondissement' ORDER BY mae DESC, bucket LIMIT 5",
    digits={"mae bias": 4},
)
def worst_districts(spark, d):
    return ev.worst_districts(ev.residuals_by_segment(V.predictions(spark, d)))


@query(
    views="predictions",
    sql="""WITH b AS (SELECT CASE WHEN surface_reelle_bati <= 0 THEN NULL WHEN surface_reelle_bati <= 15 THEN '<15m2' WHEN surface_reelle_bati <= 30 THEN '15-30'
 WHEN surface_reelle_bati <= 50 THEN '30-50' WHEN surface_reelle_bati <= 80 THEN '50-80' WHEN surface_reelle_bati <= 120 THEN '80-120'
 WHEN surface_reelle_bati <= 200 THEN '120-200' WHEN surface_reelle_bati <= 1000 THEN '>200m2' END AS bucket, abs(prix_predit - prix_reel) AS e FROM predictions)
SELECT bucket, avg(e) AS mae_mean, count(*) AS n, quantile_cont(e, 0.5) AS mae_median FROM b WHERE bucket IS NOT NULL GROUP BY bucket""",
    digits={"mae_mean mae_median": 4},
)
def residuals_right_closed(spark, d):
    return ev.errors_by_area_bucket(ev.with_errors(V.predictions(spark, d)))


def _histogram_sql(source: str, x: str, bins: int, lo: str, hi: str, where: str = "TRUE") -> str:
    return f"""WITH v AS (SELECT {x} AS x FROM {source}), r AS (SELECT x FROM v WHERE {where}), e AS (SELECT {lo} AS lo, {hi} AS hi FROM r),
c AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INT), {bins - 1}) AS bin, count(*) AS n FROM r, e GROUP BY 1)
SELECT b.bin, lo + b.bin * ((hi - lo) / {bins}) AS bin_low, lo + (b.bin + 1) * ((hi - lo) / {bins}) AS bin_high, coalesce(n, 0) AS n
FROM (SELECT CAST(unnest(range({bins})) AS INT) AS bin) b CROSS JOIN e LEFT JOIN c USING (bin)"""


@query(views="clean", sql=_histogram_sql("clean", "prix_m2", 80, "min(x)", "max(x)"), digits={"bin_low bin_high": 4})
def price_histogram(spark, d):
    return ev.histogram(V.clean(spark, d), "prix_m2", 80)


@query(views="clean", sql=_histogram_sql("clean", "ln(prix_m2)", 80, "min(x)", "max(x)"), digits={"bin_low bin_high": 7})
def log_price_histogram(spark, d):
    return ev.histogram(V.clean(spark, d).withColumn("log_prix", F.log("prix_m2")), "log_prix", 80)


@query(
    views="clean",
    sql=_histogram_sql("clean", "prix_m2", 60, "any_value(2000.0e0)", "any_value(20000.0e0)", "x BETWEEN 2000 AND 20000"),
    digits={"bin_low bin_high": 4},
)
def price_histogram_fixed(spark, d):
    return ev.histogram(V.clean(spark, d), "prix_m2", 60, 2000, 20000)


@query(
    views="predictions",
    sql=_histogram_sql("predictions", "prix_predit - prix_reel", 60, "any_value(-8000.0e0)", "any_value(8000.0e0)", "x BETWEEN -8000 AND 8000"),
    digits={"bin_low bin_high": 4},
)
def error_histogram(spark, d):
    return ev.histogram(ev.with_errors(V.predictions(spark, d)), "erreur", 60, -8000, 8000)


@query(
    views="predictions",
    sql="""SELECT id_mutation, prix_predit - 1500.0e0 AS low_default, prix_predit + 1500.0e0 AS high_default,
 prix_predit - 1234.5e0 AS low_rmse, prix_predit + 1234.5e0 AS high_rmse FROM predictions""",
    digits={"low_default high_default low_rmse high_rmse": 4},
)
def confidence_bands(spark, d):
    rows = V.predictions(spark, d)
    (a, b), (c, e) = confidence_band("prix_predit"), confidence_band("prix_predit", 1234.5)
    return rows.select("id_mutation", a.alias("low_default"), b.alias("high_default"), c.alias("low_rmse"), e.alias("high_rmse"))


# -- run history ---------------------------------------------------------------------------


@query(views="predictions", sql=f'WITH {_RUNS} SELECT * FROM runs ORDER BY "MAE", model LIMIT 1', digits=_CARD_DIGITS)
def best_run(spark, d):
    return ev.best_run(_runs(spark, d))


@query(
    views="predictions",
    sql=f'WITH {_RUNS} SELECT * FROM runs ORDER BY CASE WHEN "MAE" < 1800 THEN -"R2" ELSE 100 - "R2" END, "MAE", model LIMIT 1',
    digits=_CARD_DIGITS,
)
def best_run_r2_first(spark, d):
    return ev.best_run(_runs(spark, d), prefer_r2=True)


@query(
    views="predictions",
    sql=f'WITH {_RUNS} SELECT model, "MAE", "MAE" - 1427.0e0 AS delta, "MAE" = min("MAE") OVER () AS is_best FROM runs',
    digits={"MAE delta": 4},
)
def improvement_table(spark, d):
    return ev.improvement_table(_runs(spark, d)).select("model", "MAE", "delta", "is_best")


@query(
    views="predictions",
    sql=f"""WITH {_RUNS}, h AS (SELECT model, "MAE" + 100 AS "MAE", CASE WHEN model = 'flat' THEN 1 ELSE 2 END AS position FROM runs WHERE model <> 'mixed')
SELECT model, "MAE", position FROM h WHERE model NOT IN ('flat', 'mixed')
UNION ALL SELECT model, "MAE", CASE WHEN model = 'flat' THEN 1 ELSE 3 END FROM runs WHERE model IN ('flat', 'mixed')""",
    digits={"MAE": 4},
)
def metrics_upsert(spark, d):
    runs = _runs(spark, d).select("model", "MAE")
    history = runs.where(F.col("model") != "mixed").select(
        "model", (F.col("MAE") + 100).alias("MAE"), F.when(F.col("model") == "flat", 1).otherwise(2).alias("position")
    )
    return ev.upsert_metrics(history, runs.where(F.col("model").isin("flat", "mixed")))
