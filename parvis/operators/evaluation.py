"""Scorecards, error segments, histograms and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.numbers import as_col
from parvis.operators.quantiles import group_quantiles


def with_errors(df: DataFrame, actual: str = "prix_reel", predicted: str = "prix_predit") -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return df.withColumns(
        {"erreur": error, "erreur_abs": F.abs(error), "erreur_pct": F.try_divide(error, F.col(actual)) * 100}
    )


def scorecard(df: DataFrame, actual="prix_reel", predicted="prix_predit", by: list[str] = (), tolerances=(1000, 2000)) -> DataFrame:
    """MAE, RMSE, R², MAPE and shares within tolerance; one pass for any number of models.

    The total sum of squares is ``n`` times the population variance, which Spark
    merges from centred partial moments, so one pass is stable.
    """
    y, p = F.col(actual), F.col(predicted)
    error = p - y
    within = [
        (F.avg((F.abs(error) <= t).cast("double")) * 100).alias(f"pct_within_{t}") for t in tolerances
    ]
    return (
        df.where(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("MAE"),
            F.sqrt(F.avg(error * error)).alias("RMSE"),
            (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(F.lit(1)))).alias("R2"),
            (F.avg(F.when(y > 0, F.abs(error / y))) * 100).alias("MAPE"),
            *within,
        )
    )


def segment(value, table, right_closed: bool = False) -> Column:
    """Label of the interval a value falls in, null outside all of them."""
    v, out = as_col(value), None
    for low, high, label in table:
        inside = ((v > low) & (v <= high)) if right_closed else ((v >= low) & (v < high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def residuals_by_segment(df: DataFrame, area="surface_reelle_bati", actual="prix_reel", predicted="prix_predit") -> DataFrame:
    """MAE, bias and size by district, area segment and price tier, in one pass."""
    error = F.col(predicted) - F.col(actual)
    rows = df.select(
        F.col("arrondissement").cast("string").alias("arrondissement"),
        segment(area, C.AREA_SEGMENTS).alias("surface"),
        segment(actual, C.PRICE_SEGMENTS).alias("price_tier"),
        error.alias("e"),
    )
    dims = ["arrondissement", "surface", "price_tier"]
    grouped = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("gid"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.count("e").alias("n")
    )
    # grouping_id has one bit per column, set where the column is aggregated away
    name = F.when(F.col("gid") == 3, dims[0]).when(F.col("gid") == 5, dims[1]).otherwise(dims[2])
    return grouped.select(
        name.alias("dimension"), F.coalesce(*dims).alias("bucket"), "mae", "bias", "n"
    ).where(F.col("bucket").isNotNull())


def errors_by_area_bucket(df: DataFrame, area="surface_reelle_bati") -> DataFrame:
    """Mean and median absolute error and size per right-closed area bucket."""
    rows = df.select(segment(area, C.AREA_BUCKETS, right_closed=True).alias("bucket"), "erreur_abs")
    means = rows.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.avg("erreur_abs").alias("mae_mean"), F.count("erreur_abs").alias("n")
    )
    medians = group_quantiles(rows, ["bucket"], "erreur_abs", {"mae_median": 0.5}, bounded_keys=True, continuous=True).drop("n")
    return means.join(F.broadcast(medians), "bucket")


def histogram(df: DataFrame, value: str, bins: int, low=None, high=None) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin, empty bins are kept.

    Without bounds the range is the column's own minimum and maximum; with
    bounds, values outside are left out.
    """
    rows = df.select(F.col(value).alias("x")).where(F.col("x").isNotNull())
    if low is None:
        edges = rows.agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    else:
        rows = rows.where(F.col("x").between(low, high))
        edges = df.sparkSession.range(1).select(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    # a constant column has a range of no width: all its rows are in the first bin
    at = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
    counts = (
        rows.join(F.broadcast(edges))  # one row
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    frame = (
        edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"))
    )
    return frame.join(counts, "bin", "left").select("bin", "bin_low", "bin_high", F.coalesce("n", F.lit(0)).alias("n"))


def worst_districts(residuals: DataFrame, n: int = 5) -> DataFrame:
    return (
        residuals.where(F.col("dimension") == "arrondissement").orderBy(F.desc("mae"), "bucket").limit(n)
    )


def best_run(runs: DataFrame, prefer_r2: bool = False) -> DataFrame:
    """The run with the smallest MAE, or the highest R² among those under the MAE limit."""
    if prefer_r2:
        penalised = F.when(F.col("MAE") < C.BEST_RUN_MAE_LIMIT, -F.col("R2")).otherwise(100 - F.col("R2"))
        key = F.struct(penalised.alias("a"), F.col("MAE").alias("b"), F.col("model").alias("c"))
    else:
        key = F.struct(F.col("MAE").alias("a"), F.col("model").alias("b"))
    return runs.agg(F.min_by(F.struct("*"), key).alias("best")).select("best.*")


def improvement_table(runs: DataFrame, baseline: float = C.BASELINE_MAE) -> DataFrame:
    """Gain of each run over a baseline, with the best one marked."""
    best = F.min("MAE").over(Window.partitionBy(F.lit(1)))  # a table of runs: tens of rows
    return runs.withColumn("delta", F.col("MAE") - baseline).withColumn("is_best", F.col("MAE") == best)


def upsert_metrics(history: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the row of the same model in place, else append after the existing ones."""
    cols = [c for c in history.columns if c != "position"]
    last = history.agg(F.coalesce(F.max("position"), F.lit(0))).scalar()
    kept = history.join(new.select("model"), "model", "left_anti").select(*cols, "position")
    known = history.select("model", F.col("position").alias("_at"))
    order = F.row_number().over(Window.partitionBy(F.col("_at").isNull()).orderBy("model"))
    placed = new.join(known, "model", "left").withColumn("_r", order)
    incoming = placed.select(*cols, F.coalesce("_at", last + F.col("_r")).cast("int").alias("position"))
    return kept.unionByName(incoming)
