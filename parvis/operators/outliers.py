"""Statistical filters, outlier labels and distribution profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.geo import district
from parvis.functions.numbers import in_range, is_true
from parvis.operators.quantiles import group_quantiles

QUARTILES = {"q1": 0.25, "q3": 0.75}


def with_district(df: DataFrame) -> DataFrame:
    return df.withColumn("arrondissement", district())


def price_between(df: DataFrame, bounds=C.CORE_MARKET_BOUNDS, value: str = C.TARGET) -> DataFrame:
    return df.where(in_range(value, bounds))


def tight_bounds(df: DataFrame) -> DataFrame:
    return price_between(df, C.TIGHT_BOUNDS)


def enriched_valid(df: DataFrame) -> DataFrame:
    return df.where(
        in_range(C.TARGET, C.ENRICHED_PRICE_BOUNDS)
        & in_range("surface_reelle_bati", C.ENRICHED_AREA_BOUNDS)
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )


def iqr_bounds(df: DataFrame, factor: float, keys: list[str], value: str = C.TARGET) -> DataFrame:
    spread = (F.col("q3") - F.col("q1")) * factor
    return group_quantiles(df, keys, value, QUARTILES, bounded_keys=True).select(
        *keys, (F.col("q1") - spread).alias("iqr_low"), (F.col("q3") + spread).alias("iqr_high")
    )


def iqr_filter_by_district(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Keep sales inside the quartile fence of their own district.

    The fences are at most 100 rows (district is a number modulo 100), so they
    are broadcast and the sales are not shuffled.
    """
    sales = with_district(df)
    fences = iqr_bounds(sales, factor, ["arrondissement"])
    return (
        sales.join(F.broadcast(fences), "arrondissement")
        .where(F.col(C.TARGET).between(F.col("iqr_low"), F.col("iqr_high")))
        .drop("iqr_low", "iqr_high")
    )


def iqr_filter_global(df: DataFrame, factor: float = 1.5) -> DataFrame:
    # one row, as one scalar subquery
    fence = iqr_bounds(df, factor, []).select(F.struct("iqr_low", "iqr_high")).scalar()
    return df.where(F.col(C.TARGET).between(fence["iqr_low"], fence["iqr_high"]))


def label_outliers(df: DataFrame) -> DataFrame:
    """``bad`` = looks like an entry error or a non-market sale, else ``rare``."""
    premium = district().isin(C.BAD_PREMIUM_DISTRICTS)
    price_m2 = F.col(C.TARGET)
    bad = (
        is_true(F.col("valeur_fonciere") < C.BAD_TOTAL_PRICE)
        | is_true((price_m2 < C.BAD_PREMIUM_PRICE_M2) & premium)
        | is_true(
            (F.col("surface_reelle_bati") < C.BAD_TINY_AREA)
            & (F.col("nombre_pieces_principales") > C.BAD_TINY_ROOMS)
        )
        | is_true(price_m2 < C.BAD_PRICE_M2)
    )
    return df.withColumn("category", F.when(bad, "bad").otherwise("rare"))


def category_means(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(C.TARGET).alias("mean_prix_m2")
    )


def category_examples(labelled: DataFrame, tie: list[str], n: int = 5) -> DataFrame:
    """The cheapest ``bad`` and the dearest ``rare`` sales."""
    towards = F.when(F.col("category") == "bad", F.col(C.TARGET)).otherwise(-F.col(C.TARGET))
    window = Window.partitionBy("category").orderBy(towards.asc_nulls_last(), *tie)
    return labelled.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def profile(df: DataFrame, value: str = C.TARGET, factor: float = 1.5) -> DataFrame:
    """One-row description of a column with the number of values outside its fence."""
    probs = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    quantiles = group_quantiles(df, [], value, probs)
    spread = (F.col("q3") - F.col("q1")) * factor
    fence = quantiles.select("*", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    col = F.col(value)
    return (
        df.where(col.isNotNull())
        .join(F.broadcast(fence))
        .groupBy(*probs, "low", "high")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.count_if(col < F.col("low")).alias("n_below"),
            F.count_if(col > F.col("high")).alias("n_above"),
        )
    )


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill each column's gaps with its own median; all medians come from one pass. A column without values stays as it is."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(cells))
    medians = group_quantiles(long, ["name"], "value", {"m": 0.5}, bounded_keys=True)
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("_medians"))  # an entry per column
    filled = {c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c))) for c in columns}
    return df.crossJoin(F.broadcast(row)).withColumns(filled).drop("_medians")
