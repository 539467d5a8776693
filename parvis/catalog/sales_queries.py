"""Queries over sales: cleaning, outliers, market statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.functions.numbers import round_even
from parvis.functions.pricing import recency_weight
from parvis.operators import cleaning, market, outliers

SALE = ["id_mutation", "valeur_fonciere", "surface_reelle_bati", "prix_m2"]


@query(
    views="clean",
    sql="""SELECT id_mutation, strftime(date_mutation, '%Y-%m-%d') AS date_mutation, valeur_fonciere, surface_reelle_bati,
  nombre_pieces_principales, type_local, latitude, longitude, prix_m2, annee, mois, trimestre FROM clean""",
    digits={"latitude longitude": 6},
)
def clean_pipeline(spark, d):
    return V.clean(spark, d).select(
        "id_mutation", F.date_format("date_mutation", "yyyy-MM-dd").alias("date_mutation"), "valeur_fonciere",
        "surface_reelle_bati", "nombre_pieces_principales", "type_local", "latitude", "longitude", "prix_m2",
        "annee", "mois", "trimestre",
    )


DIRTY = {
    "IDMutation ": "l_orderkey",
    "DateMutation": "CASE WHEN l_partkey % 7 = 0 THEN 'inconnue' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "ValeurFonc": "CASE WHEN l_partkey % 10 = 0 THEN 'n/a' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END",
    "SBati": "CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.5' END",
    "NbpPrinc": "CASE WHEN l_partkey % 5 = 0 THEN 'x' ELSE CAST(l_linenumber AS STRING) END",
    "LibTypLocMut": "l_returnflag",
}


@query(
    sql="""SELECT l_orderkey AS id_mutation,
  strftime(CASE WHEN l_partkey % 7 > 0 THEN CAST(l_shipdate AS DATE) END, '%Y-%m-%d') AS date_mutation,
  CASE WHEN l_partkey % 10 > 0 THEN floor(l_extendedprice) END AS valeur_fonciere,
  CASE WHEN l_suppkey % 10 > 0 THEN l_quantity + 0.5e0 END AS surface_reelle_bati,
  CASE WHEN l_partkey % 5 > 0 THEN CAST(l_linenumber AS DOUBLE) END AS nombre_pieces_principales,
  l_returnflag AS type_local FROM lineitem""",
)
def type_coercion(spark, d):
    raw = V.table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in DIRTY.items()])
    typed = raw.transform(cleaning.normalise_names).transform(cleaning.coerce_types)
    return typed.select(
        "id_mutation", F.date_format("date_mutation", "yyyy-MM-dd").alias("date_mutation"), "valeur_fonciere",
        "surface_reelle_bati", F.col("nombre_pieces_principales").cast("double").alias("nombre_pieces_principales"), "type_local",
    )


@query(
    views="tx",
    sql="""SELECT type_local, count(*) AS n, avg(valeur_fonciere) AS mean_price FROM tx
WHERE type_local IN ('Appartement', 'Maison') AND valeur_fonciere BETWEEN 10000 AND 30000000
  AND surface_reelle_bati BETWEEN 5 AND 1500 AND valeur_fonciere / surface_reelle_bati BETWEEN 2000 AND 50000
GROUP BY type_local""",
    digits={"mean_price": 4},
)
def hard_bounds(spark, d):
    kept = V.tx(spark, d).transform(cleaning.keep_homes).transform(cleaning.within_hard_bounds)
    return kept.groupBy("type_local").agg(F.count(F.lit(1)).alias("n"), F.avg("valeur_fonciere").alias("mean_price"))


@query(
    views="clean",
    sql="""SELECT id_mutation, c.arrondissement, prix_m2 FROM clean c JOIN
 (SELECT arrondissement, quantile_cont(prix_m2, 0.25) AS q1, quantile_cont(prix_m2, 0.75) AS q3 FROM clean GROUP BY 1) q
 ON c.arrondissement = q.arrondissement WHERE prix_m2 BETWEEN q1 - 1.0e0 * (q3 - q1) AND q3 + 1.0e0 * (q3 - q1)""",
)
def iqr_by_district(spark, d):
    return outliers.iqr_filter_by_district(V.clean(spark, d), 1.0).select("id_mutation", "arrondissement", "prix_m2")


@query(
    views="clean",
    sql="""SELECT id_mutation, prix_m2 FROM clean, (SELECT quantile_cont(prix_m2, 0.25) AS q1, quantile_cont(prix_m2, 0.75) AS q3 FROM clean)
WHERE prix_m2 BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)""",
)
def iqr_global(spark, d):
    return outliers.iqr_filter_global(V.clean(spark, d), 1.5).select("id_mutation", "prix_m2")


@query(views="clean", sql="SELECT id_mutation, prix_m2 FROM clean WHERE prix_m2 BETWEEN 5000 AND 20000")
def price_filter(spark, d):
    return outliers.price_between(V.clean(spark, d)).select("id_mutation", "prix_m2")


@query(views="clean", sql="SELECT id_mutation, prix_m2 FROM clean WHERE prix_m2 BETWEEN 3000 AND 25000")
def tight_price_bounds(spark, d):
    return outliers.tight_bounds(V.clean(spark, d)).select("id_mutation", "prix_m2")


@query(
    views="clean",
    sql="""SELECT id_mutation, prix_m2, surface_reelle_bati FROM clean WHERE prix_m2 BETWEEN 2000 AND 25000
AND surface_reelle_bati BETWEEN 5 AND 300 AND latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def enriched_validity(spark, d):
    return outliers.enriched_valid(V.clean(spark, d)).select("id_mutation", "prix_m2", "surface_reelle_bati")


@query(
    views="clean",
    sql="""SELECT id_mutation, surface_reelle_bati, CAST(nombre_pieces_principales AS DOUBLE) AS nombre_pieces_principales,
 code_postal % 100 AS arrondissement, longitude, latitude, CAST(mois AS DOUBLE) AS mois, CAST(coalesce(nombre_lots, 1) AS DOUBLE) AS nombre_lots, prix_m2
FROM clean WHERE surface_reelle_bati IS NOT NULL AND nombre_pieces_principales IS NOT NULL AND mois IS NOT NULL""",
    digits={"latitude longitude": 6},
)
def base_features(spark, d):
    return cleaning.base_features(V.clean(spark, d))


@query(
    views="clean",
    sql="""SELECT id_mutation, coalesce(lot1_surface_carrez, (SELECT quantile_cont(lot1_surface_carrez, 0.5) FROM clean)) AS lot1_surface_carrez
FROM clean""",
    digits={"lot1_surface_carrez": 6},
)
def median_imputation(spark, d):
    return outliers.impute_medians(V.clean(spark, d), ["lot1_surface_carrez"]).select("id_mutation", "lot1_surface_carrez")


_LABELLED = """labelled AS (SELECT *, CASE WHEN coalesce(valeur_fonciere < 50000, false)
   OR coalesce(prix_m2 < 3000 AND arr IN (1, 2, 3, 4, 6, 7, 8, 16), false)
   OR coalesce(surface_reelle_bati < 9 AND nombre_pieces_principales > 2, false)
   OR coalesce(prix_m2 < 1500, false) THEN 'bad' ELSE 'rare' END AS category
 FROM (SELECT *, CAST(code_postal AS BIGINT) % 100 AS arr, round_even(valeur_fonciere / surface_reelle_bati * 100, 0) / 100 AS prix_m2 FROM tx))"""


def _labelled(spark, d):
    sales = V.tx(spark, d).withColumn("prix_m2", round_even(F.col("valeur_fonciere") / F.col("surface_reelle_bati"), 2))
    return outliers.label_outliers(sales)


@query(
    views="tx",
    sql=f"WITH {_LABELLED} SELECT id_mutation, l_linenumber, l_partkey, l_suppkey, prix_m2, category FROM labelled",
)
def outlier_rule(spark, d):
    return _labelled(spark, d).select("id_mutation", "l_linenumber", "l_partkey", "l_suppkey", "prix_m2", "category")


@query(
    views="tx",
    sql=f"WITH {_LABELLED} SELECT category, count(*) AS n, avg(prix_m2) AS mean_prix_m2 FROM labelled GROUP BY category",
    digits={"mean_prix_m2": 4},
)
def outlier_means(spark, d):
    return outliers.category_means(_labelled(spark, d))


@query(
    views="tx",
    sql=f"""WITH {_LABELLED} SELECT category, rank, id_mutation, prix_m2 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category
 ORDER BY CASE WHEN category = 'bad' THEN prix_m2 ELSE -prix_m2 END NULLS LAST, id_mutation, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM labelled)
WHERE rank <= 5""",
)
def outlier_examples(spark, d):
    tie = ["id_mutation", "l_linenumber", "l_partkey", "l_suppkey"]
    return outliers.category_examples(_labelled(spark, d), tie).select("category", "rank", "id_mutation", "prix_m2")


@query(
    views="clean",
    sql="""WITH f AS (SELECT quantile_cont(prix_m2, 0.01) AS p01, quantile_cont(prix_m2, 0.05) AS p05, quantile_cont(prix_m2, 0.25) AS q1,
 quantile_cont(prix_m2, 0.75) AS q3, quantile_cont(prix_m2, 0.95) AS p95, quantile_cont(prix_m2, 0.99) AS p99 FROM clean),
g AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS low, q3 + 1.5e0 * (q3 - q1) AS high FROM f)
SELECT p01, p05, q1, q3, p95, p99, low, high, count(*) AS n, min(prix_m2) AS min, max(prix_m2) AS max, avg(prix_m2) AS mean,
 stddev_samp(prix_m2) AS std, count(*) FILTER (prix_m2 < low) AS n_below, count(*) FILTER (prix_m2 > high) AS n_above
FROM clean, g GROUP BY ALL""",
    digits={"p01 p05 q1 q3 p95 p99 low high mean std": 4},
)
def price_profile(spark, d):
    return outliers.profile(V.clean(spark, d))


@query(
    views="clean",
    sql="SELECT id_mutation, annee, greatest(0.5e0, 1.0e0 + (annee - 2023) * 0.4e0) AS weight FROM clean",
    digits={"weight": 9},
)
def temporal_weight(spark, d):
    return V.clean(spark, d).select("id_mutation", "annee", recency_weight("annee").alias("weight"))


# -- market --------------------------------------------------------------------------------

_FILTER = dict(arrondissement=11, min_price=50_000, max_price=300_000, min_surface=10, max_surface=45)


@query(
    views="clean",
    sql="""SELECT id_mutation, arrondissement, valeur_fonciere, surface_reelle_bati, prix_m2 FROM clean
WHERE arrondissement = 11 AND valeur_fonciere >= 50000 AND valeur_fonciere <= 300000 AND surface_reelle_bati >= 10 AND surface_reelle_bati <= 45""",
)
def transactions_filtered(spark, d):
    return market.browse(V.clean(spark, d), **_FILTER).select(*SALE, "arrondissement")


@query(
    views="clean",
    sql="""SELECT avg(prix_m2) AS avg_prix_m2, avg(surface_reelle_bati) AS avg_surface, avg(valeur_fonciere) AS avg_price, count(*) AS total_count,
 quantile_cont(prix_m2, 0.5) AS median_prix_m2 FROM clean WHERE valeur_fonciere >= 50000 AND surface_reelle_bati <= 45""",
    digits={"avg_prix_m2 avg_surface avg_price median_prix_m2": 4},
)
def filtered_stats(spark, d):
    return market.filtered_stats(market.browse(V.clean(spark, d), min_price=50_000, max_surface=45))


@query(
    views="clean",
    sql="""SELECT arrondissement, count(*) AS count, avg(prix_m2) AS avg_prix_m2, quantile_cont(prix_m2, 0.5) AS median_prix_m2
FROM clean WHERE valeur_fonciere >= 50000 GROUP BY arrondissement""",
    digits={"avg_prix_m2 median_prix_m2": 4},
)
def district_breakdown(spark, d):
    return market.district_breakdown(market.browse(V.clean(spark, d), min_price=50_000))


_SUMMARY = """count(*) AS count, avg(prix_m2) AS prix_m2_mean, quantile_cont(prix_m2, 0.5) AS prix_m2_median,
 quantile_cont(prix_m2, 0.25) AS prix_m2_q25, quantile_cont(prix_m2, 0.75) AS prix_m2_q75, quantile_cont(surface_reelle_bati, 0.5) AS surface_median"""


@query(
    views="clean",
    sql=f"SELECT arrondissement AS zone, false AS is_total, {_SUMMARY} FROM clean GROUP BY 1 UNION ALL SELECT NULL AS zone, true AS is_total, {_SUMMARY} FROM clean",
    # six digits: the mean of cents over some groups ends in a 5 at the fifth, where the order of adding decides
    digits={"prix_m2_mean": 6, "prix_m2_median prix_m2_q25 prix_m2_q75 surface_median": 4},
)
def market_summary(spark, d):
    return market.market_summary(V.clean(spark, d))


@query(
    views="clean",
    sql="""SELECT code_postal, quantile_cont(prix_m2, 0.5) AS median_prix_m2 FROM clean GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5""",
    digits={"median_prix_m2": 4},
)
def top5_districts(spark, d):
    return market.top_groups_by_median(V.clean(spark, d))


_EDA = ["date_mutation", "valeur_fonciere", "nombre_pieces_principales", "latitude", "lot1_surface_carrez", "prix_m2"]


@query(
    views="clean",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 100.0e0 ELSE 0.0e0 END) AS missing_pct FROM clean" for c in _EDA),
    digits={"missing_pct": 6},
)
def eda_missing(spark, d):
    return market.missing_percent(V.clean(spark, d).select(*_EDA))


@query(
    views="clean",
    sql=" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
 CAST(max({c}) AS DOUBLE) AS max, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50,
 CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75 FROM clean"""
        for c in market.DESCRIBED
    ),
    digits={"mean std min max p25 p50 p75": 4},
)
def eda_describe(spark, d):
    return market.describe(V.clean(spark, d))


@query(
    views="clean",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS dimension, CAST({c} AS STRING) AS value, count(*) AS n FROM clean GROUP BY 2" for c in ("type_local", "code_departement", "annee")
    ),
)
def value_counts(spark, d):
    return market.value_counts(V.clean(spark, d))


_CORR = [*C.BASE_FEATURES, "prix_m2"]


@query(
    views="clean",
    sql=" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM clean" for i, a in enumerate(_CORR) for b in _CORR[:i]
    ),
    digits={"corr": 7},
)
def correlation(spark, d):
    return market.correlations(cleaning.base_features(V.clean(spark, d)), _CORR)


@query(
    views="clean",
    sql="""WITH r AS (SELECT * FROM clean WHERE arrondissement BETWEEN 1 AND 20 AND prix_m2 BETWEEN 2000 AND 18000),
b AS (SELECT arrondissement, quantile_cont(prix_m2, 0.25) AS q1, quantile_cont(prix_m2, 0.5) AS median, quantile_cont(prix_m2, 0.75) AS q3, count(*) AS n FROM r GROUP BY 1)
SELECT b.arrondissement, q1, median, q3, n, min(prix_m2) AS whisker_low, max(prix_m2) AS whisker_high FROM r JOIN b ON r.arrondissement = b.arrondissement
WHERE prix_m2 BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY ALL""",
    digits={"q1 median q3": 4},
)
def box_stats(spark, d):
    return market.box_statistics(V.clean(spark, d))


@query(views="clean", sql="SELECT count(DISTINCT code_departement) AS departments FROM clean")
def distinct_departments(spark, d):
    return market.distinct_departments(V.clean(spark, d))


@query(
    views="clean",
    sql="""SELECT strftime(date_mutation, '%Y-%m-%d') AS date_mutation, id_mutation, valeur_fonciere, surface_reelle_bati, nombre_pieces_principales,
 type_local, prix_m2, latitude, longitude, arrondissement FROM clean WHERE valeur_fonciere >= 50000 ORDER BY clean.date_mutation DESC, id_mutation LIMIT 200 OFFSET 400""",
    digits={"latitude longitude": 6},
)
def transaction_page(spark, d):
    return market.transaction_page(market.browse(V.clean(spark, d), min_price=50_000), limit=200, offset=400)


@query()
def map_sample(spark, d):
    return market.map_sample(V.clean(spark, d))
