"""Queries that find under-priced sales and score listings and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.functions import pricing
from parvis.operators import cleaning, outliers
from parvis.plans import recommend as R
from parvis.session import stage
from parvis.sources import tables

_MEDIANS = "SELECT arrondissement, quantile_cont(prix_m2, 0.5) AS prix_m2_predit, quantile_cont(prix_m2, 0.15) AS district_floor FROM {t} GROUP BY 1"
_SCORED = f"""scored AS (SELECT c.*, prix_m2_predit, district_floor, (prix_m2_predit - prix_m2) / greatest(prix_m2_predit, 1.0e0) AS gem_score
 FROM {{t}} c JOIN ({_MEDIANS}) m USING (arrondissement) WHERE prix_m2 >= district_floor)"""
_KEPT = """kept AS (SELECT c.* FROM clean c JOIN (SELECT arrondissement, quantile_cont(prix_m2, 0.25) AS q1, quantile_cont(prix_m2, 0.75) AS q3
 FROM clean GROUP BY 1) q USING (arrondissement) WHERE prix_m2 BETWEEN 2 * q1 - q3 AND 2 * q3 - q1)"""


@query(
    views="clean",
    sql=f"""WITH {_KEPT}, {_SCORED.format(t="kept")}
SELECT id_mutation, arrondissement, prix_m2, prix_m2_predit, district_floor, gem_score FROM scored WHERE gem_score >= 0.10e0""",
    digits={"prix_m2_predit district_floor": 4, "gem_score": 7},
)
def under_priced_sales(spark, d):
    kept = stage(outliers.iqr_filter_by_district(V.clean(spark, d), 1.0))
    return R.scored_sales(kept).where(F.col("gem_score") >= C.GEM_THRESHOLD).select(
        "id_mutation", "arrondissement", "prix_m2", "prix_m2_predit", "district_floor", "gem_score"
    )


_PRESENTED = """prix_m2 * surface_reelle_bati AS prix_total_transaction, prix_m2_predit * surface_reelle_bati AS prix_total_predit,
 gem_score * 100 AS decote_pct, CASE WHEN gem_score * 100 >= 20 THEN 'excellent' WHEN gem_score * 100 >= 15 THEN 'tres bon' ELSE 'bon' END AS tier"""
_GEM_COLUMNS = [
    "rank", "id_mutation", "arrondissement", "prix_m2", "prix_m2_predit", "gem_score",
    "prix_total_transaction", "prix_total_predit", "decote_pct", "tier",
]
_GEM_DIGITS = {"prix_m2_predit prix_total_transaction prix_total_predit decote_pct": 4, "gem_score": 7}
# initcap over words separated by blanks
_LABEL = """adresse_numero || ' ' || array_to_string(list_transform(string_split(lower(adresse_nom_voie), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
 || ' Paris ' || arrondissement || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'e' END AS adresse"""


@query(
    views="clean",
    sql=f"""WITH {_SCORED.format(t="clean")}
SELECT CAST(row_number() OVER (ORDER BY gem_score DESC, id_mutation) AS INT) AS rank, id_mutation, arrondissement, prix_m2, prix_m2_predit, gem_score,
 {_PRESENTED}, {_LABEL} FROM scored WHERE gem_score >= 0.10e0 AND prix_m2 * surface_reelle_bati <= 250000 AND arrondissement BETWEEN 10 AND 12
 AND surface_reelle_bati BETWEEN 20 AND 60 AND coalesce(nombre_pieces_principales, 0) >= 2 ORDER BY gem_score DESC, id_mutation LIMIT 25""",
    digits=_GEM_DIGITS,
)
def hidden_gems(spark, d):
    found = R.recommend(V.clean(spark, d), 250_000, 11, 20.0, 60.0, 2, top_n=25)
    return found.select(*_GEM_COLUMNS, "adresse")


@query(
    views="clean searches",
    sql=f"""WITH {_SCORED.format(t="clean")}, hits AS (SELECT search_id, s.*, CAST(row_number() OVER (PARTITION BY search_id ORDER BY gem_score DESC, id_mutation) AS INT) AS rank
 FROM searches q JOIN scored s ON (wanted IS NULL OR s.arrondissement BETWEEN greatest(1, wanted - 1) AND least(20, wanted + 1))
 AND prix_m2 * surface_reelle_bati <= budget AND surface_reelle_bati BETWEEN surface_min AND surface_max AND coalesce(nombre_pieces_principales, 0) >= pieces_min
 WHERE gem_score >= 0.10e0)
SELECT search_id, rank, id_mutation, arrondissement, prix_m2, prix_m2_predit, gem_score, {_PRESENTED} FROM hits WHERE rank <= 5""",
    digits=_GEM_DIGITS,
)
def gem_search_batch(spark, d):
    return R.recommend_many(V.clean(spark, d), V.searches(spark, d)).select("search_id", *_GEM_COLUMNS)


@query(
    views="clean",
    sql="""SELECT id_mutation, c.arrondissement, district_floor FROM clean c JOIN
 (SELECT arrondissement, quantile_cont(prix_m2, 0.15) AS district_floor FROM clean GROUP BY 1) f ON c.arrondissement = f.arrondissement""",
    digits={"district_floor": 4},
)
def district_floor(spark, d):
    return R.with_district_floor(V.clean(spark, d)).select("id_mutation", "arrondissement", "district_floor")


@query(
    views="train test",
    sql="""SELECT id_mutation, coalesce(m, (SELECT quantile_cont(prix_m2, 0.5) FROM train)) AS prix_m2_predit FROM test
LEFT JOIN (SELECT arrondissement, quantile_cont(prix_m2, 0.5) AS m FROM train GROUP BY 1) USING (arrondissement)""",
    digits={"prix_m2_predit": 4},
)
def naive_median_model(spark, d):
    from parvis.operators.features import split_train_test

    train, test = split_train_test(V.clean(spark, d))
    return R.predict_district_median(test, train).select("id_mutation", "prix_m2_predit")


# -- listings -----------------------------------------------------------------------------------

_FALLBACK = "CASE arrondissement " + " ".join(f"WHEN {k} THEN {v}e0" for k, v in C.FALLBACK_PRICE_M2.items()) + " ELSE 10800.0e0 END"
_LISTING_SCORE = f"""SELECT id_mutation, arrondissement, surface, prix_annonce, prix_predit_m2, prix_predit_m2 * surface AS prix_predit, prix_annonce / surface AS prix_affiche_m2,
 (prix_predit_m2 - prix_annonce * (1 - 0.07e0) / surface) / prix_predit_m2 AS gem_score,
 prix_predit_m2 * surface - prix_annonce * (1 - 0.07e0) AS gain_potentiel FROM (SELECT *, {_FALLBACK} AS prix_predit_m2 FROM listings)"""
_LISTING_COLUMNS = [
    "id_mutation", "arrondissement", "surface", "prix_annonce", "prix_predit_m2", "prix_predit", "prix_affiche_m2", "gem_score", "gain_potentiel",
]
_LISTING_DIGITS = {"prix_predit prix_affiche_m2 gain_potentiel": 3, "gem_score": 7}


@query(views="listings", sql=_LISTING_SCORE, digits=_LISTING_DIGITS)
def listing_scores(spark, d):
    return R.score_listings(V.listings(spark, d)).select(*_LISTING_COLUMNS)


@query(
    views="listings",
    sql=f"SELECT *, gem_score * 100 AS sous_evaluation_pct FROM ({_LISTING_SCORE}) WHERE gem_score > 0.10e0",
    digits={**_LISTING_DIGITS, "sous_evaluation_pct": 5},
)
def gem_score_listings(spark, d):
    return R.listing_gems(V.listings(spark, d)).select(*_LISTING_COLUMNS, "sous_evaluation_pct")


@query(
    views="listings",
    sql=f"""SELECT * FROM ({_LISTING_SCORE}) WHERE gem_score > 0.10e0 AND gem_score >= 0.3e0 AND arrondissement = 7 AND surface >= 20 AND prix_annonce <= 400000""",
    digits=_LISTING_DIGITS,
)
def gems_browsed(spark, d):
    gems = R.listing_gems(V.listings(spark, d))
    return R.browse_gems(gems, 0.3, 7, 20.0, 400_000).select(*_LISTING_COLUMNS)


@query(
    views="listings",
    sql=f"SELECT * FROM ({_LISTING_SCORE}) WHERE gem_score > 0 ORDER BY gem_score DESC, id_mutation LIMIT 1",
    digits=_LISTING_DIGITS,
)
def best_listing(spark, d):
    return R.best_listing(R.score_listings(V.listings(spark, d))).select(*_LISTING_COLUMNS)


@query(
    views="listings",
    sql=f"""SELECT '2025-01-31' AS date_mise_a_jour, count(*) AS nb_annonces_analysees, count(*) FILTER (gem_score > 0.10e0) AS nb_pepites,
 0.10e0 AS seuil_gem_score FROM ({_LISTING_SCORE})""",
)
def gems_run_metadata(spark, d):
    return tables.gems_metadata(R.score_listings(V.listings(spark, d)), "2025-01-31")


_ROUTE = {
    "id_mutation": "id_mutation",
    "prix_annonce": "CASE WHEN id_mutation % 5 = 0 THEN 0 ELSE prix_annonce END",
    "surface": "CASE WHEN id_mutation % 7 = 0 THEN NULL ELSE surface END",
    "arrondissement": "CASE WHEN id_mutation % 3 = 0 THEN 0 ELSE arrondissement END",
}


@query(
    views="listings",
    sql=f"""WITH r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ROUTE.items())} FROM listings),
m AS (SELECT id_mutation, concat_ws(',', CASE WHEN NOT coalesce(prix_annonce > 0, false) THEN 'prix' END,
 CASE WHEN NOT coalesce(surface > 0, false) THEN 'surface' END, CASE WHEN NOT coalesce(arrondissement BETWEEN 1 AND 20, false) THEN 'arrondissement' END) AS missing FROM r)
SELECT id_mutation, missing, CASE WHEN missing = '' THEN 'complete' ELSE 'needs_input' END AS status FROM m""",
)
def listing_routing(spark, d):
    rows = V.listings(spark, d).select(*[F.expr(e).alias(n) for n, e in _ROUTE.items()])
    return cleaning.route_listings(rows).select("id_mutation", F.array_join("missing", ",").alias("missing"), "status")


def _points(table: dict) -> str:
    return "(VALUES " + ", ".join(f"({k}, {a}e0, {b}e0)" for k, (a, b) in table.items()) + ") AS p(arrondissement, clat, clon)"


@query(
    views="listings",
    sql=f"""SELECT id_mutation, coalesce(latitude, clat, 48.8566e0) AS latitude, coalesce(longitude, clon, 2.3522e0) AS longitude
FROM listings LEFT JOIN {_points(C.LISTING_CENTROIDS)} USING (arrondissement)""",
    digits={"latitude longitude": 6},
)
def centroid_fill(spark, d):
    return R.locate_listings(V.listings(spark, d)).select("id_mutation", "latitude", "longitude")


@query(
    views="requests",
    sql=f"""WITH m AS (SELECT r.*, clat, clon, coalesce(2 * 6371.0e0 * asin(sqrt(power(sin(radians(clat - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians(clat)) * power(sin(radians(clon - longitude) / 2), 2))) > 3.0e0, false) AS snapped
 FROM requests r LEFT JOIN {_points(C.CENTROIDS)} USING (arrondissement))
SELECT id_mutation, l_linenumber, l_partkey, snapped, CASE WHEN snapped THEN clat ELSE latitude END AS latitude,
 CASE WHEN snapped THEN clon ELSE longitude END AS longitude FROM m""",
    digits={"latitude longitude": 6},
)
def coordinate_snap(spark, d):
    return R.snap_coordinates(V.requests(spark, d)).select("id_mutation", "l_linenumber", "l_partkey", "snapped", "latitude", "longitude")


ERRORS_SQL = """concat_ws(',',
 CASE WHEN NOT coalesce(surface > 0 AND surface <= 2000, false) THEN 'surface' END,
 CASE WHEN NOT coalesce(pieces BETWEEN 1 AND 20, false) THEN 'pieces' END,
 CASE WHEN NOT coalesce(arrondissement BETWEEN 1 AND 20, false) THEN 'arrondissement' END,
 CASE WHEN NOT coalesce(latitude BETWEEN 48.7e0 AND 49.0e0, false) THEN 'latitude' END,
 CASE WHEN NOT coalesce(longitude BETWEEN 2.0e0 AND 2.7e0, false) THEN 'longitude' END,
 CASE WHEN NOT coalesce(annee BETWEEN 2020 AND 2030, true) THEN 'annee' END,
 CASE WHEN NOT coalesce(mois BETWEEN 1 AND 12, false) THEN 'mois' END,
 CASE WHEN NOT coalesce(trimestre BETWEEN 1 AND 4, false) THEN 'trimestre' END,
 CASE WHEN NOT coalesce(nombre_lots BETWEEN 1 AND 10, false) THEN 'nombre_lots' END,
 CASE WHEN NOT coalesce(prix_affiche > 0, true) THEN 'prix_affiche' END)"""


@query(
    views="requests",
    sql=f"SELECT id_mutation, l_linenumber, l_partkey, l_suppkey, {ERRORS_SQL} AS errors FROM requests",
)
def request_validation(spark, d):
    return cleaning.validate_requests(V.requests(spark, d)).select(
        "id_mutation", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("errors", ",").alias("errors")
    )


@query(
    views="requests",
    sql="""SELECT id_mutation, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN surface < 35 THEN 1 WHEN surface < 55 THEN 2 WHEN surface < 75 THEN 3 WHEN surface < 100 THEN 4
 WHEN surface < 130 THEN 5 ELSE greatest(6, round_even(surface / 22, 0)) END AS INT) AS rooms FROM requests""",
)
def rooms_rule(spark, d):
    return V.requests(spark, d).select("id_mutation", "l_linenumber", "l_partkey", "l_suppkey", pricing.rooms_from_area("surface").alias("rooms"))


_MARGIN = """CASE WHEN days_on_market IS NULL THEN 0.07e0 WHEN days_on_market <= 30 THEN 0.05e0 WHEN days_on_market <= 90 THEN 0.07e0
 WHEN days_on_market <= 180 THEN 0.10e0 ELSE 0.13e0 END"""


@query(views="listings", sql=f"SELECT id_mutation, {_MARGIN} AS margin FROM listings")
def margin_by_days(spark, d):
    return V.listings(spark, d).select("id_mutation", pricing.margin_by_days("days_on_market").alias("margin"))


def _case(col: str, table: dict, default: str) -> str:
    key = lambda k: f"'{k}'" if isinstance(k, str) else k
    return f"CASE {col} " + " ".join(f"WHEN {key(k)} THEN {v}e0" for k, v in table.items()) + f" ELSE {default} END"


FACTORS_SQL = f"""SELECT *, CASE WHEN etage IS NULL THEN 1.0e0 ELSE {_case("least(etage, 5)", C.FLOOR_FACTORS, "1.04e0")} END AS floor_corr,
 {_case("dpe_classe", C.ENERGY_FACTORS, "1.0e0")} AS dpe_corr, {_case("exposition", C.EXPOSURE_FACTORS, "1.0e0")} AS expo_corr,
 CASE WHEN vision_score IS NULL THEN 0.95e0 + renovation_score * 0.13e0 ELSE {_case("vision_score", C.VISION_RENOVATION, "1.0e0")}
  * {_case("luminosite", C.VISION_LIGHT, "1.0e0")} * {_case("hauteur_plafond", C.VISION_CEILING, "1.0e0")} * {_case("qualite_generale", C.VISION_QUALITY, "1.0e0")} END AS reno_corr,
 {_case("vision_score", C.WORKS_COST_M2, "0.0e0")} AS reno_cost_m2, {_MARGIN} AS negotiation_margin FROM {{source}}"""
PRICED_SQL = """SELECT *, greatest(prix_corrige_m2 - reno_cost_m2, prix_corrige_m2 * 0.5e0) AS prix_net_m2
 FROM (SELECT *, prix_m2_predit * 0.97e0 * floor_corr * dpe_corr * reno_corr * expo_corr AS prix_corrige_m2 FROM factors)"""
ADJUSTED_SQL = """CASE WHEN prix_net_m2 > 0 THEN (prix_net_m2 - prix_annonce * (1 - negotiation_margin) / surface) / prix_net_m2 ELSE 0.0e0 END AS gem_score,
 CAST(floor(prix_corrige_m2 * surface) AS BIGINT) AS prix_predit_total,
 CASE WHEN prix_annonce * surface * prix_corrige_m2 IS NOT NULL
 THEN CAST(greatest(0, floor(floor(prix_corrige_m2 * surface) - prix_annonce * (1 - negotiation_margin))) AS BIGINT) END AS gain_potentiel"""


@query(
    views="listings",
    sql=f"""WITH predicted AS (SELECT *, {_FALLBACK} AS prix_m2_predit FROM listings), factors AS ({FACTORS_SQL.format(source="predicted")}), priced AS ({PRICED_SQL})
SELECT *, coalesce(gem_score > 0.10e0, false) AS is_hidden_gem FROM (SELECT id_mutation, floor_corr, dpe_corr, reno_corr, expo_corr, reno_cost_m2, negotiation_margin,
 prix_corrige_m2, prix_net_m2, {ADJUSTED_SQL} FROM priced)""",
    digits={"floor_corr dpe_corr reno_corr expo_corr": 7, "prix_corrige_m2 prix_net_m2": 4, "gem_score": 7},
)
def price_corrections(spark, d):
    listings = V.listings(spark, d).withColumn("prix_m2_predit", pricing.fallback_price_m2("arrondissement"))
    return R.price_adjustments(listings).select(
        "id_mutation", "floor_corr", "dpe_corr", "reno_corr", "expo_corr", "reno_cost_m2", "negotiation_margin",
        "prix_corrige_m2", "prix_net_m2", "gem_score", "prix_predit_total", "gain_potentiel", "is_hidden_gem",
    )
