"""Requests, listings and pages priced by a fitted model.

The model is linear in area and recent price of the street, so SQL can fit it too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.feature_queries import _LOOKUPS, _TRAILING
from parvis.catalog.gem_queries import ERRORS_SQL, _points
from parvis.catalog.page_queries import AS_OF as PAGES_AS_OF
from parvis.catalog.page_queries import _VISION_SQL, analysis_sql
from parvis.catalog.registry import query
from parvis.operators import extraction as E
from parvis.operators.features import training_frame
from parvis.plans import requests as Q
from parvis.plans import training
from parvis.plans.listing_analysis import analyse_pages
from parvis.session import stage

FEATURES = ["surface_reelle_bati", "voie_recent_prix_m2"]
AS_OF = "2025-01-01"

FIT_SQL = f"""{_LOOKUPS.format(arr="avg(prix_m2)")},
seen AS (SELECT surface_reelle_bati AS x, coalesce({_TRAILING}, g) AS z, prix_m2 AS y FROM train CROSS JOIN g),
moments AS (SELECT covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy,
 avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM seen),
line AS (SELECT mx, mz, my, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM moments),
held AS (SELECT sqrt(avg(power(my + bx * (surface_reelle_bati - mx) + bz * (coalesce(street_recent, district_recent, g) - mz) - prix_m2, 2))) AS rmse
 FROM test CROSS JOIN g CROSS JOIN line LEFT JOIN r_voie USING (adresse_code_voie) LEFT JOIN r_arr USING (arrondissement))"""


def line_model(spark, d):
    """A line over area and recent price, with its held-out error."""
    train, test, enc = training_frame(V.clean(spark, d), columns=FEATURES)
    train, test = stage(train), stage(test)  # the fit reads them several times
    return training.fit(train, training.linear(FEATURES), enc, held_out=test)


_KM = """(2 * 6371.0e0 * asin(sqrt(power(sin(radians({a} - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians({a})) * power(sin(radians({b} - longitude) / 2), 2))))"""
_EURO = "format('{{:,.0f}}', {})"


def _factors(sign: str, plus: str) -> str:
    parts = [f"CASE WHEN v{i} {sign} 0 THEN '**' || d{i} || '** ({plus}' || {_EURO.format(f'v{i}')} || ' €/m²)' END" for i in (1, 2)]
    return f"nullif(concat_ws(', ', {', '.join(parts)}), '')"


_KEYS = ["id_mutation", "l_linenumber", "l_partkey", "l_suppkey"]
_PRICES = ["prix_predit_m2", "prix_predit_total", "confidence_low", "confidence_high", "gem_score"]


@query(
    views="requests enriched train test",
    sql=f"""WITH {FIT_SQL},
checked AS (SELECT r.*, clat, clon, {ERRORS_SQL} AS errors FROM requests r LEFT JOIN {_points(C.CENTROIDS)} USING (arrondissement)),
far AS (SELECT *, {_KM.format(a='clat', b='clon')} > 3.0e0 AS snapped FROM checked WHERE errors = ''),
placed AS (SELECT * REPLACE (CASE WHEN snapped THEN clat ELSE latitude END AS latitude, CASE WHEN snapped THEN clon ELSE longitude END AS longitude) FROM far),
e AS (SELECT *, CAST(round_even(lat_grid / 0.005e0, 0) AS BIGINT) AS cy, CAST(round_even(lon_grid / 0.005e0, 0) AS BIGINT) AS cx FROM enriched
 QUALIFY row_number() OVER (PARTITION BY round_even(lat_grid / 0.005e0, 0), round_even(lon_grid / 0.005e0, 0) ORDER BY place_id) = 1),
looked AS (SELECT p.*, coalesce(street_recent, district_recent, g) AS z, coalesce(e.dist_metro_m, 214.0e0) AS dist_metro_m, coalesce(e.nb_parks, 6.0e0) AS nb_parks
 FROM placed p CROSS JOIN g LEFT JOIN r_voie USING (adresse_code_voie) LEFT JOIN r_arr USING (arrondissement)
 LEFT JOIN e ON cy = CAST(round_even(latitude / 0.005e0, 0) AS BIGINT) AND cx = CAST(round_even(longitude / 0.005e0, 0) AS BIGINT)),
scored AS (SELECT *, my + bx * (surface - mx) + bz * (z - mz) AS p, round_even(bx * (surface - mx), 0) AS cs, round_even(bz * (z - mz), 0) AS cv FROM looked CROSS JOIN line CROSS JOIN held),
ranked AS (SELECT *, abs(cs) >= abs(cv) AS area_first, CASE WHEN abs(cs) >= abs(cv) THEN cs ELSE cv END AS v1, CASE WHEN abs(cs) >= abs(cv) THEN cv ELSE cs END AS v2,
 CASE WHEN abs(cs) >= abs(cv) THEN 'Surface brute' ELSE 'Prix récents (même rue)' END AS d1, CASE WHEN abs(cs) >= abs(cv) THEN 'Prix récents (même rue)' ELSE 'Surface brute' END AS d2,
 CASE WHEN p > 0 THEN round_even((p - prix_affiche * (1 - 0.07e0) / surface) / p * 10000, 0) / 10000 END AS score FROM scored),
priced AS (SELECT {', '.join(_KEYS)}, '' AS errors, snapped, latitude, longitude, dist_metro_m, nb_parks, round_even(p * 10, 0) / 10 AS prix_predit_m2, round_even(p * surface, 0) AS prix_predit_total,
 round_even((p - rmse) * 10, 0) / 10 AS confidence_low, round_even((p + rmse) * 10, 0) / 10 AS confidence_high, score AS gem_score, coalesce(score > 0.10e0, false) AS is_hidden_gem,
 CASE WHEN area_first THEN 'surface_reelle_bati,voie_recent_prix_m2' ELSE 'voie_recent_prix_m2,surface_reelle_bati' END AS factors,
 concat_ws(' ', 'Ce bien dans le ' || arrondissement || CASE WHEN arrondissement = 1 THEN 'er' ELSE 'e' END || ' arrondissement (à ' || printf('%.1f', {_KM.format(a='48.8566e0', b='2.3522e0')})
  || ' km du centre) est estimé à **' || {_EURO.format('p')} || ' €/m²**.', 'Facteurs valorisants : ' || {_factors('>', '+')} || '.', 'Facteurs pénalisants : ' || {_factors('<', '')} || '.') AS xai_summary
 FROM ranked)
SELECT * FROM priced UNION ALL BY NAME SELECT {', '.join(_KEYS)}, errors, latitude, longitude FROM checked WHERE errors <> ''""",
    digits={"latitude longitude": 6},
)
def priced_requests(spark, d):
    done = Q.price_requests(V.requests(spark, d), line_model(spark, d), V.enriched(spark, d), as_of=F.lit(AS_OF).cast("date"))
    return done.select(
        *_KEYS, F.array_join("errors", ",").alias("errors"), "snapped", "latitude", "longitude", "dist_metro_m", "nb_parks", *_PRICES, "is_hidden_gem",
        F.array_join(F.transform("contributions", lambda c: c["feature"]), ",").alias("factors"), "xai_summary",
    )


_SCORES = ["prix_predit_m2", "prix_predit", "prix_affiche_m2", "gem_score", "gain_potentiel"]


@query(
    views="listings train test",
    sql=f"""WITH {FIT_SQL},
scored AS (SELECT l.*, my + bx * (surface - mx) + bz * (coalesce(district_recent, g) - mz) AS p, prix_annonce * (1 - 0.07e0) AS net
 FROM listings l CROSS JOIN g CROSS JOIN line LEFT JOIN r_arr USING (arrondissement))
SELECT id_mutation, arrondissement, surface, prix_annonce, p AS prix_predit_m2, p * surface AS prix_predit, prix_annonce / surface AS prix_affiche_m2,
 (p - net / surface) / p AS gem_score, p * surface - net AS gain_potentiel FROM scored""",
    digits={"prix_predit_m2 prix_predit prix_affiche_m2 gain_potentiel": 3, "gem_score": 7},
)
def listing_scores_model(spark, d):
    """Listings scored by a model's price instead of the fixed one of their district."""
    scored = Q.score_by_model(V.listings(spark, d), line_model(spark, d), 2025)
    return scored.select("id_mutation", "arrondissement", "surface", "prix_annonce", *_SCORES)


_PAGE_COLUMNS = [
    "pieces", "latitude", "longitude", "vision_score", "prix_m2_predit", "prix_corrige_m2", "prix_net_m2", "negotiation_margin", "gem_score", "prix_predit_total", "gain_potentiel",
]


@query(
    views="listing_pages vision_answers train test",
    sql=f"""WITH {FIT_SQL}, {_VISION_SQL},
answers AS (SELECT listing_id AS page_id, CAST(round_even(avg(renovation_score), 0) AS INT) AS vision_score, arg_min(luminosite, photo_index) AS luminosite,
 arg_min(hauteur_plafond, photo_index) AS hauteur_plafond, arg_min(qualite_generale, photo_index) AS qualite_generale FROM vs GROUP BY 1),
{analysis_sql("answers", "my + bx * (surface - mx) + bz * (coalesce(district_recent, g) - mz)", "CROSS JOIN g CROSS JOIN line LEFT JOIN r_arr USING (arrondissement)",
              "round_even(bx * (surface - mx), 0) AS cs, round_even(bz * (coalesce(district_recent, g) - mz), 0) AS cv,")},
done AS (SELECT *, CASE WHEN abs(cs) >= abs(cv) THEN 'surface_reelle_bati,voie_recent_prix_m2' ELSE 'voie_recent_prix_m2,surface_reelle_bati' END AS factors FROM adjusted)
SELECT page_id, status, missing, {", ".join(f"CASE WHEN status = 'complete' THEN {c} END AS {c}" if c in ("prix_m2_predit", "prix_corrige_m2", "prix_net_m2", "gem_score", "prix_predit_total", "gain_potentiel") else c for c in _PAGE_COLUMNS)},
 CASE WHEN status = 'complete' THEN factors END AS factors FROM done""",
    digits={"prix_m2_predit prix_corrige_m2 prix_net_m2": 3, "gem_score latitude longitude": 6},
)
def listing_analysis_model(spark, d):
    """Pages priced by a model, corrected by what the photos show, with the strongest factors."""
    model = line_model(spark, d)
    answers = E.vision_by_listing(V.vision_answers(spark, d)).withColumnRenamed("listing_id", "page_id")
    done = analyse_pages(V.listing_pages(spark, d), F.lit(PAGES_AS_OF), lambda rows: Q.predict_listings(rows, model, 2025), answers)
    factors = F.array_join(F.transform("contributions", lambda c: c["feature"]), ",")
    return done.select("page_id", "status", F.array_join("missing", ",").alias("missing"), *_PAGE_COLUMNS, factors.alias("factors"))
