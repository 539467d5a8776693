"""Queries over points of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.functions.geo import bounding_box_area
from parvis.operators import proximity as P

_D = """2 * 6371000.0e0 * asin(sqrt(power(sin(radians(plat - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians(plat)) * power(sin(radians(plon - longitude) / 2), 2)))"""
# brute force: every distinct point against every place
_PAIRS = f"""spots AS (SELECT DISTINCT latitude, longitude FROM clean),
pairs AS (SELECT * FROM (SELECT s.latitude, s.longitude, kind, area_m2, {_D} AS d FROM spots s CROSS JOIN places) WHERE d <= 1000),
found AS (SELECT latitude, longitude, min(d) FILTER (kind = 'AUTOMOBILE') AS dist_metro_m, min(d) FILTER (kind = 'BUILDING') AS dist_park_m,
 min(d) FILTER (kind = 'FURNITURE') AS dist_school_m, min(d) FILTER (kind = 'HOUSEHOLD') AS dist_supermarket_m,
 count(*) FILTER (kind = 'AUTOMOBILE' AND d <= 500) AS transit_count_500m, count(*) FILTER (kind = 'AUTOMOBILE' AND d <= 300) AS transport_count_300m,
 count(*) FILTER (kind = 'MACHINERY' AND d <= 300) AS commerce_count_300m, count(*) FILTER (kind = 'FURNITURE' AND d <= 500) AS school_count_500m,
 coalesce(sum(area_m2) FILTER (kind = 'BUILDING' AND d <= 500), 0.0e0) AS park_area_500m_m2 FROM pairs GROUP BY 1, 2)"""
_DISTANCES = ["dist_metro_m", "dist_park_m", "dist_school_m", "dist_supermarket_m"]
_COUNTS = ["transit_count_500m", "transport_count_300m", "commerce_count_300m", "school_count_500m"]


def _features(spark, d):
    return P.with_place_features(V.clean(spark, d), V.places(spark, d))


@query(
    views="clean places",
    sql=f"WITH {_PAIRS} SELECT id_mutation, {', '.join(_DISTANCES)} FROM clean LEFT JOIN found USING (latitude, longitude)",
    digits={" ".join(_DISTANCES): 3},
)
def poi_nearest(spark, d):
    return _features(spark, d).select("id_mutation", *_DISTANCES)


@query(
    views="clean places",
    sql=f"""WITH {_PAIRS} SELECT id_mutation, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTS)}, coalesce(park_area_500m_m2, 0.0e0) AS park_area_500m_m2
FROM clean LEFT JOIN found USING (latitude, longitude)""",
    digits={"park_area_500m_m2": 3},
)
def poi_counts(spark, d):
    return _features(spark, d).select("id_mutation", *_COUNTS, "park_area_500m_m2")


def _part(col: str, points: int, reach: int) -> str:
    return f"CASE WHEN {col} IS NULL THEN 0.0e0 ELSE {points}.0e0 * greatest(0.0e0, 1 - {col} / {reach}.0e0) END"


@query(
    views="clean places",
    sql=f"""WITH {_PAIRS} SELECT id_mutation, {_part('dist_metro_m', 40, 1000)} + {_part('dist_park_m', 20, 800)} + {_part('dist_school_m', 20, 600)}
 + {_part('dist_supermarket_m', 20, 500)} AS walkability_score FROM clean LEFT JOIN found USING (latitude, longitude)""",
    digits={"walkability_score": 2},
)
def walkability(spark, d):
    return _features(spark, d).select("id_mutation", "walkability_score")


@query(
    views="clean",
    sql="""SELECT id_mutation, 2 * 6371.0e0 * asin(sqrt(power(sin(radians(48.8566e0 - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians(48.8566e0)) * power(sin(radians(2.3471e0 - longitude) / 2), 2))) AS dist_centre_paris_km FROM clean""",
    digits={"dist_centre_paris_km": 6},
)
def distance_to_centre(spark, d):
    from parvis.functions.geo import haversine

    return V.clean(spark, d).select("id_mutation", haversine("latitude", "longitude", *C.CENTER_POI).alias("dist_centre_paris_km"))


@query(
    views="places",
    sql="""SELECT place_id, kind = 'AUTOMOBILE' AS is_transit, kind = 'BUILDING' AS is_park, kind = 'FURNITURE' AS is_school,
 kind = 'HOUSEHOLD' AS is_market, kind = 'MACHINERY' AS is_commerce, false AS is_heritage, false AS is_nuisance FROM places""",
)
def poi_classes(spark, d):
    kept = ["is_transit", "is_park", "is_school", "is_market", "is_commerce", "is_heritage", "is_nuisance"]
    return V.places(spark, d).select("place_id", *kept)


_BOX = "plat", "plon", "plat + (place_id % 9) * 0.0003e0", "plon + (place_id % 7) * 0.0004e0"


def _metres(a: str, b: str, c: str, e: str) -> str:
    return f"""(2 * 6371000.0e0 * asin(sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({e} - {b}) / 2), 2))))"""


@query(
    views="places",
    sql=f"SELECT place_id, {_metres(_BOX[0], _BOX[1], f'({_BOX[2]})', _BOX[1])} * {_metres(_BOX[0], _BOX[1], _BOX[0], f'({_BOX[3]})')} AS area_m2 FROM places",
    digits={"area_m2": 2},
)
def park_area(spark, d):
    box = [F.expr(e) for e in _BOX]
    return V.places(spark, d).select("place_id", bounding_box_area(*box).alias("area_m2"))


@query(
    views="clean enriched",
    sql="""WITH e AS (SELECT * FROM (SELECT *, CAST(round_even(lat_grid / 0.005e0, 0) AS BIGINT) AS cy, CAST(round_even(lon_grid / 0.005e0, 0) AS BIGINT) AS cx,
 row_number() OVER (PARTITION BY round_even(lat_grid / 0.005e0, 0), round_even(lon_grid / 0.005e0, 0) ORDER BY place_id) AS rn FROM enriched) WHERE rn = 1),
c AS (SELECT id_mutation, CAST(round_even(latitude / 0.005e0, 0) AS BIGINT) AS cy, CAST(round_even(longitude / 0.005e0, 0) AS BIGINT) AS cx FROM clean)
SELECT id_mutation, coalesce(nb_restaurants, 102.0e0) AS nb_restaurants, coalesce(nb_transport, 28.0e0) AS nb_transport, coalesce(nb_parks, 6.0e0) AS nb_parks,
 coalesce(walkability_score, 43.0e0) AS walkability_score, coalesce(dist_metro_m, 214.0e0) AS dist_metro_m, coalesce(nb_ecoles, 9.0e0) AS nb_ecoles
FROM c LEFT JOIN e USING (cy, cx)""",
)
def grid_enrichment(spark, d):
    rows = P.enrich_by_cell(V.clean(spark, d), V.enriched(spark, d), ["place_id"])
    return rows.select("id_mutation", *C.POI_FEATURES)
