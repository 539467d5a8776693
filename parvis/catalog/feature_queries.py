"""Queries over encodings, recent prices and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.operators import encodings as enc
from parvis.operators import features
from parvis.operators.recent import with_trailing_median


def _train(spark, d):
    return features.split_train_test(V.clean(spark, d))[0]


@query(
    views="clean",
    sql="""SELECT CASE WHEN (id_mutation * 7919) % 100 >= 80 THEN 'test'
 WHEN (CAST(floor(id_mutation / 100) AS BIGINT) % 100 * 7919) % 100 < 10 THEN 'validation' ELSE 'train' END AS part, id_mutation FROM clean""",
)
def stable_split(spark, d):
    sales = V.clean(spark, d)
    part = F.when(features.train_bucket(sales) >= 80, "test").when(features.validation_flag(sales), "validation").otherwise("train")
    return sales.select(part.alias("part"), "id_mutation")


@query(views="clean", sql="SELECT id_mutation, CAST(((CAST(floor(id_mutation / 100) AS BIGINT) % 100 * 7919) % 100) % 5 AS INT) AS fold FROM clean")
def stable_folds(spark, d):
    sales = V.clean(spark, d)
    return sales.select("id_mutation", features.fold_number(sales).alias("fold"))


@query(
    views="train",
    sql="SELECT arrondissement, avg(prix_m2) AS arr_enc FROM train GROUP BY 1",
    digits={"arr_enc": 4},
)
def district_encoding(spark, d):
    return enc.plain_encoding(_train(spark, d), ["arrondissement"], "arr_enc")


_SMOOTH = "(count(prix_m2) * avg(prix_m2) + 10 * (SELECT avg(prix_m2) FROM train)) / (count(prix_m2) + 10)"
_GRID = "CAST(round_even(coalesce(latitude, 48.8566e0) * 100, 0) AS BIGINT) AS grid_lat, CAST(round_even(coalesce(longitude, 2.3522e0) * 100, 0) AS BIGINT) AS grid_lon"


@query(views="train", sql=f"SELECT arrondissement, {_SMOOTH} AS arr_enc FROM train GROUP BY 1", digits={"arr_enc": 4})
def district_encoding_smoothed(spark, d):
    return enc.smoothed_encoding(_train(spark, d), ["arrondissement"], "arr_enc")


@query(views="train", sql=f"SELECT adresse_code_voie, {_SMOOTH} AS voie_enc FROM train GROUP BY 1", digits={"voie_enc": 4})
def street_encoding_smoothed(spark, d):
    return enc.smoothed_encoding(_train(spark, d), ["adresse_code_voie"], "voie_enc")


@query(views="train", sql=f"SELECT {_GRID}, {_SMOOTH} AS grid_enc FROM train GROUP BY 1, 2", digits={"grid_enc": 4})
def grid_encoding_smoothed(spark, d):
    return enc.smoothed_encoding(_train(spark, d), enc.GRID_KEYS, "grid_enc")


_CUT = "(SELECT max(date_mutation) - INTERVAL 12 MONTH FROM train)"


@query(
    views="train",
    sql=f"SELECT adresse_code_voie, quantile_cont(prix_m2, 0.5) AS street_recent FROM train WHERE date_mutation >= {_CUT} GROUP BY 1",
    digits={"street_recent": 4},
)
def recent_lookup_street(spark, d):
    return enc.recent_street_medians(_train(spark, d))


@query(
    views="train",
    sql=f"SELECT arrondissement, quantile_cont(prix_m2, 0.5) AS district_recent FROM train WHERE date_mutation >= {_CUT} GROUP BY 1",
    digits={"district_recent": 4},
)
def recent_lookup_district(spark, d):
    return enc.recent_district_medians(_train(spark, d))


_TRAILING = """median(prix_m2) OVER (PARTITION BY adresse_code_voie ORDER BY date_mutation
  RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""


@query(
    views="clean",
    sql=f"SELECT id_mutation, adresse_code_voie, {_TRAILING} AS voie_recent_prix_m2 FROM clean",
    digits={"voie_recent_prix_m2": 4},
)
def street_trailing_median(spark, d):
    return with_trailing_median(V.clean(spark, d)).select("id_mutation", "adresse_code_voie", "voie_recent_prix_m2")


_LOOKUPS = f"""g AS (SELECT avg(prix_m2) AS g FROM train),
e_arr AS (SELECT arrondissement, {{arr}} AS arr_enc FROM train GROUP BY 1),
e_voie AS (SELECT adresse_code_voie, {_SMOOTH} AS voie_enc FROM train GROUP BY 1),
e_grid AS (SELECT {_GRID}, {_SMOOTH} AS grid_enc FROM train GROUP BY 1, 2),
r_voie AS (SELECT adresse_code_voie, quantile_cont(prix_m2, 0.5) AS street_recent FROM train WHERE date_mutation >= {_CUT} GROUP BY 1),
r_arr AS (SELECT arrondissement, quantile_cont(prix_m2, 0.5) AS district_recent FROM train WHERE date_mutation >= {_CUT} GROUP BY 1)"""

# keys that meet every level of the fallback: some rows are moved to unknown streets, cells and districts
_MOVED = """moved AS (SELECT id_mutation, CASE WHEN id_mutation % 11 = 0 THEN 42 ELSE arrondissement END AS arrondissement,
 CASE WHEN id_mutation % 3 = 0 THEN 'inconnue' ELSE adresse_code_voie END AS adresse_code_voie,
 CASE WHEN id_mutation % 2 = 0 THEN latitude + 1.0e0 ELSE latitude END AS latitude, longitude FROM test)"""


def _moved(spark, d):
    test = features.split_train_test(V.clean(spark, d))[1]
    key = F.col("id_mutation")
    return test.withColumns(
        {
            "code_postal": F.when(key % 11 == 0, F.lit(75042.0)).otherwise(F.col("code_postal")),
            "adresse_code_voie": F.when(key % 3 == 0, "inconnue").otherwise(F.col("adresse_code_voie")),
            "latitude": F.when(key % 2 == 0, F.col("latitude") + 1.0).otherwise(F.col("latitude")),
        }
    )


@query(
    views="train test",
    sql=f"""WITH {_LOOKUPS.format(arr=_SMOOTH)}, {_MOVED}, m AS (SELECT *, {_GRID} FROM moved),
j AS (SELECT id_mutation, coalesce(arr_enc, g) AS arr_target_enc, voie_enc, grid_enc FROM m CROSS JOIN g
 LEFT JOIN e_arr USING (arrondissement) LEFT JOIN e_voie USING (adresse_code_voie) LEFT JOIN e_grid USING (grid_lat, grid_lon))
SELECT id_mutation, arr_target_enc, coalesce(voie_enc, arr_target_enc) AS voie_target_enc,
 coalesce(grid_enc, voie_enc, arr_target_enc) AS grid_target_enc FROM j""",
    digits={"arr_target_enc voie_target_enc grid_target_enc": 4},
)
def encoding_fallback_chain(spark, d):
    tables = enc.fit_encodings(_train(spark, d), smoothed=True, fine=True)
    return enc.attach_encodings(_moved(spark, d), tables).select(
        "id_mutation", "arr_target_enc", "voie_target_enc", "grid_target_enc"
    )


@query(
    views="train test",
    sql=f"""WITH {_LOOKUPS.format(arr="avg(prix_m2)")}, {_MOVED}
SELECT id_mutation, coalesce(street_recent, district_recent, g) AS voie_recent_prix_m2 FROM moved CROSS JOIN g
 LEFT JOIN r_voie USING (adresse_code_voie) LEFT JOIN r_arr USING (arrondissement)""",
    digits={"voie_recent_prix_m2": 4},
)
def recent_fallback_chain(spark, d):
    tables = enc.fit_encodings(_train(spark, d))
    return enc.attach_recent(_moved(spark, d), tables).select("id_mutation", "voie_recent_prix_m2")


_AREA = "greatest(surface_reelle_bati, 1.0e0)"
_ROOMS = "CAST(greatest(coalesce(nombre_pieces_principales, 2), 1) AS DOUBLE)"
_LAT, _LON = "coalesce(latitude, 48.8566e0)", "coalesce(longitude, 2.3522e0)"
_DIST = f"""(2 * 6371.0e0 * asin(sqrt(power(sin(radians(48.8566e0 - {_LAT}) / 2), 2)
  + cos(radians({_LAT})) * cos(radians(48.8566e0)) * power(sin(radians(2.3522e0 - {_LON}) / 2), 2))))"""
_PREMIUM = "CASE WHEN arrondissement IN (1, 2, 3, 4, 6, 7, 8, 16, 17) THEN 1.0e0 ELSE 0.0e0 END"
_FEATURE_SQL = f"""ln(1 + {_AREA}) AS log_surface, surface_reelle_bati, {_ROOMS} AS nombre_pieces_principales,
 least(greatest({_ROOMS} / {_AREA}, 0.005e0), 0.5e0) AS pieces_per_m2, least(greatest({_AREA} / {_ROOMS}, 5.0e0), 500.0e0) AS surface_per_piece,
 CASE WHEN coalesce(lot1_surface_carrez, 0) > 0 THEN least(greatest(lot1_surface_carrez / {_AREA}, 0.5e0), 2.0e0) ELSE 1.0e0 END AS carrez_ratio,
 CAST(arrondissement AS DOUBLE) AS arrondissement, arr_target_enc, {_PREMIUM} AS is_premium_arr, {_DIST} AS dist_center_km,
 voie_target_enc, grid_target_enc, voie_recent_prix_m2, longitude, latitude,
 {_LAT} * {_LAT} AS lat_sq, {_LON} * {_LON} AS lon_sq, {_LAT} * {_LON} AS lat_lon_cross,
 arr_target_enc * ln(1 + {_AREA}) AS arr_price_x_log_surface, {_PREMIUM} * ln(1 + {_AREA}) AS premium_x_log_surface,
 {_PREMIUM} * {_DIST} AS premium_x_dist_center, voie_recent_prix_m2 * least(greatest({_ROOMS} / {_AREA}, 0.005e0), 0.5e0) AS voie_x_density,
 CAST(annee AS DOUBLE) AS annee, CAST(mois AS DOUBLE) AS mois, CAST(trimestre AS DOUBLE) AS trimestre, CAST(nombre_lots AS DOUBLE) AS nombre_lots, prix_m2"""
_FEATURE_DIGITS = {
    "log_surface pieces_per_m2 surface_per_piece carrez_ratio dist_center_km longitude latitude lat_sq lon_sq lat_lon_cross premium_x_log_surface premium_x_dist_center": 6,
    "arr_target_enc voie_target_enc grid_target_enc voie_recent_prix_m2 arr_price_x_log_surface voie_x_density": 3,
}


@query(
    views="train test",
    sql=f"""WITH {_LOOKUPS.format(arr=_SMOOTH)}, m AS (SELECT *, {_GRID} FROM test),
j AS (SELECT m.*, coalesce(arr_enc, g) AS arr_target_enc, coalesce(voie_enc, arr_enc, g) AS voie_target_enc,
 coalesce(grid_enc, voie_enc, arr_enc, g) AS grid_target_enc, coalesce(street_recent, district_recent, g) AS voie_recent_prix_m2
 FROM m CROSS JOIN g LEFT JOIN e_arr USING (arrondissement) LEFT JOIN e_voie USING (adresse_code_voie) LEFT JOIN e_grid USING (grid_lat, grid_lon)
 LEFT JOIN r_voie USING (adresse_code_voie) LEFT JOIN r_arr USING (arrondissement))
SELECT id_mutation, {_FEATURE_SQL} FROM j""",
    digits=_FEATURE_DIGITS,
)
def feature_frame(spark, d):
    train, test = features.split_train_test(V.clean(spark, d))
    tables = enc.fit_encodings(train, smoothed=True, fine=True)
    return features.feature_matrix(test, tables, keep=["id_mutation"])


@query(
    views="train test",
    sql=f"""WITH {_LOOKUPS.format(arr="avg(prix_m2)")},
seen AS (SELECT *, {_TRAILING} AS trail FROM train),
rows AS (SELECT s.* EXCLUDE (trail), 'train' AS part, coalesce(trail, g) AS voie_recent_prix_m2 FROM seen s CROSS JOIN g
 UNION ALL SELECT t.*, 'test' AS part, coalesce(street_recent, district_recent, g) AS voie_recent_prix_m2 FROM test t CROSS JOIN g
 LEFT JOIN r_voie USING (adresse_code_voie) LEFT JOIN r_arr USING (arrondissement)),
j AS (SELECT rows.*, coalesce(arr_enc, g) AS arr_target_enc, coalesce(arr_enc, g) AS voie_target_enc, coalesce(arr_enc, g) AS grid_target_enc
 FROM rows CROSS JOIN g LEFT JOIN e_arr USING (arrondissement))
SELECT part, id_mutation, {_FEATURE_SQL} FROM j""",
    digits=_FEATURE_DIGITS,
)
def training_frame(spark, d):
    train, test, _ = features.training_frame(V.clean(spark, d))
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


@query(
    views="clean",
    sql="""SELECT id_mutation, 214.0e0 AS dist_metro_m, CASE WHEN id_mutation % 2 = 0 THEN 43.0e0 ELSE CAST(id_mutation % 90 AS DOUBLE) END AS walkability_score,
 102.0e0 AS nb_restaurants, 28.0e0 AS nb_transport, 6.0e0 AS nb_parks, 9.0e0 AS nb_ecoles FROM clean""",
)
def place_defaults(spark, d):
    key = F.col("id_mutation")
    sales = V.clean(spark, d).withColumn("walkability_score", F.when(key % 2 != 0, (key % 90).cast("double")))
    return features.fill_poi_defaults(sales).select("id_mutation", *C.POI_DEFAULTS)
