"""Requests and listings priced by a model: the cases of a pricing service, as rows of one table."""
import pytest
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.operators import features
from parvis.plans import requests as Q
from parvis.plans import training
from parvis.session import stage
from tests.test_sales import sales

BASE = dict(
    surface=50.0, pieces=2, arrondissement=11, latitude=48.8589, longitude=2.3796, annee=2024, mois=6, trimestre=2,
    nombre_lots=1, prix_affiche=None, adresse_code_voie=None,
)
SCHEMA = (
    "id string, surface double, pieces int, arrondissement int, latitude double, longitude double, annee int, mois int,"
    " trimestre int, nombre_lots int, prix_affiche double, adresse_code_voie string"
)


def table(spark, **cases):
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(i, *[{**BASE, **changes}[n] for n in names]) for i, changes in cases.items()], SCHEMA)


@pytest.fixture(scope="module")
def fitted(spark):
    df = sales(spark, n=2500, seed=4, hot=0.2)
    price = 9000 + 150 * F.pmod(F.col("code_postal"), F.lit(100)) + 10 * F.col("surface_reelle_bati") + F.pmod(F.xxhash64("id_mutation"), F.lit(600)) - 300
    df = stage(df.withColumn("prix_m2", F.round(price, 2)))
    train, test, enc = features.training_frame(df)
    train, test = stage(train), stage(test)
    return {
        "linear": training.fit(train, training.linear(), enc, held_out=test),
        "trees": training.fit(train, training.boosted_trees(iterations=15), enc, held_out=test),
        "street": df.groupBy("adresse_code_voie").count().orderBy(F.desc("count")).first()[0],
    }


CASES = {
    "base": {}, "cheap": {"prix_affiche": 200_000.0}, "dear": {"prix_affiche": 2_000_000.0}, "unknown": {"adresse_code_voie": "ZZZZ"},
    "far": {"latitude": 48.8636, "longitude": 2.2735}, "no_year": {"annee": None}, "first": {"arrondissement": 1, "latitude": 48.8603, "longitude": 2.3477},
    "area": {"surface": -10.0}, "district": {"arrondissement": 25}, "south": {"latitude": 40.0}, "several": {"surface": None, "mois": 13},
    "nan": {"surface": float("nan")}, "free": {"prix_affiche": 0.0},
}


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_cases(spark, fitted, kind):
    model = fitted[kind]
    rows = {r.id: r for r in Q.price_requests(table(spark, **CASES), model, as_of=F.lit("2024-03-01").cast("date")).collect()}
    assert set(rows) == set(CASES)
    base = rows["base"]
    assert base.errors == [] and 7_000 < base.prix_predit_m2 < 15_000
    assert base.prix_predit_total == pytest.approx(base.prix_predit_m2 * 50, rel=0.01)
    assert base.confidence_high - base.prix_predit_m2 == pytest.approx(model.rmse, abs=0.2) != C.BAND_HALF_WIDTH
    assert base.prix_predit_m2 - base.confidence_low == pytest.approx(model.rmse, abs=0.2)
    values = [c.value for c in base.contributions]
    assert len(values) == 8 and max(map(abs, values)) > 50 and values == sorted(values, key=lambda v: -abs(v)) and all(v == round(v) for v in values)
    assert base.gem_score is None and base.is_hidden_gem is False
    assert rows["cheap"].gem_score > 0.10 and rows["cheap"].is_hidden_gem
    assert rows["dear"].gem_score < 0 and not rows["dear"].is_hidden_gem
    assert rows["unknown"].prix_predit_m2 == base.prix_predit_m2
    assert rows["far"].snapped and (rows["far"].latitude, rows["far"].longitude) == C.CENTROIDS[11]
    assert abs(rows["far"].prix_predit_m2 - base.prix_predit_m2) < 1000
    assert rows["no_year"].prix_predit_m2 == base.prix_predit_m2 and rows["no_year"].annee is None
    assert "**" in base.xai_summary and "11e arrondissement (à 2.0 km" in base.xai_summary and "1er arrondissement" in rows["first"].xai_summary
    for name, errors in {
        "area": ["surface"], "district": ["arrondissement"], "south": ["latitude"], "several": ["surface", "mois"], "nan": ["surface"], "free": ["prix_affiche"],
    }.items():
        r = rows[name]
        assert r.errors == errors and r.prix_predit_m2 is None and r.contributions is None and r.xai_summary is None
    assert rows["south"].latitude == 40.0


def test_asking_price_and_street(spark, fitted):
    model = fitted["linear"]
    price = Q.price_requests(table(spark, a={}), model).first().prix_predit_m2
    rows = {r.id: r for r in Q.price_requests(table(spark, same={"prix_affiche": price * 50}, street={"adresse_code_voie": fitted["street"]}), model).collect()}
    assert 0.05 < rows["same"].gem_score < 0.10 and not rows["same"].is_hidden_gem
    assert rows["street"].prix_predit_m2 != price


def test_place_features_and_clashing_columns(spark, fitted):
    enriched = spark.createDataFrame(
        [(1, 48.86, 2.38, 11.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
        "place_id int, lat_grid double, lon_grid double, nb_restaurants double, nb_transport double, nb_parks double, walkability_score double, dist_metro_m double, nb_ecoles double",
    )
    given = table(spark, a={}, b={"latitude": 48.865, "longitude": 2.37}, bad={"pieces": 0}).withColumns(
        {c: F.lit("mine") for c in ("contributions", "prix_m2_predit", "code_postal", "_row", "dist_metro_m", "log_surface", "a b")}
    )
    rows = {r.id: r for r in Q.price_requests(given, fitted["linear"], enriched).collect()}
    assert rows["a"].dist_metro_m == 5.0 and rows["b"].dist_metro_m == C.POI_DEFAULTS["dist_metro_m"]
    assert rows["a"].code_postal == rows["a"].log_surface == rows["a"]._row == rows["a"]["a b"] == rows["bad"].prix_m2_predit == "mine"
    assert len(rows["a"].contributions) == 8 and rows["bad"].contributions is None and rows["bad"].errors == ["pieces"]
    plain = Q.price_requests(table(spark, a={}), fitted["linear"]).first()
    assert plain.prix_predit_m2 == rows["a"].prix_predit_m2


def test_repeated_and_no_rows(spark, fitted):
    base = table(spark, a={"prix_affiche": 1.0})
    twice = Q.price_requests(base.unionByName(base), fitted["linear"]).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    empty = Q.price_requests(base.where("false"), fitted["linear"])
    assert empty.count() == 0 and "prix_predit_m2" in empty.columns


def test_listings_by_model(spark, fitted):
    rows = spark.createDataFrame(
        [(1, 50.0, 2, 11, None, None, 300_000), (2, 50.0, 2, 11, 48.8590, 2.3790, 900_000), (3, None, 2, 11, None, None, 1), (4, 50.0, None, None, None, None, 1), (5, 50.0, 2, 11, None, None, None)],
        "id int, surface double, pieces int, arrondissement int, latitude double, longitude double, prix_annonce long",
    )
    done = {r.id: r for r in Q.score_by_model(rows, fitted["trees"], 2025).collect()}
    assert done[1].gem_score > 0.10 > done[2].gem_score and done[1].prix_predit_m2 == done[2].prix_predit_m2
    assert done[1].prix_predit == pytest.approx(done[1].prix_predit_m2 * 50) and len(done[1].contributions) == 3
    assert done[1].gain_potentiel == pytest.approx(done[1].prix_predit - 279_000)
    assert all(done[i].gem_score is None and done[i].prix_predit is None for i in (3, 4, 5)) and len(done) == 5


def test_line_model_reads_rows_written_once(spark, tmp_path, monkeypatch):
    from parvis.catalog import request_queries as R

    monkeypatch.setattr(R.V, "clean", lambda *_: sales(spark, 60))
    seen = {}
    monkeypatch.setattr(R.training, "fit", lambda train, *_, held_out: seen.update(train=train, test=held_out))
    R.line_model(spark, str(tmp_path))
    for rows in seen.values():
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
