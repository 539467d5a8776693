"""Cleaning, quantiles, trailing medians, splits, features: against brute force."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.operators import cleaning, encodings, evaluation, features, outliers, recent
from parvis.operators.quantiles import group_quantiles

DAY0 = dt.date(2020, 1, 1)


def sales(spark, n=900, seed=1, hot=0.4):
    """Sales where one street holds a large share of the rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        street = "HOT" if rnd.random() < hot else rnd.choice(["A", "B", "C", None])
        area = rnd.choice([20.0, 35.0, 64.0])
        rows.append((i, DAY0 + dt.timedelta(days=rnd.randint(0, 1500)), round(rnd.gauss(9000, 2500) * area + 20 * area, 2), area,
                     rnd.randint(1, 5), "Appartement", 48.82 + rnd.random() / 10, 2.27 + rnd.random() / 10, 75001.0 + rnd.randint(0, 19), street, 1))
    raw = spark.createDataFrame(
        rows, "id_mutation long, date_mutation date, valeur_fonciere double, surface_reelle_bati double, nombre_pieces_principales int,"
        " type_local string, latitude double, longitude double, code_postal double, adresse_code_voie string, nombre_lots int",
    )
    return cleaning.clean_sales(raw)


def test_names_types_and_missing_columns(spark):
    raw = spark.createDataFrame(
        [("a", "2023-05-06", "300000", "30,5", "3", "Appartement"), ("b", "jamais", "x", "NaN", "2.0", None)],
        ["IDMutation", " DateMutation ", "ValeurFonc", "SBati", "NbpPrinc", "LibTypLocMut"],
    )
    a, b = raw.transform(cleaning.normalise_names).transform(cleaning.coerce_types).orderBy("id_mutation").collect()
    assert (a.date_mutation, a.valeur_fonciere, a.surface_reelle_bati, a.nombre_pieces_principales) == (dt.date(2023, 5, 6), 300000.0, None, 3)
    assert (b.date_mutation, b.valeur_fonciere, b.surface_reelle_bati, b.nombre_pieces_principales) == (None, None, None, 2)
    assert a.latitude is None and a.lot5_surface_carrez is None


def test_bounds_are_inclusive_and_null_fails(spark):
    rows = [(10_000.0, 5.0), (9_999.0, 4.9), (100_000.0, 50.0), (99_999.0, 50.0), (None, 50.0), (2_500_000.0, 50.0), (2_500_001.0, 50.0), (20_000.0, 0.0)]
    kept = spark.createDataFrame(rows, "valeur_fonciere double, surface_reelle_bati double").transform(cleaning.within_hard_bounds)
    assert sorted(r.valeur_fonciere for r in kept.collect()) == [10_000.0, 100_000.0, 2_500_000.0]


def test_dedup_does_not_depend_on_partitions(spark):
    rows = [(i % 7, i, f"v{i}") for i in range(300)] + [(99, i, f"h{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id_mutation long, o int, v string")
    results = [sorted(map(tuple, cleaning.first_per_key(df.repartition(p), "id_mutation", ["o"]).collect())) for p in (1, 3, 11)]
    assert results[0] == results[1] == results[2]
    assert results[0][-1] == (99, 0, "h0") and len(results[0]) == 8


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1)], "id_mutation long, o int")
    plan = cleaning.first_per_key(df, "id_mutation", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("bounded,continuous,crowded", [(True, False, 0), (False, False, 0), (False, True, 0), (True, True, 0), (False, False, 100), (False, False, 10_000)])
def test_group_quantiles_match_numpy(spark, bounded, continuous, crowded):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([7.0, 7.0, 7.0, 12.5, -3.0, 0.0]) if rnd.random() < 0.6 else rnd.gauss(0, 1000)) for _ in range(2500)]
    rows += [("small", float(i)) for i in range(4)] + [("one", 5.0), ("nulls", None), (None, 3.0)]
    probs = {"p00": 0.0, "p15": 0.15, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", probs, bounded, continuous, crowded).collect()}
    assert sorted(got) == ["hot", "one", "small"]
    for key, row in got.items():
        values = [v for k, v in rows if k == key]
        assert row.n == len(values)
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9), (key, name)
    overall = group_quantiles(df, [], "v", {"m": 0.5}, continuous=continuous).first()
    assert overall.m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_group_quantiles_count_once(spark):
    """Both uses of the value counts read one shuffle, and no group is held whole."""
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    q = group_quantiles(df, ["k"], "v", {"m": 0.5}, bounded_keys=True)
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "ObjectHashAggregate" not in plan


def brute_trailing(pdf, days=365):
    out = {}
    for r in pdf.itertuples():
        if r.adresse_code_voie is None:
            out[r.id_mutation] = None
            continue
        seen = pdf[(pdf.adresse_code_voie == r.adresse_code_voie) & (pdf.date_mutation < r.date_mutation)
                   & (pdf.date_mutation >= r.date_mutation - dt.timedelta(days=days))]
        out[r.id_mutation] = float(seen.prix_m2.median()) if len(seen) else None
    return out


@pytest.mark.parametrize("hot_rows", [0, 150, 10_000])
def test_trailing_median(spark, hot_rows):
    """Same result whether blocks go the ordinary way, the crowded way or both."""
    df = sales(spark)
    pdf = df.select("id_mutation", "date_mutation", "adresse_code_voie", "prix_m2").toPandas()
    want = brute_trailing(pdf)
    got = {r.id_mutation: r.voie_recent_prix_m2 for r in recent.with_trailing_median(df, hot_rows=hot_rows).collect()}
    assert got.keys() == want.keys()
    assert sum(v is not None for v in want.values()) > 500
    for key, value in want.items():
        assert got[key] == (pytest.approx(value) if value is not None else None)


def test_split_is_stable(spark):
    df = sales(spark)
    a = {r.id_mutation for r in features.split_train_test(df)[0].collect()}
    b = {r.id_mutation for r in features.split_train_test(df.repartition(9))[0].collect()}
    assert a == b and 0.7 < len(a) / df.count() < 0.9
    words = df.select(F.concat(F.lit("m"), "id_mutation").alias("id_mutation"), "prix_m2")
    train, test = features.split_train_test(words)
    assert train.count() + test.count() == words.count() and test.count() > 0


def test_no_leakage(spark):
    """Changing the targets of test rows changes no feature of any row."""
    df = sales(spark)
    held_out = features.train_bucket(df) >= 80
    changed = df.withColumn("prix_m2", F.when(held_out, F.col("prix_m2") * 3).otherwise(F.col("prix_m2")))

    def frames(x):
        train, test, _ = features.training_frame(x, smoothed=True, fine=True)
        return [sorted(map(tuple, part.drop("prix_m2").collect())) for part in (train, test)]

    for a, b in zip(frames(df), frames(changed)):
        assert [r[0] for r in a] == [r[0] for r in b]
        assert np.allclose(np.array(a, dtype=float), np.array(b, dtype=float))


BASE = dict(code_postal=75011.0, surface_reelle_bati=65.0, nombre_pieces_principales=3, latitude=48.853, longitude=2.3698, annee=2024, mois=6,
            trimestre=2, nombre_lots=1, prix_m2=10000.0, lot1_surface_carrez=None, adresse_code_voie=None)
SCHEMA = ("code_postal double, surface_reelle_bati double, nombre_pieces_principales int, latitude double, longitude double, annee int, mois int,"
          " trimestre int, nombre_lots int, prix_m2 double, lot1_surface_carrez double, adresse_code_voie string")


def featured(spark, enc=None, **change):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)
    df = df.withColumns({f"lot{i}_surface_carrez": F.lit(None).cast("double") for i in range(2, 6)})
    return features.featurise(df, enc or encodings.Encodings(overall=9999.0)).first()


def test_feature_row(spark):
    row = featured(spark)
    assert all(c in row.asDict() for c in C.FEATURES)
    assert row.log_surface == pytest.approx(np.log1p(65.0)) and row.arrondissement == 11
    assert 0.5 < row.dist_center_km < 3.0 and row.carrez_ratio == 1.0
    assert row.voie_recent_prix_m2 == 9999.0 and row.arr_target_enc == row.grid_target_enc == 9999.0
    assert (row.dist_metro_m, row.walkability_score) == (214.0, 43.0)
    assert featured(spark, lot1_surface_carrez=60.0).carrez_ratio == pytest.approx(60 / 65)
    assert featured(spark, code_postal=75006.0).is_premium_arr == 1 and featured(spark, code_postal=75013.0).is_premium_arr == 0
    assert featured(spark, surface_reelle_bati=1.0, nombre_pieces_principales=100).pieces_per_m2 <= 0.5


def test_encoding_hit_and_miss(spark):
    enc = encodings.Encodings(overall=9000.0, district=spark.createDataFrame([(11, 10500.0)], "arrondissement int, arr_enc double"))
    assert featured(spark, enc).arr_target_enc == 10500.0
    assert featured(spark, enc, code_postal=75099.0).arr_target_enc == 9000.0


def test_outlier_rule_null_is_not_bad(spark):
    rows = [(1, 40_000.0, 75011.0, 30.0, 2, 9000.0), (2, 900_000.0, 75007.0, 30.0, 2, 2999.0), (3, 900_000.0, 75011.0, 30.0, 2, 2999.0),
            (4, 900_000.0, 75011.0, 8.0, 3, 9000.0), (5, 900_000.0, 75011.0, 30.0, 2, 1499.0), (6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id_mutation int, valeur_fonciere double, code_postal double, surface_reelle_bati double, nombre_pieces_principales int, prix_m2 double")
    got = {r.id_mutation: r.category for r in outliers.label_outliers(df).collect()}
    assert got == {1: "bad", 2: "bad", 3: "rare", 4: "bad", 5: "bad", 6: "rare"}


def test_iqr_filter_matches_pandas(spark):
    df = sales(spark)
    pdf = df.toPandas()
    pdf["a"] = (pdf.code_postal % 100).astype(int)
    q = pdf.groupby("a").prix_m2.quantile([0.25, 0.75]).unstack()
    low, high = q[0.25] - (q[0.75] - q[0.25]), q[0.75] + (q[0.75] - q[0.25])
    want = set(pdf[pdf.prix_m2.between(pdf.a.map(low), pdf.a.map(high))].id_mutation)
    assert {r.id_mutation for r in outliers.iqr_filter_by_district(df, 1.0).collect()} == want


def test_scorecard(spark):
    y, p = [1.0, 2.0, 4.0, 0.0], [1.5, 1.5, 5.0, 1.0]
    df = spark.createDataFrame(list(zip(y, p)), "prix_reel double, prix_predit double")
    card = evaluation.scorecard(df).first()
    e = np.array(p) - np.array(y)
    assert card.MAE == pytest.approx(np.abs(e).mean()) and card.RMSE == pytest.approx(np.sqrt((e**2).mean()))
    assert card.R2 == pytest.approx(1 - (e**2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum())
    assert card.MAPE == pytest.approx(np.mean([0.5, 0.25, 0.25]) * 100)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(15.0,), (15.1,), (30.0,), (0.0,), (1000.0,), (1001.0,)], "x double")
    right = [r[0] for r in df.select(evaluation.segment("x", C.AREA_BUCKETS, True)).collect()]
    left = [r[0] for r in df.select(evaluation.segment("x", C.AREA_SEGMENTS)).collect()]
    assert right == ["<15m2", "15-30", "15-30", None, ">200m2", None]
    assert left == ["<30m2", "<30m2", "30-60m2", "<30m2", ">100m2", ">100m2"]


def test_upsert_keeps_order(spark):
    history = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2)], "model string, MAE double, position int")
    new = spark.createDataFrame([("a", 0.5), ("d", 4.0), ("c", 3.0)], "model string, MAE double")
    rows = evaluation.upsert_metrics(history, new).orderBy("position").collect()
    assert [(r.model, r.MAE) for r in rows] == [("a", 0.5), ("b", 2.0), ("c", 3.0), ("d", 4.0)]


def test_request_validation(spark):
    ok = dict(surface=65.0, pieces=3, arrondissement=11, latitude=48.853, longitude=2.3698, annee=None, mois=6, trimestre=2, nombre_lots=1, prix_affiche=None)
    schema = "surface double, pieces int, arrondissement int, latitude double, longitude double, annee int, mois int, trimestre int, nombre_lots int, prix_affiche double"
    changes = [{}, {"surface": -10.0}, {"arrondissement": 25}, {"latitude": 40.0}, {"prix_affiche": 0.0, "mois": None}]
    df = spark.createDataFrame([tuple({**ok, **c}.values()) for c in changes], schema)
    assert [r.errors for r in cleaning.validate_requests(df).collect()] == [[], ["surface"], ["arrondissement"], ["latitude"], ["mois", "prix_affiche"]]
    valid, rejected = cleaning.split_valid(df)
    assert (valid.count(), rejected.count()) == (1, 4)


def test_sample_is_reproducible(spark):
    from parvis.operators.market import sample_rows

    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = {r.k for r in sample_rows(df, 500, "k").collect()}
    b = {r.k for r in sample_rows(df.repartition(13), 500, "k").collect()}
    assert a == b and len(a) == 500
    assert 6_000 < np.mean(list(a)) < 14_000
    assert sample_rows(spark.range(30).withColumnRenamed("id", "k"), 500, "k").count() == 30


