"""Models by their properties; sources and sinks by round trips."""
import dataclasses
import functools
import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.operators import features, forest, market
from parvis.operators.evaluation import scorecard
from parvis.plans import experiments, explain, recommend, training
from parvis.session import stage
from parvis.sources import publish, tables
from tests.test_sales import sales


@pytest.fixture(scope="module")
def frames(spark):
    """Sales whose price follows area, district and distance, with noise."""
    df = sales(spark, n=2500, seed=4, hot=0.2)
    noise = F.pmod(F.xxhash64("id_mutation"), F.lit(1000)) - 500
    price = 6000 + 300 * F.pmod(F.col("code_postal"), F.lit(100)) + 40 * F.col("surface_reelle_bati") + noise
    df = stage(df.withColumn("prix_m2", F.round(price, 2)))
    train, test, enc = features.training_frame(df)
    return df, stage(train), stage(test), enc


def test_models_beat_the_district_median(spark, frames):
    df, train, test, _ = frames
    recipes = [training.linear(), training.boosted_trees(iterations=15), training.forest(trees=5)]
    models, cards = training.tournament(train, test, recipes)
    mae = {r.model: r.MAE for r in cards.collect()}
    learn, held = features.split_train_test(df)
    naive = recommend.predict_district_median(held, learn).select(F.col("prix_m2").alias("prix_reel"), F.col("prix_m2_predit").alias("prix_predit"))
    limit = scorecard(naive).first().MAE
    assert set(mae) == {"LinearRegression", "GBT", "RandomForest", "Ensemble"}
    assert mae["LinearRegression"] < limit and mae["GBT"] < limit
    again = training.fit(train.repartition(3), training.linear())
    a, b = (sorted(r.prix_predit for r in training.predictions(m, test).collect()) for m in (models["LinearRegression"], again))
    assert np.allclose(a, b)


def test_additive_and_huber(spark, frames):
    _, train, test, _ = frames
    assert scorecard(training.fit_additive(train, test)[1]).first().R2 > 0.5
    huber = training.fit(train, training.linear(loss="huber", log_target=True))
    assert scorecard(training.predictions(huber, test)).first().R2 > 0.5


def test_linear_contributions_add_up(spark, frames):
    _, train, test, _ = frames
    model = training.fit(train, training.linear(C.BASE_FEATURES))
    row = explain.linear_contributions(model, test, k=None).select(
        F.max(F.abs(F.aggregate("contributions", F.col("base"), lambda a, c: a + c["value"]) - F.col("prix_m2_predit")))
    ).first()
    assert row[0] < 1e-6
    top = explain.linear_contributions(model, test, k=3).first().contributions
    assert len(top) == 3 and abs(top[0].value) >= abs(top[1].value) >= abs(top[2].value)


def test_occlusion_finds_the_driver(spark, frames):
    _, train, test, _ = frames
    model = training.fit(train, training.boosted_trees(C.BASE_FEATURES, iterations=8))
    ranked = [r.feature for r in explain.mean_absolute_contribution(explain.occlusion_contributions(model, test, k=None)).collect()]
    assert set(ranked[:2]) == {"arrondissement", "surface_reelle_bati"}


def test_weights_and_importance(spark, frames):
    _, train, _, _ = frames
    model = training.fit(train, training.boosted_trees(weighted=True, iterations=5))
    table = training.feature_importance(spark, model).collect()
    assert len(table) == 15 and sum(r.importance for r in table) == pytest.approx(1.0, abs=0.05)


def test_best_prefix_is_the_best_and_predicts_like_its_trees(spark, frames):
    _, train, _, _ = frames
    recipe = training.boosted_trees(C.BASE_FEATURES, loss="squared", step=0.3, depth=2, log_target=False)
    model = training.fit(train, recipe)
    kept = model.pipeline.stages[-1]
    rows = training.prepared(train, recipe)
    ready = recipe.stages[0].transform(rows)
    longer = recipe.stages[1].copy({recipe.stages[1].maxIter: kept.getNumTrees + math.ceil(C.PATIENCE_TRAVEL / 0.3)}).fit(ready.where(f"NOT {training.VALID}"))
    errors = longer.evaluateEachIteration(ready.where(training.VALID), "squared")
    assert min(errors) == pytest.approx(errors[kept.getNumTrees - 1])
    own = kept.evaluateEachIteration(ready.where(training.VALID), "squared")
    assert len(own) == kept.getNumTrees and own == pytest.approx(errors[: len(own)])
    by_hand = sum(w * F.col(f"t{i}") for i, w in enumerate(kept.treeWeights))
    trees = ready.select("features")
    for i, tree in enumerate(kept.trees):
        trees = tree.setPredictionCol(f"t{i}").transform(trees)
    assert kept.transform(trees).where(F.abs(F.col("prediction") - by_hand) > 1e-9).count() == 0
    assert 1 < kept.getNumTrees and kept.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_fit_without_validation_rows_or_keys(spark, frames):
    _, train, test, _ = frames
    unkeyed = train.limit(200).withColumn("id_mutation", F.lit(None).cast("long"))
    model = training.fit(unkeyed, training.boosted_trees(C.BASE_FEATURES, step=1.0))
    assert training.predictions(model, test).where("prix_predit > 0").count() == test.count()


def test_huber_trees(spark, frames):
    _, train, test, _ = frames
    wild = stage(train.withColumn("prix_m2", F.when(F.pmod(F.xxhash64("id_mutation", F.lit(1)), F.lit(20)) == 0, F.col("prix_m2") * 6).otherwise(F.col("prix_m2"))))
    recipe = training.boosted_trees(C.BASE_FEATURES, loss="huber", step=0.3, log_target=False)
    ready = recipe.stages[0].transform(training.prepared(wild, recipe))
    parts = [ready.where(F.col(training.VALID) == v) for v in (False, True)]
    _, losses = training.fit_huber(*parts, recipe.stages[1])
    assert len(losses) > 1 and all(b < a for a, b in zip(losses, losses[1:]))
    cards = {}
    for loss in ("huber", "squared"):
        model = training.fit(wild, training.boosted_trees(C.BASE_FEATURES, name=loss, loss=loss, step=0.3, log_target=False))
        cards[loss] = scorecard(training.predictions(model, test)).first().MAE
    assert cards["huber"] < cards["squared"]  # wild prices pull the squared fit away from the ordinary test rows
    size = spark.range(1).select(*[training.huber_loss(F.lit(float(r)), 2.0) for r in (0, 1, -1, 2, -5)]).first()
    assert list(size) == [0.0, 0.5, 0.5, 2.0, 8.0]


def test_halving_finds_the_winner_and_resumes(spark, frames, tmp_path):
    _, train, _, _ = frames
    made = []

    def recipe_of(name, **setting):
        made.append(name)
        return training.boosted_trees(C.BASE_FEATURES, name=name, iterations=4, **setting)

    settings = [{"step": s, "depth": d} for s in (0.01, 0.3) for d in (1, 2, 4)]
    state = str(tmp_path / "search")
    best, log = training.successive_halving(train, settings, state=state, recipe_of=recipe_of, together=3)
    assert [sum(t["rung"] == r for t in log) for r in range(3)] == [6, 3, 2] and [t["share"] for t in log][::5] == [0.25, 0.25, 1.0]
    whole = {}  # the full grid on the same rows
    fold = F.pmod(F.xxhash64("id_mutation", F.lit("held out")), F.lit(100))
    for i, setting in enumerate(settings):
        model = training.fit(train.where(fold >= 15), training.boosted_trees(C.BASE_FEATURES, iterations=4, **setting))
        whole[i] = scorecard(training.predictions(model, train.where(fold < 15))).first().MAE
    assert best == settings[min(whole, key=whole.get)]
    count = len(made)
    assert training.successive_halving(train, settings, state=state, recipe_of=recipe_of) == (best, log) and len(made) == count


def test_search_and_verdict(spark, frames):
    _, train, _, _ = frames
    quick = functools.partial(training.boosted_trees, iterations=3)
    best, tried = training.successive_halving(train, training.random_settings(2), recipe_of=quick)
    assert best in [t["setting"] for t in tried] and len(tried) == 2
    cards = spark.createDataFrame([("without", 1500.0, 0.50), ("with", 1485.0, 0.50)], "model string, MAE double, R2 double")
    assert experiments.verdict(cards).first().keep
    assert not experiments.verdict(cards.replace(1485.0, 1495.0)).first().keep


def test_saved_model_predicts_the_same(spark, frames, tmp_path):
    df, train, _, enc = frames
    model = training.fit(train, training.boosted_trees(iterations=5), enc)
    model.rmse = 123.0
    training.save_model(model, str(tmp_path / "m"), spark)
    loaded = training.load_model(spark, str(tmp_path / "m"))
    a, b = (sorted((r.id_mutation, r.prix_m2_predit) for r in m.score(df).collect()) for m in (model, loaded))
    assert len(a) == df.count() and [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b]) and loaded.rmse == 123.0


def test_saving_again_keeps_no_old_table(spark, frames, tmp_path):
    df, train, _, enc = frames
    path = str(tmp_path / "m")
    model = training.fit(train, training.linear(C.BASE_FEATURES), enc)
    training.save_model(model, path, spark)
    assert training.load_model(spark, path).encodings.street_recent is not None and training.load_model(spark, path).defaults == model.defaults
    model.encodings = dataclasses.replace(enc, street_recent=None)
    training.save_model(model, path, spark)
    assert training.load_model(spark, path).encodings.street_recent is None


def test_missing_features_do_not_count_as_zero(spark, frames):
    df, train, test, enc = frames
    model = training.fit(train, training.linear(C.BASE_FEATURES), enc, held_out=test)
    gaps = {"latitude": "double", "longitude": "double", "mois": "int", "nombre_lots": "int"}
    blank = df.withColumns({c: F.lit(None).cast(t) for c, t in gaps.items() if c in df.columns})
    got = model.score(blank)
    low, high, n = got.agg(F.min("prix_m2_predit"), F.max("prix_m2_predit"), F.count("*")).first()
    assert n == df.count() and 0 < low <= high < 100_000
    assert got.where("latitude IS NOT NULL OR mois IS NOT NULL").count() == 0 and got.columns == [*blank.columns, "prix_m2_predit"]
    assert 0 < model.rmse < 50_000


def test_isolation_forest(spark, frames):
    df = frames[0]
    odd = df.limit(5).withColumns({"id_mutation": F.col("id_mutation") + 100_000, "prix_m2": F.lit(48_000.0), "surface_reelle_bati": F.lit(900.0)})
    both = stage(df.unionByName(odd))
    out = stage(forest.isolation_forest(both, 0.03, trees=50))
    n, flagged = out.count(), out.where("is_outlier").count()
    assert n == both.count() and abs(flagged - 0.03 * n) <= 2
    assert out.where("id_mutation >= 100000 and is_outlier").count() == 5
    kept, gone = forest.split_outliers(out)
    assert kept.count() + gone.count() == n


def test_strategies(spark, frames):
    cards = experiments.strategy_experiment(frames[0], training.boosted_trees(iterations=2), ["B_IQR+IF_3pct", "E_IQR+tight_bounds"])
    assert {r.model for r in cards.collect()} == {"B_IQR+IF_3pct", "E_IQR+tight_bounds"}


def test_ablation(spark, frames):
    quick = functools.partial(training.boosted_trees, iterations=2)
    cards = experiments.ablation(frames[0], training.random_settings(1), recipe_of=quick)
    assert sorted(r.model[0] for r in cards.collect()) == ["a", "b", "c", "d", "e"]


def test_feature_group(spark, frames):
    sales_with = frames[0].withColumn("nb_parks", F.lit(3.0))
    row = experiments.feature_group_gain(sales_with, ["nb_parks"], lambda cols, name: training.linear(cols, name=name)).first()
    assert abs(row.delta_mae) < 1 and not row.keep


def test_department_files(spark, tmp_path):
    folder = tmp_path / "2023" / "departements"
    folder.mkdir(parents=True)
    header = ",".join(tables.REGISTER_COLUMNS)
    for dep, ids in (("75", ["a", "b"]), ("92", ["c"]), ("13", ["z"])):
        lines = [",".join([i] + [""] * (len(tables.REGISTER_COLUMNS) - 1)) for i in ids]
        with gzip.open(folder / f"{dep}.csv.gz", "wt") as f:
            f.write("\n".join([header, *lines]) + "\n")
    rows = tables.read_departments(spark, str(tmp_path), 2023).select("id_mutation", "code_departement_source").collect()
    assert sorted(map(tuple, rows)) == [("a", "75"), ("b", "75"), ("c", "92")]
    assert tables.read_departments(spark, str(tmp_path), 1999).count() == 0
    one = tables.read_register(spark, str(folder / "92.csv.gz"), fixed_layout=False)
    assert one.columns == tables.REGISTER_COLUMNS and one.count() == 1
    assert tables.union_sources([one.select("id_mutation"), one]).count() == 2


def test_sales_table_prunes_years_and_columns(spark, frames, tmp_path):
    path = str(tmp_path / "sales")
    tables.write_sales(frames[0], path)
    df = tables.read_sales(spark, path).where("annee = 2021 and prix_m2 > 9000").select("prix_m2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(annee" in plan and "GreaterThan(prix_m2,9000.0)" in plan
    assert "ReadSchema: struct<prix_m2:double>" in plan
    assert df.count() == frames[0].where("annee = 2021 and prix_m2 > 9000").count()


def test_cell_read_is_pushed_down(spark, tmp_path):
    cols = {c: F.lit(1.0) for c in C.POI_FEATURES}
    spark.range(10).withColumns({"lat_grid": F.lit(48.85), "lon_grid": 2.3 + F.col("id") * 0.005, **cols}).write.parquet(str(tmp_path / "e"))
    got = tables.read_cell(spark, str(tmp_path / "e"), (48.85, 2.31))
    assert got.count() == 1 and "GreaterThanOrEqual(lat_grid" in got._jdf.queryExecution().executedPlan().toString()


def test_gems_files(spark, tmp_path):
    listing = {"titre": "T", "arrondissement": 11, "surface": 62, "pieces": 3, "prix_annonce": 300000, "latitude": None, "longitude": None}
    (tmp_path / "l.json").write_text(json.dumps([listing, {**listing, "prix_annonce": 900000}], indent=1))
    scored = recommend.score_listings(tables.read_listings(spark, str(tmp_path / "l.json")))
    tables.write_gems(scored, str(tmp_path / "out"), "2025-01-31")
    meta = tables.read_gems(spark, str(tmp_path / "out"))[0].first()
    assert (meta.nb_annonces_analysees, meta.nb_pepites, meta.date_mise_a_jour) == (2, 1, "2025-01-31")
    written, own = tables.read_gems(spark, str(tmp_path / "out"))
    assert written.first().nb_annonces_analysees == 2 and own.count() == 1 and own.first().titre == "T"
    envelope = {"metadata": {"nb_pepites": 1}, "gems": [{**listing, "gem_score": 0.3}]}
    (tmp_path / "g.json").write_text(json.dumps(envelope, indent=1))
    info, gems = tables.read_gems(spark, str(tmp_path / "g.json"))
    assert info.first().nb_pepites == 1 and gems.first().gem_score == 0.3
    assert recommend.browse_gems(gems, 0.1, 11, 0, None).count() == 1


def test_scoring_accepts_a_stream(spark, tmp_path):
    rows = [("T", 11, 62.0, 3, 300000), ("U", 7, 30.0, 1, 900000)]
    listings = spark.createDataFrame(rows, "titre string, arrondissement int, surface double, pieces int, prix_annonce long")
    listings.write.parquet(str(tmp_path / "in"))
    stream = recommend.listing_gems(spark.readStream.schema(listings.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("gems").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert [r.titre for r in spark.table("gems").collect()] == ["T"]


def test_versioned_table(spark, tmp_path):
    a = tables.replace_table(spark.range(3), str(tmp_path / "t"), "1")
    b = tables.replace_table(spark.range(5), str(tmp_path / "t"), "2")
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (3, 5)


def test_a_run_that_dies_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "gems")
    listings = spark.createDataFrame([("T", 11, 62.0, 3, 300000)], "titre string, arrondissement int, surface double, pieces int, prix_annonce long")
    scored = recommend.score_listings(listings)
    assert publish.current(spark, path) is None
    tables.write_gems(scored, path, "2025-01-30")
    first = publish.current(spark, path)
    failing = scored.withColumn("gem_score", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        tables.write_gems(failing, path, "2025-01-31")
    assert publish.current(spark, path) == first and tables.read_gems(spark, path)[0].first().date_mise_a_jour == "2025-01-30"
    tables.write_gems(scored, path, "2025-02-01")
    metadata, gems = tables.read_gems(spark, path)
    assert metadata.first().date_mise_a_jour == "2025-02-01" and gems.count() == 1
    # a reader that took the old run before the switch can still read it
    assert spark.read.json(f"{first}/gems").count() == 1
    with pytest.raises(FileNotFoundError):
        training.load_model(spark, str(tmp_path / "nothing"))


def test_history_is_published(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert tables.read_history(spark, path) is None
    runs = lambda *rows: spark.createDataFrame(rows, "model string, MAE double")
    tables.write_history(runs(("b", 2.0), ("a", 1.0)), path)
    tables.write_history(runs(("a", 5.0), ("c", 3.0)), path)
    got = [tuple(r) for r in tables.read_history(spark, path).select("model", "MAE", "position").orderBy("position").collect()]
    assert got == [("a", 5.0, 1), ("b", 2.0, 2), ("c", 3.0, 3)]


def test_quarantine_counts_add_up(spark, tmp_path):
    folder = tmp_path / "2023" / "departements"
    folder.mkdir(parents=True)
    width = len(tables.REGISTER_COLUMNS)

    def line(**cells):
        return ",".join(str(cells.get(c, "")) for c in tables.REGISTER_COLUMNS)

    lines = [
        line(id_mutation="ok", date_mutation="2023-01-02", valeur_fonciere="1e5", longitude=" 2.3 "), line(id_mutation="empty"),
        line(id_mutation="date", date_mutation="02/2023"), line(id_mutation="two", date_mutation="x", nombre_lots="many"),
        "short,2023-01-01", line(id_mutation="long") + ",more", line(id_mutation='"quoted, name"', valeur_fonciere="12,5"),
    ]
    with gzip.open(folder / "75.csv.gz", "wt") as f:
        f.write("\n".join([",".join(tables.REGISTER_COLUMNS), *lines]) + "\n")
    good, bad = tables.split_register(tables.read_departments(spark, str(tmp_path), 2023, checked=True))
    assert sorted(r.id_mutation for r in good.collect()) == ["empty", "ok"] and good.columns == [*tables.REGISTER_COLUMNS, "code_departement_source"]
    reasons = {r.line.split(",")[0].strip('"'): r.reason for r in bad.collect()}
    assert reasons == {"date": "date_mutation", "two": "date_mutation,nombre_lots", "short": "malformed", "long": "malformed", "quoted": "malformed"}
    assert bad.count() + good.count() == len(lines) and {r.code_departement_source for r in bad.collect()} == {"75"}
    assert next(r.line for r in bad.collect() if r.line.startswith("short")) == "short,2023-01-01" and width == 40
    none = tables.split_register(tables.read_departments(spark, str(tmp_path), 1999, checked=True))
    assert [df.count() for df in none] == [0, 0]


def test_pages_read_their_days_only(spark, tmp_path):
    days = [f"2024-{1 + i % 12:02d}-{1 + i * 5 % 27:02d}" if i % 50 else None for i in range(2000)]
    rows = [(i, d, 1.0) for i, d in enumerate(days)]
    others = ["surface_reelle_bati", "nombre_pieces_principales", "prix_m2", "latitude", "longitude", "arrondissement"]
    df = spark.createDataFrame(rows, "id_mutation long, day string, valeur_fonciere double").withColumns({
        "date_mutation": F.to_date("day"), "type_local": F.lit("Maison"), **{c: F.lit(1.0) for c in others},
    }).drop("day")
    df.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    want = [i for i, d in sorted(enumerate(days), key=lambda x: (x[1] is None, [-ord(c) for c in x[1] or ""], x[0]))]
    for limit, offset in ((7, 0), (50, 333), (100, 1900), (100, 1995), (5, 2000), (1, 1959), (3000, 0)):
        got = [r.id_mutation for r in market.transaction_page(df, limit, offset).collect()]
        assert got == want[offset : offset + limit], (limit, offset)
    inside, skipped = market.days_of_page(df, 20, 1000)
    assert df.where(inside).count() < 60 and skipped <= 1000
    assert "GreaterThanOrEqual(date_mutation" in df.where(inside)._jdf.queryExecution().executedPlan().toString()
    last, seen = None, []
    while True:  # the key-set form walks through all pages
        page = market.transaction_page(df, 300, 0) if last is None else market.page_after(df, last[0], last[1], 300)
        found = page.collect()
        if not found:
            break
        seen += [r.id_mutation for r in found]
        last = (F.to_date(F.lit(found[-1].date_mutation)) if found[-1].date_mutation else None, found[-1].id_mutation)
    assert seen == want
    assert market.transaction_page(df.limit(0), 5, 0).collect() == []


def test_cells_are_clustered(spark, tmp_path):
    cols = {c: F.lit(1.0) for c in C.POI_FEATURES}
    cells = spark.range(400).withColumns({"lat_grid": 48.8 + (F.col("id") % 20) * 0.005, "lon_grid": 2.295 + F.floor(F.col("id") / 20) * 0.005, **cols})
    tables.write_cells(cells, str(tmp_path / "c"))
    for cell in ((48.85, 2.31), (48.8, 2.3), (48.895, 2.39)):
        found = tables.read_cell(spark, str(tmp_path / "c"), cell)
        assert found.count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(zone" in plan or "PartitionFilters: [zone" in plan


def test_search_batch_is_each_search_and_reads_few_cells(spark):
    df = stage(sales(spark, n=6000, seed=8, hot=0.3).withColumns({
        "surface_reelle_bati": 10.0 + F.pmod(F.xxhash64("id_mutation"), F.lit(120)),
        "prix_m2": F.rint(4000.0 + F.pmod(F.xxhash64("id_mutation", F.lit(2)), F.lit(8000)) / 50) * 1.0,
        "nombre_pieces_principales": F.when(F.col("id_mutation") % 9 > 0, F.col("nombre_pieces_principales")),
        "adresse_numero": F.lit("1"), "adresse_nom_voie": F.lit("RUE"),
    }))
    predicted = stage(df.withColumn("prix_m2_predit", F.col("prix_m2") * (1.0 + F.floor(F.pmod(F.xxhash64("id_mutation", F.lit(3)), F.lit(60))) / 100)))  # many ties
    asked = [(i, 2e5 + 5e4 * i, (None, 1, 7, 20, 11)[i % 5], 5.0 * (i % 4), 60.0 + 10 * i, 1 + i % 3) for i in range(12)]
    asked += [(50, 1e9, 3, 0.0, 1e6, 0), (51, 10.0, 3, 0.0, 500.0, 1), (52, None, 3, 0.0, 500.0, 1)]
    schema = "search_id int, budget double, wanted int, surface_min double, surface_max double, pieces_min int"
    searches = spark.createDataFrame(asked, schema)
    got = {}
    for r in recommend.recommend_many(df, searches, top_n=4, predicted=predicted).collect():
        got.setdefault(r.search_id, []).append((r["rank"], r.id_mutation, r.gem_score))
    for i, budget, wanted, low, high, rooms in asked:
        want = [] if budget is None else recommend.recommend(df, budget, wanted, low, high, rooms, 4, predicted=predicted).collect()
        assert sorted(got.get(i, [])) == [(r["rank"], r.id_mutation, r.gem_score) for r in want], i
    assert set(got) >= {50} and not {51, 52} & set(got)
    # what a wide search reads does not grow with the gems: far fewer rows than fit it
    gems = recommend.gem_cells(recommend.scored_sales(df, predicted).where(F.col("gem_score") >= C.GEM_THRESHOLD))
    wide = searches.where("search_id = 50")
    needed = recommend.cells_to_search(recommend.cell_index(gems, 4), wide, 4)
    read = gems.join(needed, recommend.CELL).where("least IS NULL OR gem_score >= least").count()
    assert 4 <= read < 0.1 * gems.where("arrondissement BETWEEN 2 AND 4").count()
