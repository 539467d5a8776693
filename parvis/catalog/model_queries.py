"""Queries that fit models. No SQL counterpart: their properties are tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.registry import query
from parvis.functions.pricing import confidence_band
from parvis.operators import forest, outliers
from parvis.operators.encodings import fit_encodings
from parvis.operators.features import feature_matrix, split_train_test, training_frame
from parvis.operators.proximity import enrich_by_cell
from parvis.plans import experiments, explain, training
from parvis.plans.recommend import scored_sales
from parvis.session import stage


def _core(spark, d):
    return outliers.price_between(outliers.iqr_filter_by_district(V.clean(spark, d), 1.0))


def _frames(spark, d, columns=None):
    """Training and test features, written once and read by every fit."""
    train, test, enc = training_frame(_core(spark, d), columns=columns)
    return stage(train), stage(test), enc


@query()
def linear_model_scores(spark, d):
    train, test, _ = _frames(spark, d, C.BASE_FEATURES)
    return training.predictions(training.fit(train, training.linear(C.BASE_FEATURES)), test)


@query(
    views="clean",
    sql="""WITH core AS (SELECT * FROM clean WHERE surface_reelle_bati IS NOT NULL AND prix_m2 BETWEEN 5000 AND 20000),
line AS (SELECT regr_slope(prix_m2, surface_reelle_bati) AS a, regr_intercept(prix_m2, surface_reelle_bati) AS b FROM core WHERE (id_mutation * 7919) % 100 < 80),
scored AS (SELECT id_mutation, prix_m2, a * surface_reelle_bati + b AS p FROM core, line WHERE (id_mutation * 7919) % 100 >= 80),
held AS (SELECT sqrt(avg((prix_m2 - p) * (prix_m2 - p))) AS rmse FROM scored)
SELECT id_mutation, p AS prix_m2_predit, p - rmse AS low, p + rmse AS high FROM scored, held""",
    digits={"prix_m2_predit low high": 3},
)
def fitted_bands(spark, d):
    """A line of price over area, with the error of the held-out rows as the band."""
    rows = stage(outliers.price_between(V.clean(spark, d)).where("surface_reelle_bati IS NOT NULL").select("id_mutation", "prix_m2", "surface_reelle_bati"))
    train, test = split_train_test(rows)
    model = training.fit(train, training.linear(["surface_reelle_bati"]), held_out=test)
    low, high = confidence_band("prix_m2_predit", model.rmse)
    return model.predict(test).select("id_mutation", "prix_m2_predit", low.alias("low"), high.alias("high"))


@query()
def gbt_scores(spark, d):
    train, test, _ = _frames(spark, d)
    return training.predictions(training.fit(train, training.boosted_trees()), test)


@query()
def additive_model_scores(spark, d):
    train, test, _ = _frames(spark, d, C.BASE_FEATURES)
    return training.fit_additive(train, test)[1]


@query()
def tournament(spark, d):
    train, test, _ = _frames(spark, d)
    recipes = [
        training.linear(C.BASE_FEATURES),
        training.boosted_trees(),
        training.boosted_trees(name="GBT_L2", loss="squared", log_target=False),
        training.forest(),
        training.linear(name="Huber", loss="huber", log_target=True),
        training.boosted_trees(name="GBT_weighted", weighted=True),
    ]
    return training.tournament(train, test, recipes)[1]


@query()
def feature_importance(spark, d):
    train, _, _ = _frames(spark, d)
    return training.feature_importance(spark, training.fit(train, training.boosted_trees()))


@query()
def linear_contributions(spark, d):
    train, test, _ = _frames(spark, d, C.BASE_FEATURES)
    model = training.fit(train, training.linear(C.BASE_FEATURES))
    return explain.linear_contributions(model, test, k=8).select("id_mutation", "prix_m2_predit", "base", "contributions")


@query()
def occlusion_contributions(spark, d):
    train, test, _ = _frames(spark, d)
    model = training.fit(train, training.boosted_trees())
    return explain.occlusion_contributions(model, test, k=8).select("id_mutation", "prix_m2_predit", "contributions")


@query()
def mean_absolute_contributions(spark, d):
    train, test, _ = _frames(spark, d)
    model = training.fit(train, training.linear())
    return explain.mean_absolute_contribution(explain.linear_contributions(model, test, k=None))


@query()
def isolation_forest(spark, d):
    kept = stage(outliers.iqr_filter_by_district(V.clean(spark, d), 1.5))
    return forest.isolation_forest(kept).select("id_mutation", "anomaly", "is_outlier")


@query()
def strategy_experiment(spark, d):
    return experiments.strategy_experiment(V.clean(spark, d))


@query()
def ablation(spark, d):
    # the library's 40 settings, and 8 random ones, take too long for a query, see README
    settings = [{"step": step, "depth": depth} for step in (0.1, 0.2) for depth in (3, 5)]
    return experiments.ablation(V.clean(spark, d), settings)


@query()
def place_feature_gain(spark, d):
    sales = enrich_by_cell(outliers.enriched_valid(V.clean(spark, d)), V.enriched(spark, d), ["place_id"])
    return experiments.feature_group_gain(sales, C.POI_FEATURES)


def _model(spark, d):
    train, test, enc = _frames(spark, d)
    return training.fit(train, training.boosted_trees(), enc, held_out=test)


@query()
def batch_scoring(spark, d):
    """All sales scored by a model learnt from the training rows."""
    model = _model(spark, d)
    return model.score(V.clean(spark, d)).select("id_mutation", "prix_m2", "prix_m2_predit")


@query()
def model_hidden_gems(spark, d):
    sales = V.clean(spark, d)
    gems = scored_sales(sales, _model(spark, d).score(sales))
    return gems.where(F.col("gem_score") >= C.GEM_THRESHOLD).select("id_mutation", "prix_m2", "prix_m2_predit", "gem_score")


@query()
def smoothed_features_model(spark, d):
    """Street and grid encodings, shrunk, in a boosted model."""
    train, test = split_train_test(stage(_core(spark, d)))
    enc = fit_encodings(train, smoothed=True, fine=True)
    rows = stage(feature_matrix(train, enc, keep=["id_mutation"]))
    model = training.fit(rows, training.boosted_trees(), enc)
    return training.predictions(model, feature_matrix(test, enc, keep=["id_mutation"]))
