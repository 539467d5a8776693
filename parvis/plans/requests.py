"""Prices for whole tables of requests and of listings by a fitted model."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions import pricing
from parvis.functions.geo import haversine
from parvis.functions.numbers import round_even
from parvis.functions.text import explanation, top_contributions
from parvis.operators.cleaning import validate_requests
from parvis.operators.proximity import enrich_by_cell
from parvis.plans.explain import linear_contributions, occlusion_contributions
from parvis.plans.recommend import locate_listings, score_listings, snap_coordinates
from parvis.plans.training import PriceModel

CONTRIBUTIONS = 8
ROW = "_given"  # the caller's row, carried along untouched


def as_sales(rows: DataFrame, given: dict[str, Column] | None = None) -> DataFrame:
    """Rows with surface, pieces, arrondissement, latitude and longitude in the shape of
    sales, their own columns in one struct. ``given`` fills what a sale has besides;
    a column of that name in ``rows`` comes before it.

    A row without a street gets one that no lookup holds, spread over many: the join
    by street finds nothing for it, like for null, but no task gets all such rows.
    """
    others = {"annee": None, "mois": None, "trimestre": None, "nombre_lots": None, "lot1_surface_carrez": None} | (given or {})

    def value(name: str, default: Column | None) -> Column:
        parts = [F.col(name)] if name in rows.columns else []
        return F.coalesce(*parts, F.lit(None) if default is None else default)

    street = F.concat(F.lit("\0"), F.xxhash64("latitude", "longitude", "surface").cast("string"))
    return rows.select(
        F.struct("*").alias(ROW),
        (F.lit(75000.0) + F.col("arrondissement")).alias("code_postal"),
        F.col("surface").cast("double").alias("surface_reelle_bati"),
        F.col("pieces").alias("nombre_pieces_principales"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        value("adresse_code_voie", street).cast("string").alias("adresse_code_voie"),
        *[value(n, v).cast("double" if n.startswith("lot") else "int").alias(n) for n, v in others.items()],
        *[F.lit(None).cast("double").alias(n) for n in C.CARREZ_COLUMNS if n not in others],
    )


def explained(model: PriceModel, sales: DataFrame, k: int = CONTRIBUTIONS) -> DataFrame:
    """Price and the ``k`` largest contributions, in whole euros per m², of rows in the shape of sales.

    Contributions of a linear model are exact; those of any other are the changes in
    price when a feature is set to its median in training, so rows do not depend on each other.
    """
    matrix = model.matrix(sales)
    if isinstance(model.pipeline.stages[-1], LinearRegressionModel):
        scored = linear_contributions(model, matrix, k=None).drop("base")
    else:
        scored = occlusion_contributions(model, matrix, k=None, baseline=model.defaults)
    euros = F.transform(
        "contributions",
        lambda c: F.struct(c["feature"].alias("feature"), round_even(c["value"]).alias("value"), c["display"].alias("display")),
    )
    return scored.withColumn("contributions", top_contributions(euros, k))


def price_requests(
    requests: DataFrame, model: PriceModel, enriched: DataFrame | None = None, order: list[str] = ("place_id",),
    as_of: Column | None = None, k: int = CONTRIBUTIONS,
) -> DataFrame:
    """Every request once, with ``errors`` (empty for those that are priced) and its price.

    Requests carry the fields of ``constants.REQUEST_LIMITS`` and may carry a street
    (adresse_code_voie). A point far from its district moves to the district's centre; place
    features come from the row's cell in ``enriched``; the recent price is that of the
    street, else of the district, else the overall mean; a missing year is that of ``as_of``
    (today). The band has the model's held-out error as half width. Without an asking
    price, or a predicted one above zero, there is no score. A rejected request keeps its fields and has null results.
    Columns of the caller's that have the name of a result are replaced by it.
    """
    checked = validate_requests(requests)
    accepted = snap_coordinates(checked.where(F.size("errors") == 0))
    sales = as_sales(accepted, {"annee": F.year(F.current_date() if as_of is None else as_of)})
    if enriched is not None:
        sales = enrich_by_cell(sales, enriched, list(order))
    else:
        sales = sales.withColumns({c: F.lit(v) for c, v in C.POI_DEFAULTS.items()})
    rows = explained(model, sales, k).withColumns({c: F.col(f"_row.{c}") for c in C.POI_FEATURES})
    price, area, asked = F.col("prix_m2_predit"), F.col(f"{ROW}.surface"), F.col(f"{ROW}.prix_affiche")
    low, high = pricing.confidence_band(price, model.rmse)
    score = F.when(price > 0, round_even(pricing.asking_gem_score(price, asked, area), 4))
    distance = haversine(F.col(f"{ROW}.latitude"), F.col(f"{ROW}.longitude"), *C.CENTER)
    results = {
        "prix_predit_m2": round_even(price, 1),
        "prix_predit_total": round_even(price * area),
        "confidence_low": round_even(low, 1),
        "confidence_high": round_even(high, 1),
        "contributions": F.col("contributions"),
        "gem_score": score,
        "is_hidden_gem": pricing.is_gem(score),
        "xai_summary": explanation(price, F.col("contributions"), F.col(f"{ROW}.arrondissement"), distance),
        **{c: F.col(c) for c in C.POI_FEATURES},
    }
    # the model's rows hold the whole sale in _row, the request in its struct
    own = [c for c in accepted.columns if c not in results]
    priced = rows.withColumn(ROW, F.col(f"_row.{ROW}")).select(
        *[F.col(f"{ROW}.`{c}`").alias(c) for c in own], *[v.alias(c) for c, v in results.items()]
    )
    rejected = checked.where(F.size("errors") > 0).drop(*results)
    return priced.unionByName(rejected, allowMissingColumns=True)


def predict_listings(listings: DataFrame, model: PriceModel, year: int, k: int = 3) -> DataFrame:
    """Listings with ``prix_m2_predit`` and their ``k`` largest ``contributions``.

    A listing counts as one lot in June of ``year`` whose private area is its whole area.
    """
    given = {"annee": F.lit(year), "mois": F.lit(6), "trimestre": F.lit(2), "nombre_lots": F.lit(1), "lot1_surface_carrez": F.col("surface")}
    rows = explained(model, as_sales(listings, given), k)
    own = [c for c in listings.columns if c not in ("prix_m2_predit", "contributions")]
    return rows.select(*[F.col(f"_row.{ROW}.`{c}`").alias(c) for c in own], "prix_m2_predit", "contributions")


def score_by_model(listings: DataFrame, model: PriceModel, year: int) -> DataFrame:
    """``score_listings`` with a model's prices; missing points are the district's centre.

    Rows that lack a price, area or district have null scores.
    """
    scored = score_listings(predict_listings(locate_listings(listings), model, year), "prix_m2_predit")
    usable = F.expr("prix_annonce > 0 AND surface > 0 AND arrondissement BETWEEN 1 AND 20")
    return scored.withColumns(
        {c: F.when(usable, F.col(c)) for c in ("prix_predit_m2", "prix_predit", "prix_affiche_m2", "gem_score", "gain_potentiel", "sous_evaluation_pct")}
    ).drop("prix_m2_predit")
