"""Finding under-priced sales and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions import geo, pricing
from parvis.functions.numbers import as_col
from parvis.functions.text import address_label
from parvis.operators.outliers import with_district
from parvis.operators.quantiles import group_medians, group_quantiles
from parvis.session import stage


def predict_district_median(sales: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Naive model: the median price of the district, else of all sales."""
    base = with_district(sales if reference is None else reference)
    medians = group_medians(base, ["arrondissement"], C.TARGET, "_median", bounded_keys=True).drop("n")
    overall = group_medians(base, [], C.TARGET, "m").select("m").scalar()
    return (
        with_district(sales)
        .join(F.broadcast(medians), "arrondissement", "left")
        .withColumn("prix_m2_predit", F.coalesce("_median", overall))
        .drop("_median")
    )


def district_floors(sales: DataFrame) -> DataFrame:
    """The 15th percentile of all sales of each district: at most 100 rows."""
    probs = {"district_floor": C.DISTRICT_FLOOR_QUANTILE}
    return group_quantiles(with_district(sales), ["arrondissement"], C.TARGET, probs, bounded_keys=True).drop("n")


def with_district_floor(sales: DataFrame) -> DataFrame:
    floors = F.broadcast(district_floors(sales))
    return (
        with_district(sales)
        .join(floors, "arrondissement", "left")
        .withColumn("district_floor", F.coalesce("district_floor", F.lit(C.DISTRICT_FLOOR_DEFAULT)))
    )


def scored_sales(sales: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Sales at or above their district's floor with their under-pricing score.

    ``predicted`` is ``sales`` with ``prix_m2_predit``, from any model; without it
    the district median stands in, found in the same pass as the floor. The floor
    comes from the unfiltered table.
    """
    if predicted is None:
        probs = {"prix_m2_predit": 0.5, "district_floor": C.DISTRICT_FLOOR_QUANTILE}
        base = with_district(sales)
        levels = group_quantiles(base, ["arrondissement"], C.TARGET, probs, bounded_keys=True).drop("n")
        rows = base.join(F.broadcast(levels), "arrondissement")  # at most 100 rows
    else:
        rows = with_district(predicted).join(F.broadcast(district_floors(sales)), "arrondissement", "left")
        rows = rows.withColumn("district_floor", F.coalesce("district_floor", F.lit(C.DISTRICT_FLOOR_DEFAULT)))
    return rows.where(F.col(C.TARGET) >= F.col("district_floor")).withColumn(
        "gem_score", pricing.sale_gem_score("prix_m2_predit", C.TARGET)
    )


def _fits(area_min, area_max, rooms_min, budget) -> Column:
    rooms = F.coalesce(F.col("nombre_pieces_principales"), F.lit(0))
    return (
        (F.col(C.TARGET) * F.col("surface_reelle_bati") <= as_col(budget))
        & F.col("surface_reelle_bati").between(as_col(area_min), as_col(area_max))
        & (rooms >= as_col(rooms_min))
    )


def _presented(df: DataFrame) -> DataFrame:
    area, paid, predicted = F.col("surface_reelle_bati"), F.col(C.TARGET), F.col("prix_m2_predit")
    return df.withColumns(
        {
            "prix_total_transaction": paid * area,
            "prix_total_predit": predicted * area,
            "decote_pct": F.col("gem_score") * 100,
            "tier": pricing.gem_tier(F.col("gem_score") * 100),
            "adresse": address_label("adresse_numero", "adresse_nom_voie", "arrondissement"),
        }
    )


def recommend(
    sales: DataFrame, budget: float, arrondissement: int | None = None, surface_min: float = 0.0,
    surface_max: float = 500.0, pieces_min: int = 1, top_n: int = 5,
    threshold: float = C.GEM_THRESHOLD, predicted: DataFrame | None = None, tie: str = "id_mutation",
) -> DataFrame:
    """The ``top_n`` most under-priced sales for one search (district ±1)."""
    rows = scored_sales(sales, predicted).where(F.col("gem_score") >= threshold)
    rows = rows.where(_fits(surface_min, surface_max, pieces_min, F.lit(budget)))
    if arrondissement is not None:
        rows = rows.where(F.col("arrondissement").between(max(1, arrondissement - 1), min(20, arrondissement + 1)))
    best = rows.orderBy(F.desc("gem_score"), tie).limit(top_n)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("gem_score"), tie))  # top_n rows
    return best.withColumn("rank", rank).transform(_presented)


CELL = ["arrondissement", "band", "rooms"]  # district, ten square metres, rooms


def gem_cells(gems: DataFrame) -> DataFrame:
    """Gems with the cell they lie in."""
    rooms = F.coalesce(F.col("nombre_pieces_principales"), F.lit(0))
    return gems.withColumns(
        {"band": F.floor(F.col("surface_reelle_bati") / 10), "rooms": F.least(rooms, F.lit(10)), "total": F.col(C.TARGET) * F.col("surface_reelle_bati")}
    )


def cell_index(celled: DataFrame, top_n: int) -> DataFrame:
    """A row per cell: its ``top_n`` scores and the limits of what lies in it."""
    rooms = F.coalesce(F.col("nombre_pieces_principales"), F.lit(0))
    limits = celled.groupBy(*CELL).agg(
        F.max("gem_score").alias("best"), F.min("total").alias("cheapest"), F.max("total").alias("dearest"),
        F.min("surface_reelle_bati").alias("smallest"), F.max("surface_reelle_bati").alias("largest"),
        F.min(rooms).alias("fewest"), F.max(rooms).alias("most"),
    )
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("gem_score")))
    top = celled.select(*CELL, "gem_score", place.alias("_p")).where(F.col("_p") <= top_n)
    return limits.join(top.groupBy(*CELL).agg(F.collect_list("gem_score").alias("scores")), CELL)


def cells_to_search(index: DataFrame, searches: DataFrame, top_n: int) -> DataFrame:
    """(search columns, cell, least): the cells that can hold one of a search's ``top_n`` best.

    ``least`` is a score ``top_n`` hits are known to reach: that of cells which fit the
    search as a whole. A cell whose best score is below it is left out, and so is any
    row below it. Null while there are not so many hits for sure.
    """
    wanted = F.col("wanted")
    districts = F.when(wanted.isNull(), F.sequence(F.lit(0), F.lit(99))).otherwise(
        F.sequence(F.greatest(F.lit(1), wanted - 1), F.least(F.lit(20), wanted + 1))
    )
    possible = searches.withColumn("arrondissement", F.explode(districts)).join(index, "arrondissement").where(
        "largest >= surface_min AND smallest <= surface_max AND most >= pieces_min AND cheapest <= budget"
    )
    whole = F.expr("smallest >= surface_min AND largest <= surface_max AND fewest >= pieces_min AND dearest <= budget")
    known = F.sort_array(F.flatten(F.collect_list(F.when(whole, F.col("scores")))), asc=False)
    least = possible.groupBy("search_id").agg(F.try_element_at(known, F.lit(top_n)).alias("least"))
    needed = possible.join(least, "search_id").where("least IS NULL OR best >= least")
    return needed.select(*searches.columns, *CELL, "least")


def recommend_many(
    sales: DataFrame, searches: DataFrame, top_n: int = 5, threshold: float = C.GEM_THRESHOLD,
    predicted: DataFrame | None = None, tie: str = "id_mutation",
) -> DataFrame:
    """``recommend`` for a table of searches
    (search_id, budget, wanted, surface_min, surface_max, pieces_min).

    The score does not depend on the search, so gems are found once. A search meets the
    gems of those cells only that can hold one of its best, and of these gems those
    that reach what is known to be reached (``cells_to_search``). The rank filter is
    applied per task before the shuffle, which then carries at most top_n rows per
    search and task.
    """
    gems = stage(gem_cells(scored_sales(sales, predicted).where(F.col("gem_score") >= threshold)))
    needed = cells_to_search(cell_index(gems, top_n), searches, top_n)
    reached = F.col("least").isNull() | (F.col("gem_score") >= F.col("least"))
    matches = gems.join(needed, CELL).where(reached & _fits("surface_min", "surface_max", "pieces_min", "budget"))
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("gem_score"), tie))
    return matches.withColumn("rank", rank).where(F.col("rank") <= top_n).drop("band", "rooms", "total", "least").transform(_presented)


# -- listings ---------------------------------------------------------------------------


def locate_listings(listings: DataFrame, table: dict | None = None) -> DataFrame:
    """Missing coordinates: the district's centre, else the city's."""
    table = table or C.LISTING_CENTROIDS
    return listings.withColumns(
        {
            "latitude": F.coalesce("latitude", geo.centroid_lat("arrondissement", table), F.lit(C.CENTER[0])),
            "longitude": F.coalesce("longitude", geo.centroid_lon("arrondissement", table), F.lit(C.CENTER[1])),
        }
    )


def snap_coordinates(requests: DataFrame) -> DataFrame:
    """Coordinates too far from the declared district move to its centre."""
    far = geo.is_far_from_centroid("latitude", "longitude", "arrondissement")
    return requests.withColumns(
        {
            "snapped": far,
            "latitude": F.when(far, geo.centroid_lat("arrondissement")).otherwise(F.col("latitude")),
            "longitude": F.when(far, geo.centroid_lon("arrondissement")).otherwise(F.col("longitude")),
        }
    )


def score_listings(listings: DataFrame, predicted: str | None = None) -> DataFrame:
    """Every listing with its score; ``predicted`` names the €/m² column of a model,
    without one the fixed district prices are used."""
    price_m2 = F.col(predicted) if predicted else pricing.fallback_price_m2("arrondissement")
    area, asked = F.col("surface"), F.col("prix_annonce")
    return listings.withColumn("prix_predit_m2", price_m2).withColumns(
        {
            "prix_predit": F.col("prix_predit_m2") * area,
            "prix_affiche_m2": asked / area,
            "gem_score": pricing.asking_gem_score("prix_predit_m2", asked, area),
            "gain_potentiel": pricing.listing_gain(F.col("prix_predit_m2") * area, asked),
        }
    ).withColumn("sous_evaluation_pct", F.col("gem_score") * 100)


def listing_gems(listings: DataFrame, predicted: str | None = None) -> DataFrame:
    return score_listings(listings, predicted).where(pricing.is_gem("gem_score"))


def browse_gems(gems: DataFrame, min_gem_score: float = 0.0, arrondissement=None, min_surface=None, max_price=None) -> DataFrame:
    """Optional filters (zero or none = no filter), best first."""
    rows = gems.where(F.coalesce("gem_score", F.lit(0.0)) >= min_gem_score)
    if arrondissement:
        rows = rows.where(F.col("arrondissement") == arrondissement)
    if min_surface:
        rows = rows.where(F.coalesce("surface", F.lit(0.0)) >= min_surface)
    if max_price:
        rows = rows.where(F.coalesce("prix_annonce", F.lit(0.0)) <= max_price)
    ties = [c for c in ("id_mutation", "url", "titre", "prix_annonce") if c in rows.columns]
    return rows.orderBy(F.desc("gem_score"), *ties)


def best_listing(gems: DataFrame, tie: str = "id_mutation") -> DataFrame:
    """The single best listing with a positive score."""
    positive = gems.where(F.col("gem_score") > 0)
    key = F.struct(F.col("gem_score").alias("a"), (-F.col(tie)).alias("b"))
    return positive.agg(F.max_by(F.struct(*gems.columns), key).alias("best")).where(F.col("best").isNotNull()).select("best.*")


def price_adjustments(rows: DataFrame, predicted: str = "prix_m2_predit") -> DataFrame:
    """Corrected and net price, margin, score and gain of analysed listings.

    Expects etage, dpe_classe, exposition, renovation_score (0-1), and the vision
    columns vision_score, luminosite, hauteur_plafond, qualite_generale (null
    without photos), plus surface, prix_annonce and days_on_market.
    """
    renovation = F.when(
        F.col("vision_score").isNotNull(),
        pricing.vision_renovation_factor("vision_score", "luminosite", "hauteur_plafond", "qualite_generale"),
    ).otherwise(pricing.keyword_renovation_factor("renovation_score"))
    factors = rows.withColumns(
        {
            "floor_corr": pricing.floor_factor("etage"),
            "dpe_corr": pricing.energy_factor("dpe_classe"),
            "reno_corr": renovation,
            "expo_corr": pricing.exposure_factor("exposition"),
            "reno_cost_m2": pricing.works_cost_m2("vision_score"),
            "negotiation_margin": pricing.margin_by_days("days_on_market"),
        }
    )
    priced = factors.withColumn(
        "prix_corrige_m2", pricing.corrected_price_m2(predicted, "floor_corr", "dpe_corr", "reno_corr", "expo_corr")
    ).withColumn("prix_net_m2", pricing.net_price_m2("prix_corrige_m2", "reno_cost_m2"))
    score = pricing.asking_gem_score("prix_net_m2", "prix_annonce", "surface", F.col("negotiation_margin"))
    total = F.floor(F.col("prix_corrige_m2") * F.col("surface"))
    gain = pricing.listing_gain(total, "prix_annonce", F.col("negotiation_margin"))
    return priced.withColumns(
        {
            "gem_score": F.when(F.col("prix_net_m2") > 0, score).when(F.col("prix_net_m2").isNotNull(), 0.0),
            "prix_predit_total": total,
            "gain_potentiel": F.when(gain.isNotNull(), F.greatest(F.lit(0), F.floor(gain))),
        }
    ).withColumn("is_hidden_gem", pricing.is_gem("gem_score"))
