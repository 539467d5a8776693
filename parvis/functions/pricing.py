"""Price corrections, margins and under-pricing scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.numbers import as_col, clip, lookup


def sale_gem_score(predicted, paid) -> Column:
    """Relative under-pricing of a recorded sale: no negotiation margin."""
    p = as_col(predicted)
    return (p - as_col(paid)) / clip(p, low=1.0)


def asking_gem_score(predicted, asked_total, area, margin=C.NEGOTIATION_MARGIN) -> Column:
    """Relative under-pricing of an asking price, net of the expected discount."""
    p = as_col(predicted)
    expected = as_col(asked_total) * (1 - as_col(margin)) / as_col(area)
    return (p - expected) / p


def is_gem(score) -> Column:
    return F.coalesce(as_col(score) > C.GEM_THRESHOLD, F.lit(False))


def margin_by_days(days) -> Column:
    d = as_col(days)
    out = F.when(d.isNull(), C.NEGOTIATION_MARGIN)
    for limit, margin in C.MARGIN_BY_DAYS:
        out = out.when(d <= limit, margin)
    return out.otherwise(C.MARGIN_STALE)


def rooms_from_area(area) -> Column:
    a = as_col(area)
    out = None
    for limit, rooms in C.ROOMS_BY_AREA:
        out = F.when(a < limit, rooms) if out is None else out.when(a < limit, rooms)
    large = F.greatest(F.lit(C.ROOMS_LARGE_MIN), F.rint(a / C.ROOMS_LARGE_AREA).cast("int"))
    return out.when(a.isNotNull(), large)


def floor_factor(floor_no) -> Column:
    top = max(C.FLOOR_FACTORS)
    f = as_col(floor_no)
    return F.when(f.isNull(), 1.0).otherwise(lookup(F.least(f, F.lit(top)), C.FLOOR_FACTORS, C.FLOOR_FACTORS[top]))


def energy_factor(label) -> Column:
    return lookup(as_col(label), C.ENERGY_FACTORS, 1.0)


def exposure_factor(label) -> Column:
    return lookup(as_col(label), C.EXPOSURE_FACTORS, 1.0)


def keyword_renovation_factor(score) -> Column:
    return C.RENOVATION_BASE + as_col(score) * C.RENOVATION_SLOPE


def vision_renovation_factor(score, light, ceiling, quality) -> Column:
    return (
        lookup(as_col(score), C.VISION_RENOVATION, 1.0)
        * lookup(as_col(light), C.VISION_LIGHT, 1.0)
        * lookup(as_col(ceiling), C.VISION_CEILING, 1.0)
        * lookup(as_col(quality), C.VISION_QUALITY, 1.0)
    )


def corrected_price_m2(predicted, floor_f, energy_f, renovation_f, exposure_f) -> Column:
    return (
        as_col(predicted) * C.MARKET_TREND * as_col(floor_f) * as_col(energy_f)
        * as_col(renovation_f) * as_col(exposure_f)
    )


def works_cost_m2(vision_score) -> Column:
    return lookup(as_col(vision_score), C.WORKS_COST_M2, 0.0)


def net_price_m2(price_m2, cost_m2) -> Column:
    p = as_col(price_m2)
    return F.when(p.isNotNull(), F.greatest(p - as_col(cost_m2), p * C.WORKS_FLOOR))


def listing_gain(predicted_total, asked_total, margin=C.NEGOTIATION_MARGIN) -> Column:
    return as_col(predicted_total) - as_col(asked_total) * (1 - as_col(margin))


def fallback_price_m2(arrondissement) -> Column:
    return lookup(as_col(arrondissement), C.FALLBACK_PRICE_M2, C.FALLBACK_PRICE_DEFAULT)


def gem_tier(discount_pct) -> Column:
    out = None
    for limit, label in C.GEM_TIERS:
        cond = as_col(discount_pct) >= limit
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(C.GEM_TIER_OTHER)


def recency_weight(year) -> Column:
    y = F.coalesce(as_col(year).cast("double"), F.lit(float(C.WEIGHT_YEAR)))
    return F.greatest(F.lit(C.WEIGHT_MIN), 1.0 + (y - C.WEIGHT_YEAR) * C.WEIGHT_SLOPE)


def confidence_band(predicted, half_width=None) -> tuple[Column, Column]:
    half = F.lit(C.BAND_HALF_WIDTH) if half_width is None else F.coalesce(as_col(half_width), F.lit(C.BAND_HALF_WIDTH))
    return as_col(predicted) - half, as_col(predicted) + half
