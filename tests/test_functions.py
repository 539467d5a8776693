import math

import pytest
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions import geo, numbers, pricing
from parvis.functions import text as X

L = F.lit


def test_haversine(one_row):
    zero, london = one_row(geo.haversine(L(48.8566), L(2.3522), *C.CENTER), geo.haversine(L(51.5074), L(-0.1278), *C.CENTER))
    assert zero == pytest.approx(0.0, abs=1e-6)
    assert 330 < london < 350


def test_district(one_row):
    assert one_row(geo.district(L(75016)), geo.district(L(None)), geo.district(L(None), 0), geo.district(L("75020"))) == (16, 1, 0, 20)


def test_centroids_are_in_the_city():
    assert sorted(C.CENTROIDS) == list(range(1, 21)) == sorted(C.LISTING_CENTROIDS)
    for lat, lon in C.CENTROIDS.values():
        assert 48.80 < lat < 48.93 and 2.22 < lon < 2.47


def test_rounding_is_half_even(one_row):
    assert one_row(numbers.round_even(L(48.865), 2), numbers.round_even(L(2.5)), numbers.round_even(L(3.5))) == (48.86, 2.0, 4.0)
    assert one_row(geo.grid_id(L(48.865))) == 4886


def test_clip_keeps_null(one_row):
    assert one_row(numbers.clip(L(None).cast("double"), 1.0, 2.0), numbers.clip(L(9.0), 1.0, 2.0)) == (None, 2.0)


def score(asked, margin=C.NEGOTIATION_MARGIN):
    return pricing.asking_gem_score(L(10_000.0), L(float(asked)), L(65.0), margin)


def test_gem_score(one_row):
    under, over, par, spread, plain = one_row(score(350_000), score(900_000), score(650_000 / 0.93), score(650_000 * 1.07), score(650_000 * 1.07, 0.0))
    assert under > 0.10 and over < 0
    assert abs(par) < 1e-3 and abs(spread) < 5e-3 and plain < -0.05


@pytest.mark.parametrize("area,rooms", [(15, 1), (25, 1), (45, 2), (62, 3), (85, 4), (115, 5), (160, 7), (130, 6)])
def test_rooms_from_area(one_row, area, rooms):
    assert one_row(pricing.rooms_from_area(L(float(area)))) == rooms


@pytest.mark.parametrize("days,margin", [(None, 0.07), (0, 0.05), (30, 0.05), (31, 0.07), (90, 0.07), (180, 0.10), (181, 0.13)])
def test_margin(one_row, days, margin):
    assert one_row(pricing.margin_by_days(L(days).cast("int"))) == margin


def test_factors(one_row):
    assert one_row(pricing.floor_factor(L(None).cast("int")), pricing.floor_factor(L(0)), pricing.floor_factor(L(9))) == (1.0, 0.93, 1.04)
    assert one_row(pricing.energy_factor(L("G")), pricing.energy_factor(L(None).cast("string"))) == (0.85, 1.0)
    assert one_row(pricing.net_price_m2(L(2000.0), L(1500.0)), pricing.works_cost_m2(L(4))) == (1000.0, 1000.0)
    assert one_row(pricing.vision_renovation_factor(L(1), L("Lumineuse"), L("Haute"), L("Premium"))) == pytest.approx(1.08 * 1.02 * 1.015 * 1.02)
    assert one_row(pricing.gem_tier(L(20.0)), pricing.gem_tier(L(15.0)), pricing.gem_tier(L(3.0))) == ("excellent", "tres bon", "bon")
    assert one_row(pricing.recency_weight(L(2025)), pricing.recency_weight(L(2000))) == (1.8, 0.5)


def test_walkability(one_row):
    near = {k: L(0.0) for k in C.WALKABILITY}
    far = {k: L(None).cast("double") for k in C.WALKABILITY}
    assert one_row(geo.walkability(near), geo.walkability(far)) == (100.0, 0.0)


def test_numbers_in_text(one_row):
    texts = ["510 000", "1 234,5", "12d", "", "-3", "1e3"]
    assert one_row(*[X.parse_number(L(t)) for t in texts]) == (510000.0, 1234.5, None, None, -3.0, 1000.0)
    assert one_row(X.parse_int(L("prix")), X.parse_float(L("44,5 ")), X.parse_int(L("7.9"))) == (0, 44.5, 7)


def test_days_since(one_row):
    now = L("2025-01-10")
    values = one_row(*[X.days_since(L(d), now) for d in ("2025-01-01", "2025-01-09T13:00:00+01:00", "2026-01-01", "1990-01-01", "hier")])
    assert values == (9, 0, 0, None, None)


def test_labels(one_row):
    assert one_row(X.address_label(L("12.0"), L("RUE DE LA PAIX"), L(1))) == "12 Rue De La Paix Paris 1er"
    assert one_row(X.address_label(L(None).cast("string"), L(None).cast("string"), L(11))) == "Paris 11e"


def test_log_bucket_is_monotone(spark):
    from parvis.operators.quantiles import log_bucket

    values = sorted([0.0, -1e300, 1e300, -0.5, 0.5, 1e-300, -1e-300, 2000.0, 2000.01, 50_000.0, math.pi])
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", log_bucket("v").alias("b")).orderBy("v").collect()]
    assert got == sorted(got)
