"""Distances, district and cell arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.numbers import as_col


def haversine(lat1, lon1, lat2, lon2, radius: float = C.EARTH_RADIUS_KM) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    la1, lo1, la2, lo2 = (F.radians(as_col(x)) for x in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = (la2 - la1) / 2, (lo2 - lo1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(h)) * (2 * radius)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, C.EARTH_RADIUS_M)


def district(code_postal="code_postal", missing: int = C.DEFAULT_POSTCODE) -> Column:
    """District number: last two digits of the postcode (at most 100 values)."""
    code = F.coalesce(as_col(code_postal).try_cast("double"), F.lit(float(missing)))
    return F.pmod(code.cast("bigint"), F.lit(100)).cast("int")


def filled_lat(col="latitude") -> Column:
    return F.coalesce(as_col(col), F.lit(C.CENTER[0]))


def filled_lon(col="longitude") -> Column:
    return F.coalesce(as_col(col), F.lit(C.CENTER[1]))


def grid_id(coordinate, step_inverse: float = 100.0) -> Column:
    """Integer cell id: the coordinate rounded (half to even) to 1/step_inverse degrees."""
    return F.rint(as_col(coordinate) * step_inverse).cast("bigint")


def fine_cell(coordinate, step: float = 0.005) -> Column:
    return F.rint(as_col(coordinate) / step).cast("bigint")


def centroid_lat(arrondissement, table=None) -> Column:
    return _centroid(arrondissement, table, 0)


def centroid_lon(arrondissement, table=None) -> Column:
    return _centroid(arrondissement, table, 1)


def _centroid(arrondissement, table, axis) -> Column:
    table = table or C.CENTROIDS
    entries = [x for k, point in table.items() for x in (F.lit(k), F.lit(point[axis]))]
    return F.try_element_at(F.create_map(*entries), as_col(arrondissement).cast("int"))


def is_far_from_centroid(lat, lon, arrondissement, limit_km: float = C.MAX_CENTROID_KM) -> Column:
    distance = haversine(lat, lon, centroid_lat(arrondissement), centroid_lon(arrondissement))
    return F.coalesce(distance > F.lit(limit_km), F.lit(False))


def bounding_box_area(minlat, minlon, maxlat, maxlon) -> Column:
    """Area in m² of a box from its corner coordinates; null corners give 0."""
    height = haversine_m(minlat, minlon, maxlat, minlon)
    width = haversine_m(minlat, minlon, minlat, maxlon)
    return F.coalesce(height * width, F.lit(0.0))


def walkability(distances: dict[str, Column]) -> Column:
    """Score 0-100 from the distance to the nearest place of each class."""
    total = F.lit(0.0)
    for place, (points, reach) in C.WALKABILITY.items():
        part = F.greatest(F.lit(0.0), 1.0 - distances[place] / reach) * points
        total = total + F.when(distances[place].isNotNull(), part).otherwise(0.0)
    return total


def reach_degrees(latitude: Column, radius_m: float) -> Column:
    """Degrees of longitude that two points ``radius_m`` apart can differ at most, neither further from the equator than ``latitude``."""
    share = math.sin(radius_m / 2 / C.EARTH_RADIUS_M)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(share) / F.cos(F.radians(latitude))))) * (1 + 1e-9)
