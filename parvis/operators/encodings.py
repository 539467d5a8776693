"""Target encodings and their lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.geo import district, filled_lat, filled_lon, grid_id
from parvis.operators.quantiles import group_medians

GRID_KEYS = ["grid_lat", "grid_lon"]


def with_keys(df: DataFrame) -> DataFrame:
    """The three location keys: district, street, 0.01-degree cell (two integers)."""
    return df.withColumns(
        {
            "arrondissement": district(),
            "adresse_code_voie": F.col("adresse_code_voie").cast("string"),
            "grid_lat": grid_id(filled_lat()),
            "grid_lon": grid_id(filled_lon()),
        }
    )


def global_mean(train: DataFrame) -> Column:
    """Mean target as a scalar subquery, evaluated once per query."""
    return train.agg(F.avg(C.TARGET)).scalar()


def shrunk(mean, count, overall, k: int = C.SMOOTHING) -> Column:
    return (count * mean + F.lit(k) * overall) / (count + F.lit(k))


def plain_encoding(train: DataFrame, keys: list[str], name: str) -> DataFrame:
    return with_keys(train).where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.avg(C.TARGET).alias(name))


def smoothed_encoding(train: DataFrame, keys: list[str], name: str, overall: Column | None = None) -> DataFrame:
    """Group mean pulled towards the overall mean by group size."""
    overall = global_mean(train) if overall is None else overall
    stats = (
        with_keys(train)
        .where(F.col(keys[0]).isNotNull())
        .groupBy(*keys)
        .agg(F.avg(C.TARGET).alias("_m"), F.count(C.TARGET).alias("_n"))
    )
    return stats.select(*keys, shrunk(F.col("_m"), F.col("_n"), overall).alias(name))


def recent_rows(train: DataFrame, months: int = C.LOOKUP_MONTHS) -> DataFrame:
    """Sales of the last ``months`` calendar months up to the newest sale."""
    cutoff = train.agg(F.add_months(F.max("date_mutation"), -months)).scalar()
    return train.where(F.col("date_mutation") >= cutoff)


def recent_street_medians(train: DataFrame, months: int = C.LOOKUP_MONTHS) -> DataFrame:
    rows = with_keys(recent_rows(train, months))
    return group_medians(rows, ["adresse_code_voie"], C.TARGET, "street_recent").drop("n")


def recent_district_medians(train: DataFrame, months: int = C.LOOKUP_MONTHS) -> DataFrame:
    rows = with_keys(recent_rows(train, months))
    return group_medians(rows, ["arrondissement"], C.TARGET, "district_recent", bounded_keys=True).drop("n")


@dataclass
class Encodings:
    """Lookup tables learnt from training rows only. Absent tables fall through
    to the next coarser level."""

    overall: Column | float
    district: DataFrame | None = None
    street: DataFrame | None = None
    grid: DataFrame | None = None
    street_recent: DataFrame | None = None
    district_recent: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @property
    def mean(self) -> Column:
        return self.overall if isinstance(self.overall, Column) else F.lit(float(self.overall))


def fit_encodings(train: DataFrame, smoothed: bool = False, fine: bool = False) -> Encodings:
    """Encodings of a training set.

    ``smoothed`` shrinks the district means; ``fine`` adds the street and grid
    encodings (always shrunk).
    """
    overall = global_mean(train)
    make = smoothed_encoding if smoothed else plain_encoding
    return Encodings(
        overall=overall,
        district=make(train, ["arrondissement"], "arr_enc"),
        street=smoothed_encoding(train, ["adresse_code_voie"], "voie_enc", overall) if fine else None,
        grid=smoothed_encoding(train, GRID_KEYS, "grid_enc", overall) if fine else None,
        street_recent=recent_street_medians(train),
        district_recent=recent_district_medians(train),
    )


def attach_encodings(df: DataFrame, enc: Encodings) -> DataFrame:
    """Left lookups with fallbacks: grid -> street -> district -> overall mean."""
    out = with_keys(df)
    district_value, street_value, grid_value = enc.mean, None, None
    if enc.district is not None:  # at most 100 rows
        out = out.join(F.broadcast(enc.district), "arrondissement", "left")
        district_value = F.coalesce("arr_enc", enc.mean)
    if enc.street is not None:
        out = out.join(enc.street, "adresse_code_voie", "left")
        street_value = F.col("voie_enc")
    if enc.grid is not None:
        out = out.join(enc.grid, GRID_KEYS, "left")
        grid_value = F.col("grid_enc")
    out = out.withColumn("arr_target_enc", district_value)
    out = out.withColumn(
        "voie_target_enc", F.col("arr_target_enc") if street_value is None else F.coalesce(street_value, "arr_target_enc")
    )
    out = out.withColumn(
        "grid_target_enc", F.col("voie_target_enc") if grid_value is None else F.coalesce(grid_value, "voie_target_enc")
    )
    return out.drop("arr_enc", "voie_enc", "grid_enc")


def attach_recent(df: DataFrame, enc: Encodings) -> DataFrame:
    """Recent price of the street, else of the district, else the overall mean."""
    out = with_keys(df)
    parts = []
    if enc.street_recent is not None:
        out = out.join(enc.street_recent, "adresse_code_voie", "left")
        parts.append(F.col("street_recent"))
    if enc.district_recent is not None:  # at most 100 rows
        out = out.join(F.broadcast(enc.district_recent), "arrondissement", "left")
        parts.append(F.col("district_recent"))
    return out.withColumn("voie_recent_prix_m2", F.coalesce(*parts, enc.mean)).drop("street_recent", "district_recent")
