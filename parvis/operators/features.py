"""The 26 model features and the leakage-free training frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.geo import filled_lat, filled_lon, haversine
from parvis.functions.numbers import clip
from parvis.operators.cleaning import SALE_COLUMNS, complete_cases
from parvis.operators.encodings import Encodings, attach_encodings, attach_recent, fit_encodings
from parvis.operators.recent import with_trailing_median
from parvis.session import stage


def carrez_ratio(area: Column) -> Column:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in C.CARREZ_COLUMNS), F.lit(0.0))
    return F.when(total > 0, clip(total / area, 0.5, 2.0)).otherwise(1.0)


def derive_features(df: DataFrame) -> DataFrame:
    """Feature columns of rows that already carry their encodings and recent price."""
    area = clip("surface_reelle_bati", low=1.0)
    rooms = F.greatest(F.coalesce(F.col("nombre_pieces_principales").cast("double"), F.lit(2.0)), F.lit(1.0))
    lat, lon = filled_lat(), filled_lon()
    premium = F.col("arrondissement").isin(C.PREMIUM_DISTRICTS).cast("int")
    month = F.coalesce(F.col("mois"), F.lit(6))

    first = df.withColumns(
        {
            "log_surface": F.log1p(area),
            "pieces_per_m2": clip(rooms / area, 0.005, 0.5),
            "surface_per_piece": clip(area / rooms, 5.0, 500.0),
            "carrez_ratio": carrez_ratio(area),
            "dist_center_km": haversine(lat, lon, *C.CENTER),
            "latitude": lat,
            "longitude": lon,
            "lat_sq": lat * lat,
            "lon_sq": lon * lon,
            "lat_lon_cross": lat * lon,
            "is_premium_arr": premium,
            "nombre_pieces_principales": rooms,
            "trimestre": F.coalesce(F.col("trimestre"), F.floor((month - 1) / 3).cast("int") + 1),
            "annee": F.coalesce(F.col("annee"), F.lit(2023)),
        }
    )
    return first.withColumns(
        {
            "arr_price_x_log_surface": F.col("arr_target_enc") * F.col("log_surface"),
            "premium_x_log_surface": F.col("is_premium_arr") * F.col("log_surface"),
            "premium_x_dist_center": F.col("is_premium_arr") * F.col("dist_center_km"),
            "voie_x_density": F.col("voie_recent_prix_m2") * F.col("pieces_per_m2"),
        }
    )


def fill_poi_defaults(df: DataFrame) -> DataFrame:
    present = set(df.columns)
    out = df.withColumns({c: F.lit(v) for c, v in C.POI_DEFAULTS.items() if c not in present})
    out = out.withColumn("dist_centre_paris_km", haversine(filled_lat(), filled_lon(), *C.CENTER))
    return out.fillna({c: v for c, v in C.POI_DEFAULTS.items() if c in present})


def featurise(df: DataFrame, enc: Encodings) -> DataFrame:
    """All features of ``df``; the recent price is looked up unless already there."""
    out = attach_encodings(df, enc)
    if "voie_recent_prix_m2" in df.columns:
        out = out.withColumn("voie_recent_prix_m2", F.coalesce("voie_recent_prix_m2", enc.mean))
    else:
        out = attach_recent(out, enc)
    return fill_poi_defaults(derive_features(out))


def feature_matrix(df: DataFrame, enc: Encodings, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Features and target as doubles, complete rows only."""
    columns = columns or C.FEATURES
    cast = [F.col(c).cast("double").alias(c) for c in [*columns, C.TARGET]]
    kept = [c for c in keep if c not in columns and c != C.TARGET]
    return complete_cases(featurise(df, enc).select(*kept, *cast), [*columns, C.TARGET])


# -- splits ---------------------------------------------------------------------------


def _residue(key: str, shift: int, multiplier: int, df: DataFrame) -> Column:
    """0..99, spread by a small multiplier; depends on the key only, so a row is
    always on the same side whatever the partitioning."""
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("bigint") if kind in ("int", "bigint", "smallint") else F.xxhash64(key)
    part = F.pmod(F.floor(number / shift) if shift > 1 else number, F.lit(100))
    return F.pmod(part * multiplier, F.lit(100))


def train_bucket(df: DataFrame, key: str = "id_mutation") -> Column:
    return _residue(key, 1, 7919, df)


def split_train_test(df: DataFrame, train_pct: int = 80, key: str = "id_mutation") -> tuple[DataFrame, DataFrame]:
    bucket = train_bucket(df, key)
    return df.where(bucket < train_pct), df.where(bucket >= train_pct)


def validation_flag(df: DataFrame, pct: int = 10, key: str = "id_mutation") -> Column:
    """Marks a share of the training rows for early stopping."""
    return _residue(key, 100, 7919, df) < pct


def fold_number(df: DataFrame, folds: int = 5, key: str = "id_mutation") -> Column:
    return F.pmod(_residue(key, 100, 7919, df), F.lit(folds)).cast("int")


def training_frame(
    sales: DataFrame, smoothed: bool = False, fine: bool = False, key: str = "id_mutation",
    columns: list[str] | None = None, keep: list[str] = (), hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, Encodings]:
    """Split, then learn everything from the training rows only.

    The sales are written once, as they feed the split, every encoding and both
    feature tables. Training rows see the trailing median of their street within the training
    set (never their own or a later day); test rows see the lookups.
    """
    used = [*SALE_COLUMNS, C.TARGET, "annee", "mois", "trimestre", key, *(columns or []), *keep]
    sales = stage(sales.select(*[c for c in dict.fromkeys(used) if c in sales.columns]))
    train, test = split_train_test(sales, key=key)
    enc = fit_encodings(train, smoothed=smoothed, fine=fine)
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    seen = with_trailing_median(train, **options)
    return (
        feature_matrix(seen, enc, columns, [key, *keep]),
        feature_matrix(test, enc, columns, [key, *keep]),
        enc,
    )
