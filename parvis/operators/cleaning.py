"""From raw register rows to the clean, typed, de-duplicated sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parvis import constants as C
from parvis.functions.numbers import in_range, not_nan, round_even

# canonical columns every later step may rely on
SALE_COLUMNS = {
    "id_mutation": None,  # any orderable type
    "date_mutation": "date",
    "valeur_fonciere": "double",
    "surface_reelle_bati": "double",
    "nombre_pieces_principales": "int",
    "type_local": "string",
    "latitude": "double",
    "longitude": "double",
    "code_departement": "string",
    "code_commune": "string",
    "code_postal": "double",
    "adresse_numero": "string",
    "adresse_nom_voie": "string",
    "adresse_code_voie": "string",
    "nombre_lots": "int",
    **{c: "double" for c in C.CARREZ_COLUMNS},
}


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed names; the register's short names spelled out."""
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    present = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in C.RENAMES.items() if new not in present})


def _coerced(field: T.StructField, target: str) -> Column:
    col = F.col(field.name)
    if target == "double":
        return not_nan(col.try_cast("double"))
    if target == "int":
        return not_nan(col.try_cast("double")).try_cast("int")
    if target == "date":
        return F.to_date(col) if not isinstance(field.dataType, T.StringType) else col.try_cast("timestamp_ntz").cast("date")
    return col.cast(target)


def coerce_types(df: DataFrame) -> DataFrame:
    """Type every canonical column; what cannot be read becomes null.

    Columns missing from the source are added as nulls here, once, so that no
    later step has to test for them.
    """
    fields = {f.name: f for f in df.schema.fields}
    typed = {}
    for name, target in SALE_COLUMNS.items():
        if name in fields and target is not None:
            typed[name] = _coerced(fields[name], target)
        elif name not in fields:
            typed[name] = F.lit(None).cast(target or "string")
    return df.withColumns(typed)


def keep_homes(df: DataFrame) -> DataFrame:
    return df.where(F.col("type_local").isin(C.KEPT_TYPES))


def within_hard_bounds(df: DataFrame) -> DataFrame:
    """Inclusive bounds on price, area and their ratio; a missing value fails."""
    area = F.col("surface_reelle_bati")
    return df.where(
        in_range("valeur_fonciere", C.PRICE_BOUNDS)
        & in_range(area, C.AREA_BOUNDS)
        & in_range(F.try_divide(F.col("valeur_fonciere"), area), C.PRICE_M2_BOUNDS)
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep one row per key, the first in a stated total order.

    Filtering on ``row_number() = 1`` lets Spark keep one row per key and task
    before the shuffle (WindowGroupLimit), so a hot key does not travel.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedup_sales(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    if order is None:
        atomic = (T.ArrayType, T.MapType, T.StructType)
        order = [f.name for f in df.schema.fields if f.name != "id_mutation" and not isinstance(f.dataType, atomic)]
    return first_per_key(df, "id_mutation", order)


def add_derived(df: DataFrame) -> DataFrame:
    day = F.col("date_mutation")
    return df.withColumns(
        {
            "prix_m2": round_even(F.col("valeur_fonciere") / F.col("surface_reelle_bati"), 2),
            "annee": F.year(day),
            "mois": F.month(day),
            "trimestre": F.quarter(day),
        }
    )


def clean_sales(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return (
        df.transform(normalise_names)
        .transform(coerce_types)
        .transform(keep_homes)
        .transform(within_hard_bounds)
        .transform(dedup_sales, order)
        .transform(add_derived)
    )


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``errors``, the names of the fields out of their limits."""
    checks = []
    for name, (low, inclusive, high) in C.REQUEST_LIMITS.items():
        col = F.col(name)
        ok = (col >= low) if inclusive else (col > low)
        if high is not None:
            ok = ok & (col <= high)
        missing_ok = F.lit(name in C.REQUEST_OPTIONAL)
        checks.append(F.when(~F.coalesce(ok, missing_ok), F.lit(name)))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_requests(df)
    valid = checked.where(F.size("errors") == 0).drop("errors")
    return valid, checked.where(F.size("errors") > 0)


def route_listings(df: DataFrame, price="prix_annonce", area="surface", district="arrondissement") -> DataFrame:
    """Listings lacking a price, area or district cannot be scored: say what is missing."""
    def lacking(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    missing = F.array_compact(
        F.array(
            lacking(F.col(price) > 0, "prix"),
            lacking(F.col(area) > 0, "surface"),
            lacking(F.col(district).between(1, 20), "arrondissement"),
        )
    )
    return df.withColumn("missing", missing).withColumn(
        "status", F.when(F.size("missing") == 0, "complete").otherwise("needs_input")
    )


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def base_features(df: DataFrame) -> DataFrame:
    """The seven columns of the simple models plus the target, complete rows only."""
    return complete_cases(
        df.select(
            "id_mutation",
            F.col("surface_reelle_bati").cast("double"),
            F.col("nombre_pieces_principales").cast("double"),
            F.pmod(F.coalesce("code_postal", F.lit(float(C.DEFAULT_POSTCODE))), F.lit(100.0)).alias("arrondissement"),
            F.col("longitude").cast("double"),
            F.col("latitude").cast("double"),
            F.col("mois").cast("double"),
            F.coalesce(F.col("nombre_lots").cast("double"), F.lit(1.0)).alias("nombre_lots"),
            F.col(C.TARGET),
        ),
        [*C.BASE_FEATURES, C.TARGET],
    )
