"""Reading and writing the register, listings, gems and run history."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parvis import constants as C
from parvis.sources.publish import current, new_run, publish

# layout of the published geolocated register files, all read as text
REGISTER_COLUMNS = [
    "id_mutation", "date_mutation", "numero_disposition", "nature_mutation", "valeur_fonciere",
    "adresse_numero", "adresse_suffixe", "adresse_nom_voie", "adresse_code_voie", "code_postal",
    "code_commune", "nom_commune", "code_departement", "ancien_code_commune", "ancien_nom_commune",
    "id_parcelle", "ancien_id_parcelle", "numero_volume",
    *[c for i in range(1, 6) for c in (f"lot{i}_numero", f"lot{i}_surface_carrez")],
    "nombre_lots", "code_type_local", "type_local", "surface_reelle_bati", "nombre_pieces_principales",
    "code_nature_culture", "nature_culture", "code_nature_culture_speciale", "nature_culture_speciale",
    "surface_terrain", "longitude", "latitude",
]
REGISTER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REGISTER_COLUMNS])

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("titre", T.StringType()), T.StructField("arrondissement", T.IntegerType()),
        T.StructField("surface", T.DoubleType()), T.StructField("pieces", T.IntegerType()),
        T.StructField("prix_annonce", T.LongType()), T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()), T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("description", T.StringType()),
    ]
)
GEM_SCHEMA = T.StructType(
    LISTING_SCHEMA.fields
    + [
        T.StructField("photo_url", T.StringType()), T.StructField("prix_predit", T.DoubleType()),
        T.StructField("prix_predit_m2", T.DoubleType()), T.StructField("prix_affiche_m2", T.DoubleType()),
        T.StructField("gem_score", T.DoubleType()), T.StructField("gain_potentiel", T.DoubleType()),
        T.StructField("sous_evaluation_pct", T.DoubleType()),
    ]
)
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("date_mise_a_jour", T.StringType()), T.StructField("nb_annonces_analysees", T.LongType()),
        T.StructField("nb_pepites", T.LongType()), T.StructField("seuil_gem_score", T.DoubleType()),
    ]
)
GEMS_ENVELOPE = T.StructType(
    [T.StructField("metadata", METADATA_SCHEMA), T.StructField("gems", T.ArrayType(GEM_SCHEMA))]
)


def read_register(spark: SparkSession, path: str, fixed_layout: bool = True) -> DataFrame:
    """Register CSV (plain or gzip), every column as text.

    Typing is a later step, so one bad cell never fails a file. Without the fixed
    layout the columns are those of the header.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    if fixed_layout:
        reader = reader.schema(REGISTER_SCHEMA)
    return reader.csv(path)


CORRUPT = "_corrupt"


def read_departments(spark: SparkSession, root: str, year: int, departments: list[str] = C.IDF_DEPARTMENTS, checked: bool = False) -> DataFrame:
    """All department files of a year as one table with ``code_departement_source``.

    A department is one file (``75.csv.gz``) or several (``75.0.csv.gz``, ...). Files of other
    departments are never opened; a department without a file contributes nothing, and without any the result is empty. ``checked`` adds the text
    of lines that do not fit the layout as ``_corrupt``, for ``split_register``.
    """
    names = "{" + ",".join(f"{d}.csv.gz,{d}.*.csv.gz" for d in departments) + "}"
    source = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    schema = T.StructType([*REGISTER_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())]) if checked else REGISTER_SCHEMA
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("pathGlobFilter", names)
    if checked:  # a line can only be judged by all its columns
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    try:
        files = reader.csv(f"{root}/{year}/departements")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("code_departement_source", F.lit(None).cast("string"))
    rows = files.select("*", source.alias("code_departement_source"))
    # a gzip file is one task: rows of few files are dealt out anew before anything else is done with them
    enough = 2 * max(spark.sparkContext.defaultParallelism, len(departments))
    return rows if len(files.inputFiles()) >= enough else rows.hint("rebalance")


NUMBERS = ["valeur_fonciere", "surface_reelle_bati", "nombre_pieces_principales", "longitude", "latitude", "code_postal", "nombre_lots"]


def split_register(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantine) of a checked register; every row is in exactly one of them.

    The quarantine has the department, the line's text and a reason: ``malformed`` for a
    line with too few or too many columns, else the names of the columns whose text is
    no date or number. Empty cells are no fault.
    """
    def unread(name: str, value: Column) -> Column:
        return F.when(F.col(CORRUPT).isNull() & (F.trim(name) != "") & value.isNull(), name)

    checks = [unread("date_mutation", F.try_to_date("date_mutation")), *[unread(c, F.trim(c).try_cast("double")) for c in NUMBERS]]
    reason = F.concat_ws(",", F.when(F.col(CORRUPT).isNotNull(), "malformed"), *checks)
    judged = rows.withColumn("reason", reason)
    line = F.coalesce(CORRUPT, F.to_csv(F.struct(*REGISTER_COLUMNS)))
    bad = judged.where("reason <> ''").select("code_departement_source", line.alias("line"), "reason")
    return judged.where("reason = ''").drop(CORRUPT, "reason"), bad


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Stack tables whose columns may differ."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_sales(sales: DataFrame, path: str) -> None:
    """Clean sales by year, so that period filters skip whole folders. Rows are brought
    together by year first, large years in several parts, so few files are written."""
    sales.hint("rebalance", "annee").write.mode("overwrite").partitionBy("annee").parquet(path)


def read_sales(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def _zone(lat, lon) -> Column:
    """A tenth of a degree in both directions, as one number."""
    return (F.floor(lat * 10) * 10_000 + F.floor(lon * 10)).cast("int")


def write_cells(enriched: DataFrame, path: str) -> None:
    """Cells clustered for point reads: a folder per zone, sorted by cell inside."""
    rows = enriched.withColumn("zone", _zone(F.col("lat_grid"), F.col("lon_grid"))).hint("rebalance", "zone")
    rows.sortWithinPartitions("zone", "lat_grid", "lon_grid").write.mode("overwrite").partitionBy("zone").parquet(path)


def read_cell(spark: SparkSession, path: str, cell: tuple[float, float], columns: list[str] = C.POI_FEATURES) -> DataFrame:
    """A few columns of the rows of one grid cell; both reach the Parquet scan. Of a
    table by ``write_cells`` only the folders the cell lies in are opened."""
    half = 0.0025
    lat, lon = cell
    rows = spark.read.parquet(path)
    if "zone" in rows.columns:
        zones = {math.floor(a * 10) * 10_000 + math.floor(b * 10) for a in (lat - half, lat + half) for b in (lon - half, lon + half)}
        rows = rows.where(F.col("zone").isin(*zones))
    return rows.where(
        F.col("lat_grid").between(lat - half, lat + half) & F.col("lon_grid").between(lon - half, lon + half)
    ).select("lat_grid", "lon_grid", *columns)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING_SCHEMA).option("multiLine", True).json(path)


def read_gems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, gems) of the run published in a folder by ``write_gems``, or of envelope files."""
    run = current(spark, path)
    if run is not None:
        return spark.read.schema(METADATA_SCHEMA).json(f"{run}/metadata"), spark.read.schema(GEM_SCHEMA).json(f"{run}/gems")
    envelope = spark.read.schema(GEMS_ENVELOPE).option("multiLine", True).json(path)
    return envelope.select("metadata.*"), envelope.select(F.inline("gems"))


def gems_metadata(scored: DataFrame, run_date: Column | str, threshold: float = C.GEM_THRESHOLD) -> DataFrame:
    date = F.lit(run_date) if isinstance(run_date, str) else run_date
    return scored.agg(
        F.date_format(date.cast("date"), "yyyy-MM-dd").alias("date_mise_a_jour"),
        F.count(F.lit(1)).alias("nb_annonces_analysees"),
        F.count_if(F.col("gem_score") > threshold).alias("nb_pepites"),
        F.lit(threshold).alias("seuil_gem_score"),
    )


def write_gems(scored: DataFrame, path: str, run_date: str, threshold: float = C.GEM_THRESHOLD) -> None:
    """Gems as JSON lines and a one-row metadata file, published together as a run of their own."""
    run = new_run(path)
    scored.where(F.col("gem_score") > threshold).write.json(f"{run}/gems")
    gems_metadata(scored, run_date, threshold).coalesce(1).write.json(f"{run}/metadata")
    publish(scored.sparkSession, path, run)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The published metrics history, None if there is none."""
    run = current(spark, path)
    return None if run is None else spark.read.parquet(run)


def write_history(new: DataFrame, path: str) -> None:
    """Upsert run metrics (a row per model) into the published history; the history before stays readable until the new one is whole."""
    from parvis.operators.evaluation import upsert_metrics

    spark, run = new.sparkSession, new_run(path)
    history = read_history(spark, path)
    if history is None:
        history = new.limit(0).withColumn("position", F.lit(0))
    upsert_metrics(history, new).coalesce(1).write.parquet(run)
    publish(spark, path, run)


def replace_table(df: DataFrame, path: str, version: str) -> str:
    """Write a new version of a table beside the old one and return its path;
    readers switch by path, so a failed write never damages the old one."""
    target = f"{path}/v={version}"
    df.write.mode("overwrite").parquet(target)
    return target
