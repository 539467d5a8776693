"""Queries through files: what is written by one step is read back by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.catalog import views as V
from parvis.catalog.error_queries import _RUNS, _runs
from parvis.catalog.gem_queries import _LISTING_SCORE
from parvis.catalog.registry import query
from parvis.operators.cleaning import clean_sales
from parvis.operators.extraction import top_up
from parvis.operators.features import split_train_test
from parvis.plans import recommend as R
from parvis.plans import training
from parvis.session import shared_path, stage
from parvis.sources import tables

# a register with planted faults; department 76 is there, but not asked for
_BAD_DATE, _BAD_PRICE, _BAD_LINE = (f"id_mutation % {n} = 0" for n in (11, 13, 17))
_REASON = f"CASE WHEN {_BAD_LINE} THEN 'malformed' ELSE concat_ws(',', CASE WHEN {_BAD_DATE} THEN 'date_mutation' END, CASE WHEN {_BAD_PRICE} THEN 'valeur_fonciere' END) END"
_ASKED = "code_departement IN ('75', '77', '78')"
YEAR = 2023


def _register_files(spark, d) -> str:
    """The sales as gzip register files, several per department: a gzip file is written and read by one task."""
    sales = V.tx(spark, d)
    known = {c: F.col(c).cast("string") for c in sales.columns if c in tables.REGISTER_COLUMNS}
    known |= {
        "date_mutation": F.expr(f"CASE WHEN {_BAD_DATE} THEN 'n/c' ELSE date_format(date_mutation, 'yyyy-MM-dd') END"),
        "valeur_fonciere": F.expr(f"CASE WHEN {_BAD_PRICE} THEN 'abc' ELSE CAST(valeur_fonciere AS STRING) END"),
        "adresse_nom_voie": F.expr(f"CASE WHEN {_BAD_LINE} THEN 'RUE, 5' ELSE adresse_nom_voie END"),
    }
    rows = sales.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in tables.REGISTER_COLUMNS])
    departments = ("75", "76", "77", "78")
    root = shared_path(spark, "register")
    lines = rows.where(F.col("code_departement").isin(*departments)).withColumn("of", F.col("code_departement"))
    lines.write.partitionBy("of").option("header", True).option("quote", "").option("compression", "gzip").csv(f"{root}/made")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/{YEAR}/departements")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    for department in departments:
        for i, part in enumerate(files.globStatus(hadoop.Path(f"{root}/made/of={department}/part-*")) or []):
            files.rename(part.getPath(), hadoop.Path(folder, f"{department}.{i}.csv.gz"))
    return root


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    return tables.split_register(tables.read_departments(spark, _register_files(spark, d), YEAR, checked=True))


@query(
    views="tx",
    sql=f"""SELECT code_departement AS code_departement_source, CAST(id_mutation AS STRING) AS id_mutation, {_REASON} AS reason, count(*) AS lines
FROM tx WHERE {_ASKED} AND {_REASON} <> '' GROUP BY ALL""",
)
def register_quarantine(spark, d):
    _, bad = _split(spark, d)
    first = F.split_part("line", F.lit(","), F.lit(1)).alias("id_mutation")
    return bad.groupBy("code_departement_source", first, "reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    views="tx",
    sql=f"""SELECT CAST(year(date_mutation) AS INT) AS annee, code_departement AS code_departement_source, count(*) AS ventes, sum(valeur_fonciere) AS total
FROM (SELECT *, row_number() OVER (PARTITION BY id_mutation ORDER BY date_mutation, valeur_fonciere, adresse_code_voie) AS rn FROM tx
 WHERE {_ASKED} AND {_REASON} = '' AND type_local IN ('Appartement', 'Maison') AND valeur_fonciere BETWEEN 10000 AND 30000000
 AND surface_reelle_bati BETWEEN 5 AND 1500 AND valeur_fonciere / surface_reelle_bati BETWEEN 2000 AND 50000)
WHERE rn = 1 AND year(date_mutation) >= 1995 GROUP BY ALL""",
    digits={"total": 2},
)
def register_sales(spark, d):
    """Register files, sound rows, cleaning, Parquet by year, and a reading of some years."""
    good, _ = _split(spark, d)
    path = shared_path(spark, "sales")
    tables.write_sales(clean_sales(good, ["date_mutation", "valeur_fonciere", "adresse_code_voie"]), path)
    years = tables.read_sales(spark, path).where("annee >= 1995")
    return years.groupBy("annee", "code_departement_source").agg(F.count(F.lit(1)).alias("ventes"), F.sum("valeur_fonciere").alias("total"))


@query(
    views="enriched",
    sql=f"""SELECT {', '.join(C.POI_FEATURES)} FROM enriched WHERE lat_grid BETWEEN 48.915e0 - 0.0025e0 AND 48.915e0 + 0.0025e0 AND lon_grid BETWEEN 2.375e0 - 0.0025e0 AND 2.375e0 + 0.0025e0""",
)
def cell_lookup(spark, d):
    path = shared_path(spark, "cells")
    tables.write_cells(V.enriched(spark, d), path)
    return tables.read_cell(spark, path, (48.915, 2.375)).select(*C.POI_FEATURES)


@query(
    views="listings",
    sql=f"""SELECT '2025-01-31' AS date_mise_a_jour, n.nb_annonces_analysees, arrondissement, surface, prix_annonce, gem_score
FROM ({_LISTING_SCORE}), (SELECT count(*) AS nb_annonces_analysees FROM listings) n WHERE gem_score > 0.10e0""",
    digits={"gem_score": 7},
)
def gems_roundtrip(spark, d):
    """Two runs of gems; the second is the one read."""
    path, scored = shared_path(spark, "gems"), R.score_listings(V.listings(spark, d))
    tables.write_gems(scored.limit(0), path, "2025-01-30")
    tables.write_gems(scored, path, "2025-01-31")
    metadata, gems = tables.read_gems(spark, path)
    return gems.crossJoin(F.broadcast(metadata)).select(  # one row of metadata
        "date_mise_a_jour", "nb_annonces_analysees", "arrondissement", "surface", "prix_annonce", "gem_score"
    )


@query(
    views="predictions",
    sql=f"""WITH {_RUNS} SELECT model, "MAE", CASE model WHEN 'flat' THEN 2 WHEN 'mixed' THEN 3 ELSE 1 END AS position FROM runs""",
    digits={"MAE": 4},
)
def metrics_publish(spark, d):
    """A history of two runs, then one run again and a new one."""
    path, runs = shared_path(spark, "metrics"), stage(_runs(spark, d).select("model", "MAE"))
    tables.write_history(runs.where("model <> 'mixed'").withColumn("MAE", F.col("MAE") + F.when(F.col("model") == "flat", 100).otherwise(0)), path)
    tables.write_history(runs.where("model IN ('flat', 'mixed')"), path)
    return tables.read_history(spark, path)


@query(views="clean", sql="SELECT id_mutation, true AS same FROM clean WHERE (id_mutation * 7919) % 100 >= 80")
def model_roundtrip(spark, d):
    """A saved and loaded model predicts what the fitted one does."""
    train, test = split_train_test(stage(V.clean(spark, d)))
    rows = stage(test.select("id_mutation", F.col("prix_m2"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("surface_reelle_bati", "latitude", "longitude")]))
    learn = train.select("id_mutation", "prix_m2", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("surface_reelle_bati", "latitude", "longitude")])
    model = training.fit(learn, training.linear(["surface_reelle_bati", "latitude", "longitude"]))
    path = shared_path(spark, "model")
    training.save_model(model, path, spark)
    both = training.load_model(spark, path).predict(model.predict(rows, "before"), "after")
    return both.select("id_mutation", (F.abs(F.col("before") - F.col("after")) < 1e-6).alias("same"))


@query(sql="SELECT n_name AS titre FROM nation WHERE n_nationkey < 3 UNION ALL SELECT r_name FROM region WHERE r_regionkey < 5")
def reserve_top_up(spark, d):
    found = V.table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_name").alias("titre"))
    reserve = V.table(spark, d, "region").select(F.col("r_name").alias("titre"), F.col("r_regionkey").alias("position"))
    return top_up(found, reserve)
