import gzip

from parvis.catalog.source_queries import YEAR, _register_files
from parvis.sources import tables


def test_a_department_may_come_in_several_files(spark, tmp_path):
    folder = tmp_path / "2023" / "departements"
    folder.mkdir(parents=True)
    header = ",".join(tables.REGISTER_COLUMNS)
    empty = "," * (len(tables.REGISTER_COLUMNS) - 1)
    for name, key in (("75.0", "a"), ("75.1", "b"), ("77", "c"), ("76.0", "d"), ("750.0", "e")):
        with gzip.open(folder / f"{name}.csv.gz", "wt") as f:
            f.write(f"{header}\n{key}{empty}\n")
    rows = tables.read_departments(spark, str(tmp_path), 2023, ["75", "77"], checked=True)
    assert sorted((r.id_mutation, r.code_departement_source, r._corrupt) for r in rows.collect()) == [("a", "75", None), ("b", "75", None), ("c", "77", None)]


def test_a_department_is_written_by_several_tasks(spark, tmp_path):
    days = spark.range(400, numPartitions=4).selectExpr(
        "id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "DATE '2023-01-05' AS l_shipdate",
        "100000.0D AS l_extendedprice", "20.0D AS l_quantity",
    )
    days.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "'STANDARD' AS p_type", "'x' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    root = _register_files(spark, str(tmp_path))
    for department in ("75", "76", "77", "78"):
        files = spark.read.option("header", True).csv(f"{root}/{YEAR}/departements/{department}.*csv.gz")
        assert len(files.inputFiles()) > 1 and files.count() == 100
