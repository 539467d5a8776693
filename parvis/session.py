"""Session settings the jobs rely on, and the one way lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "parvis", **conf) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # small test tables: keep all threads busy instead of merging into 1 MB partitions
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors reach.

    It is the one ``spark.checkpoint.dir`` names, and where that is unset a folder in
    the warehouse, which is shared as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, listed for ``drop_stages``."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several branches: they then read only the columns
    they need, the plan starts anew, and a lost executor costs a re-read, not a
    recomputation. ``drop_stages`` removes the tables when their results are done.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``stage`` with files dealt by ``column``: joins and groups by it then read the table where it is, without a shuffle.

    The catalog's name of the table goes at once; the files stay like those of ``stage``.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    name = "stage_" + path[-32:]
    df.write.format("parquet").option("path", path).bucketBy(parts, column).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def drop_stages(spark: SparkSession) -> None:
    """Remove what this session has staged; results that still read it must be done."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        folder = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
