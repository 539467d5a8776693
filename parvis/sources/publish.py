"""Publishing a run: a new folder beside the old ones, then one atomic rename of a pointer.

Readers follow the pointer, so they see the old run or the new one, never parts of
both; a write that dies on the way leaves a folder nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

POINTER = "CURRENT"


def new_run(path: str) -> str:
    """A folder for the next run below ``path``; nothing is created yet."""
    return f"{path}/runs/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, run: str) -> None:
    """Make ``run`` the one that ``current`` names. The run must be complete."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    made, pointer = hadoop.Path(f"{path}/_{POINTER}-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/{POINTER}")
    out = made.getFileSystem(conf).create(made)
    out.write(bytearray(run.rsplit("/", 1)[-1], "utf-8"))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files = hadoop.FileContext.getFileContext(pointer.toUri(), conf)
    files.rename(files.makeQualified(made), files.makeQualified(pointer), overwrite)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the published run, None if there is none."""
    try:
        return f"{path}/runs/{spark.read.text(f'{path}/{POINTER}').first()[0]}"
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
