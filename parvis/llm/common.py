"""What the operators share: table access, words, ASCII lower case."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parvis.session import shared_path, stage, stage_by

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "ascii_lower", "fold", "forget", "release", "shared_path", "stage", "stage_by", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """All words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now: it does so when the driver forgets them."""
    for _ in range(2):  # what the first round frees may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def forget(rows: DataFrame) -> None:
    """Remove a table of ``stage`` that nothing reads any more."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in rows.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
