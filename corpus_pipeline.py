"""From raw documents to token ids: each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next stage's docs. All stages but the last return the
columns of ``docs``; the last returns the encoding of each document left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parvis.llm import bpe, decontaminate, ngram_join, quality, toxicity
from parvis.llm.common import stage, table

SHINGLE, PERCENT = 5, 80  # near duplicates: words in a shingle, least similarity
KEY, TEXT_KEY = "_row", 1 << 62  # column and least value of the keys of rows that share a doc_id


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their stratum's certified cutoffs."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic token is below one half."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id, once; rows without a doc_id stay.

    Rows that share a doc_id are documents of their own: each of their texts is linked
    by itself, and those that are not linked with each other stay. Of equal rows one stays.
    """
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    shared = stage(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if shared.isEmpty():
        links = ngram_join.linked(named, n=SHINGLE, percent=PERCENT)
        kept = links.where("doc_id = component_id").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").unionByName(nameless).select(docs.columns)
    single = named.join(shared, "doc_id", "left_anti")
    own = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(TEXT_KEY)).bitwiseAND(F.lit((1 << 63) - 1))
    several = stage(named.join(shared, "doc_id", "left_semi").withColumn(KEY, own).dropDuplicates([KEY]))
    rows = single.withColumn(KEY, F.col("doc_id")).unionByName(several)
    links = ngram_join.linked(rows, key=KEY, n=SHINGLE, percent=PERCENT).withColumnRenamed("doc_id", KEY)
    ids = links.join(several.select(KEY, "doc_id"), KEY, "left").withColumn("doc_id", F.coalesce("doc_id", KEY))
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", KEY)).alias("least")).select(F.col(f"least.{KEY}").alias(KEY))
    return rows.join(kept, KEY, "left_semi").drop(KEY).unionByName(nameless).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the whole text and digests of the encoding."""
    rows = bpe.encoded(docs.select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "lang", "source", "ids", *[c.alias(name) for name, c in bpe.digests(rows).items()])


STAGES = [
    ("quality", quality_rules), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("encoding", encoding),
]
#: fitted models and components have no SQL form; tests compare the stages with brute-force versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs

