"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from parvis.llm import bpe, decontaminate, fill_in_middle, licences, main_text, ngram_join, pitman_yor, quality, spelling, token_counts, top_k, toxicity, warc
from parvis.llm.common import fold, shared_path, stage, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; documents with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    field = toxicity.train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "held_out", toxicity.toxicity(F.col("text"), spark, field).alias("found"))
    score = F.col("found.score")
    return rows.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("found.spans").alias("spans"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    rows = licences.scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("doc_id", joined("sentence_ids"), joined("licences"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; cutoffs come from ``labels.quality``."""
    measures = stage(quality.measured(table(spark, sf_dir, "documents")).drop("row"))
    rows = quality.judged(measures, table(spark, sf_dir, "labels"))
    return rows.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; documents with crc32(doc_id) mod 10 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 10) != 0).alias("learn"))
    rows = pitman_yor.scored(docs)
    return rows.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), *[c for c in rows.columns if c != "doc_id"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 3-word shingle sets at 90 per cent."""
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    rows = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[c.alias(name) for name, c in bpe.digests(rows).items()])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context report over all documents, with the quantiles that each length is."""
    report = token_counts.context_report(token_counts.length_histogram(table(spark, sf_dir, "documents")))
    return report.withColumn("quantile_of", token_counts.quantile_of())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    rows = warc.archived(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    number = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words and the form it may be a variant of."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.frequent(runs.select(spelling.misspelt(F.col("run"), F.col("doc_id")).alias("word"))))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", top_k.quantised(F.col("embedding")).alias("vector"))
    return top_k.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle and restored, as digests."""
    rows = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_licences, op3_main_text, op4_quality, op5_language_model, op6_decontamination, op7_ngram_join, op8_bpe, op9_token_counts, op10_warc, op11_spelling_variants, op12_top_k, op13_fill_in_middle)}
SQL: dict[str, str] = {
    "op2_licences": licences.oracle(), "op11_spelling_variants": spelling.SQL, "op12_top_k": top_k.SQL, "op13_fill_in_middle": fill_in_middle.SQL,
}
