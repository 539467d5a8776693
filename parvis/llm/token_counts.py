"""Exact histogram of encoded lengths; its suffix sums answer every question about context limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis.llm import bpe
from parvis.llm.common import stage

WIDTH = 1024  # lengths per block of the suffix sums
RANKS = (0.25, 0.5, 0.75, 0.9, 0.99)


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per encoded length: n_tokens, docs. Null and empty texts have length 0."""
    lengths = docs.select(bpe.encoded_length(F.col(text), path or bpe.default_path()).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """For every occurring length taken as the context limit, what fits and what is cut.

    docs_up_to, docs_over: documents of at most, of more than so many tokens;
    tokens_up_to, tokens_over: their tokens; truncated_total: tokens left when each
    document is cut to the limit; dropped_tokens: tokens cut off; total_docs,
    total_tokens: of all; rank_up_to: share of documents that fit. A limit that does
    not occur has the docs_up_to of the next lower one, and truncated_total =
    tokens_up_to + limit * docs_over. An empty histogram gives no rows.

    Sums run over blocks of ``WIDTH`` lengths first, so no window holds all lengths.
    """
    rows = stage(histogram.withColumn("block", F.floor(F.col("n_tokens") / WIDTH)))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    low = blocks.select(F.col("block").alias("b"), "d", "t")
    before = (
        blocks.select("block").join(low, F.col("b") < F.col("block"), "left").groupBy("block")
        .agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d0"), F.coalesce(F.sum("t"), F.lit(0)).alias("t0"))
    )
    total = blocks.agg(F.sum("d").alias("total_docs"), F.sum("t").alias("total_tokens"))
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"dw": F.sum("docs").over(within), "tw": F.sum(F.col("docs") * F.col("n_tokens")).over(within)})
    out = summed.join(F.broadcast(before), "block").crossJoin(F.broadcast(total))
    out = out.withColumns({"docs_up_to": F.col("dw") + F.col("d0"), "tokens_up_to": F.col("tw") + F.col("t0")})
    out = out.withColumns({"docs_over": F.col("total_docs") - F.col("docs_up_to"), "tokens_over": F.col("total_tokens") - F.col("tokens_up_to")})
    out = out.withColumn("truncated_total", F.col("tokens_up_to") + F.col("n_tokens") * F.col("docs_over"))
    return out.select(
        "n_tokens", "docs", "docs_up_to", "docs_over", "tokens_up_to", "tokens_over", "truncated_total",
        (F.col("total_tokens") - F.col("truncated_total")).alias("dropped_tokens"),
        "total_docs", "total_tokens", (F.col("docs_up_to") / F.col("total_docs")).alias("rank_up_to"),
    )


def quantile_of(ranks=RANKS) -> Column:
    """Over a row of ``context_report``: the ``ranks`` whose quantile its length is, as ``length_quantiles`` has them."""
    wanted = lambda r: F.ceil(F.lit(r) * F.col("total_docs"))
    here = [F.when((F.col("docs_up_to") >= wanted(r)) & (F.col("docs_up_to") - F.col("docs") < wanted(r)), F.lit(r)) for r in ranks]
    return F.filter(F.array(*here), lambda r: r.isNotNull())


def length_quantiles(report: DataFrame, ranks=RANKS) -> DataFrame:
    """The smallest length that a share ``rank`` of the documents does not exceed; no rows without documents."""
    wanted = [F.when(F.col("docs_up_to") >= F.ceil(F.lit(r) * F.col("total_docs")), F.col("n_tokens")) for r in ranks]
    row = report.agg(*[F.min(w).alias(f"q{i}") for i, w in enumerate(wanted)])
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"q{i}").alias("n_tokens")) for i, r in enumerate(ranks)])
    return row.select(F.inline(pairs)).where("n_tokens IS NOT NULL")
