"""Quality rules whose cutoffs are chosen under a bound on the share of good documents they reject.

Each rule rejects a document whose measure exceeds a cutoff. For every stratum the
cutoffs of a rule form a fixed grid from loose to strict. Labelled documents, each
distinct text once, are the holdout: at a cutoff, the number of good ones rejected
is binomial, and the cutoff is certified if the exact lower tail at the allowed
rate is below the level, which says that the exact upper bound of the rejection
rate is below that rate. The level is divided by strata times rules; along a grid
the tests run in fixed order and stop at the first failure, so they need no further
correction. With probability 1 - ``level`` every certified cutoff of every stratum
rejects at most ``risk`` / rules of the good documents, all rules together at most
``risk``. Among certified cutoffs the one that rejects most bad documents at least
cost in good ones is used; a stratum with too few labels gets none and keeps its
documents.

Only DataFrame functions are used. A null text has no words; a null stratum is a
stratum of its own; labels of unknown documents are ignored; a document with several
labels counts as good if one says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis.llm.common import WORD, stage, words

WINDOW = 8  # words of a repeated passage
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
BROADCAST_STRATA = 10_000  # strata up to which the cutoffs are broadcast; beyond, they are joined
#: cutoffs of each rule, from loose to strict
GRIDS = {
    "symbols": [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeats": [0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1],
    "word_length": [30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0],
}


@dataclass(frozen=True)
class Risk:
    """``risk``: share of good documents that all rules of a stratum may reject; ``level``: chance that some
    bound is broken; ``cost``: rejected bad share that one unit of rejected good share must outweigh."""

    risk: float = 0.02
    level: float = 0.05
    cost: float = 10.0


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Windows of words are compared by 64-bit hashes within one text. Each helper column
    is a projection of its own, since the lambdas below refer to it per element.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_w", words(F.col(text)))
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "_l": F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)),
        "_h": F.when(
            F.size("_w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW))),
        ),
    }).drop("_w")
    rows = rows.withColumns({
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_p": F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    }).drop("_l", "_h")
    same = lambda p, k: F.coalesce(F.get("_p", k)["h"] == p["h"], F.lit(False))
    starts = F.transform("_p", lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
    rows = rows.withColumn("_s", F.sort_array(F.filter(starts, lambda i: i.isNotNull()))).drop("_p")
    steps = F.transform("_s", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_s", k + 1) - i, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("_s")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def measured(docs: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per document: ``row`` (all its columns as they were), ``key``, ``stratum``, ``text_hash`` and the measures."""
    rows = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("_text"), F.col(key).alias("key"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64(F.col(text)).alias("text_hash"),
    )
    return _measured(rows, "_text").drop("_text")


def rule_values() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": per_word("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": per_word("n_repeat_words"),
        "word_length": per_word("word_chars"),
    }


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series after seven steps up."""
    shift = F.log(x * (x + 1) * (x + 2)) + F.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), k below the mean; 1 at or above it, where nothing can be certified.

    Terms are added downwards from k; those left out beyond 12 standard deviations
    are below 1e-30 of the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    ratio = lambda j: (k - j + 1) * (1 - p) / ((n - k + j) * p)
    added = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["total"] + a["term"] * ratio(j)).alias("total")),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first) * added)


def tested_cutoffs(measures: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """One row per stratum, rule and cutoff: good, good_rejected, bad, bad_rejected, p_value, certified."""
    marks = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(quality).alias("good"))
    values = rule_values()
    held = (
        measures.where(~F.col("base_failed")).select("key", "stratum", "text_hash", *[v.alias(r) for r, v in values.items()])
        .join(marks, "key").groupBy("stratum", "text_hash").agg(F.max("good").alias("good"), *[F.first(r).alias(r) for r in values])
    )
    good, bad = F.col("good") > 0, F.col("good") <= 0
    tests = [(r, i, c) for r, grid in GRIDS.items() for i, c in enumerate(grid)]
    counts = held.groupBy("stratum").agg(
        F.count_if(good).alias("good"), F.count_if(bad).alias("bad"),
        *[F.count_if((F.col("good") > 0) & (F.col(r) > c)).alias(f"g_{r}_{i}") for r, i, c in tests],
        *[F.count_if((F.col("good") <= 0) & (F.col(r) > c)).alias(f"b_{r}_{i}") for r, i, c in tests],
    )
    rows = F.array(*[
        F.struct(
            F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
            F.col(f"g_{r}_{i}").alias("good_rejected"), F.col(f"b_{r}_{i}").alias("bad_rejected"),
        )
        for r, i, c in tests
    ])
    strata = held.agg(F.count_distinct("stratum").alias("strata"))
    out = counts.select("stratum", "good", "bad", F.inline(rows)).crossJoin(F.broadcast(strata))
    out = out.withColumn("p_value", binomial_tail(F.col("good_rejected"), F.col("good"), risk.risk / len(GRIDS)))
    alone = F.col("p_value") <= F.lit(risk.level / len(GRIDS)) / F.col("strata")
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("certified", F.min(alone.cast("int")).over(so_far) == 1).drop("strata")


def chosen_cutoffs(tested: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum with a column per rule: the certified cutoff of most use, or null."""
    use = F.coalesce(F.try_divide("bad_rejected", "bad"), F.lit(0.0)) - risk.cost * F.col("good_rejected") / F.col("good")
    best = F.max(F.when(F.col("certified") & (use > 0), F.struct(use.alias("use"), (-F.col("step")).alias("loose"), "cutoff")))
    return tested.groupBy("stratum").pivot("rule", list(GRIDS)).agg(best["cutoff"])


def judged(measures: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """``measures`` with ``kept``: base passed and no rule over its stratum's cutoff. ``measures`` is read twice: stage it."""
    cutoffs = stage(chosen_cutoffs(tested_cutoffs(measures, labels, key, quality, risk), risk).withColumnsRenamed({r: f"cut_{r}" for r in GRIDS}))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    over = F.lit(False)
    for rule, value in rule_values().items():
        over = over | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    return measures.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over).drop(*[f"cut_{r}" for r in GRIDS])


def kept_documents(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id", risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    measures = stage(measured(docs, text, stratum, key))
    return judged(measures, labels, key, risk=risk).where("kept").select("row.*")
