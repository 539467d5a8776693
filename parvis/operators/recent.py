"""Trailing median price of a street: the 365 days before each sale.

The result depends on (street, day) only, so it is computed once per street and
day and joined back. Streets are cut into 365-day blocks; a block also gets the
previous block's rows as history, which covers every window that ends in it. An
ordinary block is one window partition. A block above ``hot_rows`` distinct
(day, price) pairs is worked in two passes over day-by-bucket count tables, so
even a street holding a third of all sales is spread over tasks by block and
price bucket. Prices are in cents inside fixed bounds, which bounds each table.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.operators.quantiles import log_bucket

# the task functions travel with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STREET = "adresse_code_voie"
HOT_ROWS = 4096
# per octave: balances the two count tables of a crowded block (about 4,800 buckets
# over the accepted prices, at most 3,400 cents in each)
CROWDED_BUCKETS = 1024


def _street_blocks(sales: DataFrame, days: int) -> DataFrame:
    """(street, day, price, count), twice: as rows of their block and as history of the next."""
    daily = (
        sales.where(F.col(STREET).isNotNull() & F.col("date_mutation").isNotNull() & F.col(C.TARGET).isNotNull())
        .groupBy(
            F.col(STREET).cast("string").alias("street"),
            F.unix_date("date_mutation").alias("day"),
            F.col(C.TARGET).alias("v"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    block = F.floor(F.col("day") / days).cast("int")
    placed = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.struct((block + 1).alias("block"), F.lit(False).alias("own")),
    )
    return daily.select("*", F.inline(placed))


def _window_medians(rows: DataFrame, days: int) -> DataFrame:
    before = Window.partitionBy("street", "block").orderBy("day").rangeBetween(-days, -1)
    return (
        rows.withColumn("m", F.percentile("v", F.lit(0.5), F.col("n")).over(before))
        .where("own")
        # same partitioning as the window: no further shuffle
        .groupBy("street", "block", "day")
        .agg(F.first("m").alias("voie_recent_prix_m2"))
    )


def _ranks_in_window(days_axis, targets, counts, window):
    """Per target day: window counts per column, and the two middle ranks."""
    total = np.vstack([np.zeros((1, counts.shape[1]), dtype=np.int64), counts.cumsum(axis=0)])
    upto = np.searchsorted(days_axis, targets, side="left")
    since = np.searchsorted(days_axis, targets - window, side="left")
    return total[upto] - total[since]


def _table(pdf: pd.DataFrame, column: str):
    days_axis, di = np.unique(pdf["day"].to_numpy(), return_inverse=True)
    cols, ci = np.unique(pdf[column].to_numpy(), return_inverse=True)
    counts = np.zeros((len(days_axis), len(cols)), dtype=np.int64)
    np.add.at(counts, (di, ci), pdf["n"].to_numpy())
    return days_axis, cols, counts


def _bucket_of_median(window: int):
    def locate(pdf: pd.DataFrame) -> pd.DataFrame:
        days_axis, buckets, counts = _table(pdf, "bucket")
        targets = np.unique(pdf.loc[pdf["own"], "day"].to_numpy())
        inside = _ranks_in_window(days_axis, targets, counts, window)
        size = inside.sum(axis=1)
        targets, inside, size = targets[size > 0], inside[size > 0], size[size > 0]
        along = inside.cumsum(axis=1)
        parts = []
        for rank in ((size - 1) // 2, size // 2):
            pick = (along > rank[:, None]).argmax(axis=1)
            row = np.arange(len(pick))
            parts.append(
                pd.DataFrame({"day": targets, "bucket": buckets[pick],
                              "rank": rank - (along[row, pick] - inside[row, pick])})
            )
        out = pd.concat(parts)
        out["street"], out["block"] = pdf["street"].iloc[0], pdf["block"].iloc[0]
        return out[["street", "block", "day", "bucket", "rank"]]

    return locate


def _value_at_rank(window: int):
    def resolve(wanted: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = wanted[["street", "block", "day"]].copy()
        if wanted.empty or pdf.empty:
            return out.iloc[:0].assign(v=pd.Series(dtype="float64"))
        days_axis, values, counts = _table(pdf, "v")
        inside = _ranks_in_window(days_axis, wanted["day"].to_numpy(), counts, window).cumsum(axis=1)
        out["v"] = values[(inside > wanted["rank"].to_numpy()[:, None]).argmax(axis=1)]
        return out

    return resolve


def _table_medians(rows: DataFrame, days: int) -> DataFrame:
    hot = rows.withColumn("bucket", log_bucket("v", CROWDED_BUCKETS))
    wanted = (
        hot.groupBy("street", "block", "day", "bucket", "own")
        .agg(F.sum("n").alias("n"))
        .groupBy("street", "block")
        .applyInPandas(_bucket_of_median(days), "street string, block int, day int, bucket long, rank long")
    )
    cell = ["street", "block", "bucket"]
    values = hot.select(*cell, "day", "v", "n").join(wanted.select(*cell).distinct(), cell, "left_semi")
    return (
        wanted.groupBy(*cell)
        .cogroup(values.groupBy(*cell))
        .applyInPandas(_value_at_rank(days), "street string, block int, day int, v double")
        .groupBy("street", "block", "day")
        .agg(F.avg("v").alias("voie_recent_prix_m2"))
    )


def trailing_medians(sales: DataFrame, days: int = C.WINDOW_DAYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(street, day, voie_recent_prix_m2): the median over ``[day - days, day)``."""
    rows = _street_blocks(sales, days)
    hot = rows.groupBy("street", "block").count().where(F.col("count") > hot_rows).select("street", "block")
    ordinary = _window_medians(rows.join(hot, ["street", "block"], "left_anti"), days)
    crowded = _table_medians(rows.join(hot, ["street", "block"], "left_semi"), days)
    return ordinary.unionByName(crowded).drop("block")


def with_trailing_median(sales: DataFrame, days: int = C.WINDOW_DAYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``voie_recent_prix_m2``; null without an earlier sale or without a street."""
    medians = trailing_medians(sales, days, hot_rows)
    keyed = sales.withColumns(
        {"street": F.col(STREET).cast("string"), "day": F.unix_date("date_mutation")}
    )
    return keyed.join(medians, ["street", "day"], "left").drop("street", "day")
