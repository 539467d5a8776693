"""Exact group quantiles that no single task has to hold.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here each group is first reduced to (value, count) pairs on the map side, the
pairs are summed per logarithmic value bucket, and only the buckets that contain
a wanted rank are opened. What one task sorts is the distinct values of one
bucket of one group (a bucket is 0.5 % wide), never a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parvis.functions.numbers import as_col

BUCKETS_PER_OCTAVE = 128
CROWDED = 10_000


def log_bucket(value, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Monotone map of a double to integers, ``per_octave`` of them per power of two
    (about 550,000 in all at the default); never null, so that joins on it push no
    null test below the shuffle and the shuffle is reused."""
    v = as_col(value)
    offset = 1100 * per_octave  # beyond the exponent range of a double
    size = F.floor(F.log2(F.abs(v)) * per_octave) + offset
    return F.coalesce(F.when(v > 0, size).when(v < 0, -size), F.lit(0).cast("bigint"))


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    bounded_keys: bool = False,
    continuous: bool = False,
    crowded: int = CROWDED,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one output column per entry of ``probs``.

    Also returns ``n``, the number of non-null values. Rows with a null key or
    value are ignored. ``bounded_keys`` states that the number of groups has a
    fixed bound (districts, kinds), so the selected buckets, two per quantile
    and group, may be broadcast. Otherwise (streets) most groups are small: those
    up to ``crowded`` distinct values are aggregated directly, only the others go
    by buckets, and joins are left to AQE, which goes by measured sizes. ``continuous`` is for values without a fixed
    grid, such as errors or scores: an opened bucket, which may hold any number
    of distinct values, is cut into 4096 once more before it is opened.
    """
    groups = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    small = bounded_keys or not keys

    def position(p: float) -> Column:
        return (F.col("n") - 1).cast("double") * F.lit(float(p))

    def holds(rank: Column, size: str) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col(size))

    levels = [BUCKETS_PER_OCTAVE, BUCKETS_PER_OCTAVE * 4096][: 2 if continuous else 1]
    names = [f"_b{i}" for i in range(len(levels))]
    counts = (
        rows.groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({name: log_bucket("_v", level) for name, level in zip(names, levels)})
    )
    ordinary = None
    if not small:
        large = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > crowded).select(*groups)
        ordinary = _direct_quantiles(counts.join(large, groups, "left_anti"), groups, probs)
        counts = counts.join(large, groups, "left_semi")
    ranks = [f(position(p)) for p in probs.values() for f in (F.floor, F.ceil)]

    opened, held = None, list(groups)
    for name in names:
        along = Window.partitionBy(*held).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        if opened is None:
            totals = counts.groupBy(*held, name).agg(F.sum("_n").alias("_bn"))
            totals = totals.withColumns({"n": F.sum("_bn").over(Window.partitionBy(*held)), "_before": F.lit(0).cast("bigint")})
        else:
            totals = counts.join(opened, held).groupBy(*held, name, "n", "_before").agg(F.sum("_n").alias("_bn"))
        totals = totals.withColumn("_start", F.col("_before") + F.sum("_bn").over(along) - F.col("_bn"))
        opened = totals.where(reduce(lambda a, b: a | b, [holds(r, "_bn") for r in ranks]))
        held = [*held, name]
        opened = opened.select(*held, F.col("_start").alias("_before"), "n")
        opened = F.broadcast(opened) if small else opened

    inside = Window.partitionBy(*held).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(opened, held).withColumn("_start", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))

    picks = []
    for name, p in probs.items():
        picks.append(F.max(F.when(holds(F.floor(position(p)), "_n"), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(holds(F.ceil(position(p)), "_n"), F.col("_v"))).alias(f"_hi_{name}"))
    picked = placed.groupBy(*groups).agg(F.first("n").alias("n"), *picks)

    out = [*keys, "n"]
    for name, p in probs.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (position(p) - F.floor(position(p)))).alias(name))
    result = picked.select(*out)
    return result if ordinary is None else result.unionByName(ordinary)


def _direct_quantiles(counts: DataFrame, groups: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of groups known to have few distinct values, in one aggregation."""
    found = counts.groupBy(*groups).agg(
        F.sum("_n").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_n")).alias("_q")
    )
    return found.select(*groups, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def group_medians(df: DataFrame, keys: list[str], value: str, name: str = "median", bounded_keys: bool = False) -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5}, bounded_keys)
