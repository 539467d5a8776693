"""Small numeric expressions with the null and rounding rules the jobs need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def round_even(value, digits: int = 0) -> Column:
    """Round half to even after scaling, i.e. on binary doubles.

    ``F.round`` rounds half up and ``F.bround`` works on the decimal rendering;
    both move values that sit on a tie in one representation only.
    """
    scaled = F.rint(as_col(value) * float(10**digits)) if digits else F.rint(as_col(value))
    return scaled / float(10**digits) if digits else scaled


def clip(value, low=None, high=None) -> Column:
    """Bound a value and keep null null (``least``/``greatest`` skip nulls)."""
    col = as_col(value)
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


def is_true(condition: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def lookup(key: Column, table: dict, default=None) -> Column:
    """A literal table of fixed size as an expression; no join, stays in codegen."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def not_nan(value) -> Column:
    """NaN is not a value here: turn it into null."""
    col = as_col(value)
    return F.when(~F.isnan(col), col)


def in_range(value, bounds) -> Column:
    return as_col(value).between(F.lit(bounds[0]), F.lit(bounds[1]))
