"""A query, its rounding and its SQL counterpart, registered together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parvis.catalog.views import with_views


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _digits(spec: dict[str, int] | None) -> dict[str, int]:
    return {name: d for names, d in (spec or {}).items() for name in names.split()}


def query(views: str = "", sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name.

    ``digits`` rounds floating results alike on both sides, since the engines add
    numbers in different orders.
    """
    places = _digits(digits)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.rint(F.col(c) * 10.0**d) / 10.0**d + F.lit(0.0) for c, d in places.items()})

        text = None
        if sql is not None:
            text = with_views(views, sql) if views else sql.strip()
            if places:
                swaps = ", ".join(f"round_even({c} * 1e{d}, 0) / 1e{d} + 0.0e0 AS {c}" for c, d in places.items())
                text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)"
        REGISTRY[fn.__name__] = Query(fn.__name__, run, text)
        return run

    return register
