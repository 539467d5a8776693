"""Additive contributions of features to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parvis import constants as C
from parvis.functions.text import top_contributions
from parvis.plans.training import PriceModel


def _as_array(values: dict) -> F.Column:
    return F.array(
        *[
            F.struct(F.lit(c).alias("feature"), v.alias("value"), F.lit(C.FEATURE_LABELS.get(c, c)).alias("display"))
            for c, v in values.items()
        ]
    )


def linear_contributions(model: PriceModel, features: DataFrame, k: int | None = 8) -> DataFrame:
    """Exact contributions of a scaled linear model: ``coef * (x - mean) / std``.

    They add up to the prediction minus ``base``. For a log target they are
    multiplied by the predicted price, the local slope of the exponential.
    """
    scaler, last = model.pipeline.stages[-2], model.pipeline.stages[-1]
    means, stds, coefs = scaler.mean.toArray(), scaler.std.toArray(), last.coefficients.toArray()
    scored = model.predict(features)
    scale = F.col("prix_m2_predit") if model.log_target else F.lit(1.0)
    values = {
        c: F.lit(float(b) / float(s) if s else 0.0) * (F.col(c) - float(m)) * scale
        for c, m, s, b in zip(model.columns, means, stds, coefs)
    }
    out = scored.withColumns({"base": F.lit(float(last.intercept)), "contributions": _as_array(values)})
    return out if k is None else out.withColumn("contributions", top_contributions("contributions", k))


def occlusion_contributions(
    model: PriceModel, features: DataFrame, k: int | None = 8, baseline: dict[str, float] | None = None
) -> DataFrame:
    """Contributions of any model: the change in price when a feature is set to its value
    in ``baseline``, without one to its mean. The model is applied to each variant column-wise."""
    means = baseline or features.agg(*[F.avg(c).alias(c) for c in model.columns]).first()
    out = model.predict(features)
    for c in model.columns:
        kept = out.withColumns({"_kept": F.col(c), c: F.lit(float(means[c]))})
        out = model.predict(kept, f"_without_{c}").withColumn(c, F.col("_kept")).drop("_kept")
    values = {c: F.col("prix_m2_predit") - F.col(f"_without_{c}") for c in model.columns}
    out = out.withColumn("contributions", _as_array(values)).drop(*[f"_without_{c}" for c in model.columns])
    return out if k is None else out.withColumn("contributions", top_contributions("contributions", k))


def mean_absolute_contribution(contributions: DataFrame) -> DataFrame:
    return (
        contributions.select(F.inline("contributions"))
        .groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
    )
