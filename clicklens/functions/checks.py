"""Validity predicates. Each is a NULL-safe boolean column: unknown means not valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens import constants as K


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_event() -> Column:
    """All required fields present and the type known (after strict parsing)."""
    present = F.lit(True)
    for name in ["event_id", *K.BUCKET_KEYS, "occurred_at"]:
        present = present & F.col(name).isNotNull()
    return _true(present & F.col("event_type").isin(K.IMPRESSION, K.CLICK))


def valid_bucket() -> Column:
    """Ranges of every field plus the two cross-field rules."""
    c = F.col
    present = F.lit(True)
    for name in K.BUCKET_KEYS:
        present = present & c(name).isNotNull()
    positive = F.lit(True)
    for name in ["alpha_prior", "beta_prior", "alpha_posterior", "beta_posterior"]:
        positive = positive & (c(name) > 0)
    unit = F.lit(True)
    for name in ["ctr", "ci_low", "ci_high"]:
        unit = unit & c(name).between(0.0, 1.0)
    # Spark orders NaN above every number, so it would pass all lower bounds.
    numbers = F.lit(True)
    for name in ["alpha_prior", "beta_prior", "alpha_posterior", "beta_posterior", "ctr", "variance", "ci_low", "ci_high"]:
        numbers = numbers & ~F.isnan(name)
    return _true(
        present
        & numbers
        & (c("impressions") >= 0)
        & (c("clicks") >= 0)
        & positive
        & unit
        & (c("variance") >= 0)
        & c("trusted").isNotNull()
        & (c("clicks") <= c("impressions"))
        & (c("ci_low") <= c("ci_high"))
    )


def learnable() -> Column:
    """Evidence that may teach the model."""
    return _true((F.col("impressions") > 0) & (F.col("clicks") <= F.col("impressions")))


def family_centering(weights: DataFrame) -> DataFrame:
    """Per weight family: size, mean and whether it is centred. A family without rows is absent."""
    return (
        weights.groupBy("family")
        .agg(F.count("*").alias("features"), F.avg("weight").alias("mean_weight"))
        .withColumn("centered", F.abs("mean_weight") <= K.CENTERED_TOLERANCE)
    )


def valid_strengths(strengths: Column) -> Column:
    """Exactly the three families, every strength positive."""
    return _true(
        (F.array_sort(F.map_keys(strengths)) == F.array(*[F.lit(f) for f in sorted(K.FAMILY_COLUMNS)]))
        & F.forall(F.map_values(strengths), lambda v: v > 0)
    )


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
