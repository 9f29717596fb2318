"""Bucket statistics from counts and priors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions import scalar
from clicklens.schemas import BUCKET


@dataclass(frozen=True)
class Trust:
    z: float = K.TRUST_Z
    min_impressions: int = K.TRUST_MIN_IMPRESSIONS
    max_variance: float = K.TRUST_MAX_VARIANCE
    max_ci_width: float = K.TRUST_MAX_CI_WIDTH


def with_posterior(rows: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """Add posterior parameters, mean, variance, interval and trust flag.

    Needs impressions, clicks, alpha_prior and beta_prior. The priors are taken as they are:
    a bucket keeps the priors it was created with.
    """
    c = F.col
    low, high = scalar.clipped_interval("ctr", "variance", trust.z)
    return (
        rows.withColumns(
            {
                "alpha_posterior": c("alpha_prior") + c("clicks"),
                "beta_posterior": c("beta_prior") + c("impressions") - c("clicks"),
            }
        )
        .withColumns(
            {
                "ctr": c("alpha_posterior") / (c("alpha_posterior") + c("beta_posterior")),
                "variance": scalar.beta_variance("alpha_posterior", "beta_posterior"),
            }
        )
        .withColumns({"ci_low": low, "ci_high": high})
        .withColumn(
            "trusted",
            scalar.trust_flag(
                "impressions",
                "variance",
                c("ci_high") - c("ci_low"),
                trust.min_impressions,
                trust.max_variance,
                trust.max_ci_width,
            ),
        )
    )


def bucket_rows(rows: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """Counts with priors to complete bucket rows."""
    return with_posterior(rows, trust).select(*BUCKET.fieldNames())
