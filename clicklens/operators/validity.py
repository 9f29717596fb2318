"""Statistical validity of estimates against known click probabilities.

All functions take the analysis frame of ``analysis_frame``: one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions import scalar
from clicklens.functions.payload import bucket_key
from clicklens.operators.posterior import Trust, with_posterior
from clicklens.operators.ranks import quantiles, rank_correlation

ESTIMATORS = {
    "Seed posterior": "seed_posterior_ctr",
    "New batch raw CTR": "batch_raw_ctr",
    "Final posterior": "final_posterior_ctr",
}


def merge_counts(seed: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored buckets plus new evidence per key; a bucket without new evidence adds 0."""
    new = batch.select(
        *K.BUCKET_KEYS,
        F.col("impressions").alias("batch_impressions"),
        F.col("clicks").alias("batch_clicks"),
    )
    return seed.join(new, K.BUCKET_KEYS, "left").fillna(0, ["batch_impressions", "batch_clicks"])


def analysis_frame(
    seed: DataFrame, batch: DataFrame, trust: Trust = Trust(), digits: int | None = None
) -> DataFrame:
    """Seed state, new evidence and the state after it, per bucket.

    ``digits`` rounds the known probability and estimates, so that equal values tie whatever the
    last bits of the arithmetic are.
    """
    c = F.col

    def fixed(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    merged = merge_counts(seed, batch).select(
        *K.BUCKET_KEYS,
        "alpha_prior",
        "beta_prior",
        fixed(c("alpha_prior") / (c("alpha_prior") + c("beta_prior"))).alias("generator_ctr"),
        c("impressions").alias("seed_impressions"),
        c("clicks").alias("seed_clicks"),
        fixed(c("ctr")).alias("seed_posterior_ctr"),
        (c("ci_high") - c("ci_low")).alias("seed_ci_width"),
        c("trusted").alias("seed_trusted"),
        "batch_impressions",
        "batch_clicks",
        (c("impressions") + c("batch_impressions")).alias("impressions"),
        (c("clicks") + c("batch_clicks")).alias("clicks"),
    )
    return with_posterior(merged, trust).select(
        bucket_key().alias("bucket"),
        *K.BUCKET_KEYS,
        "generator_ctr",
        "seed_impressions",
        "seed_clicks",
        F.when(c("seed_impressions") > 0, c("seed_clicks") / c("seed_impressions")).alias(
            "seed_raw_ctr"
        ),
        "seed_posterior_ctr",
        "seed_ci_width",
        "seed_trusted",
        "batch_impressions",
        "batch_clicks",
        fixed(
            F.when(c("batch_impressions") > 0, c("batch_clicks") / c("batch_impressions"))
        ).alias("batch_raw_ctr"),
        c("impressions").alias("final_impressions"),
        c("clicks").alias("final_clicks"),
        F.when(c("impressions") > 0, c("clicks") / c("impressions")).alias("final_raw_ctr"),
        fixed(c("ctr")).alias("final_posterior_ctr"),
        c("variance").alias("final_variance"),
        c("ci_low").alias("final_ci_low"),
        c("ci_high").alias("final_ci_high"),
        (c("ci_high") - c("ci_low")).alias("final_ci_width"),
        c("trusted").alias("final_trusted"),
        c("generator_ctr").between(c("ci_low"), c("ci_high")).alias("generator_covered"),
    )


def sampling_plausibility(frame: DataFrame) -> DataFrame:
    """Expected against observed clicks with the Poisson-binomial standard error."""
    c = F.col
    n, p = c("batch_impressions"), c("generator_ctr")
    return (
        frame.agg(
            F.sum(n).alias("_n"),
            F.sum("batch_clicks").alias("observed_clicks"),
            F.sum(n * p).alias("expected_clicks"),
            F.sum(n * p * (F.lit(1.0) - p)).alias("_v"),
        )
        .select(
            "expected_clicks",
            "observed_clicks",
            scalar.safe_ratio("expected_clicks", "_n").alias("expected_ctr"),
            scalar.safe_ratio("observed_clicks", "_n").alias("observed_ctr"),
            scalar.safe_ratio(F.sqrt("_v"), "_n").alias("standard_error"),
        )
        .withColumn("difference_pp", F.lit(100.0) * (c("observed_ctr") - c("expected_ctr")))
        .withColumn(
            "z_score",
            F.when(
                c("standard_error") > 0,
                (c("observed_ctr") - c("expected_ctr"))
                / F.when(c("standard_error") > 0, c("standard_error")),
            ),
        )
    )


def estimates_long(frame: DataFrame) -> DataFrame:
    """One row per bucket and estimator."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("estimator"), F.col(column).alias("estimate"))
            for label, column in ESTIMATORS.items()
        ]
    )
    return frame.select(
        F.explode(pairs).alias("_e"), "generator_ctr", "batch_impressions"
    ).select("_e.estimator", "_e.estimate", "generator_ctr", "batch_impressions")


def estimator_quality(frame: DataFrame) -> DataFrame:
    """Bias, MAE, RMSE and weighted RMSE in percentage points, and the rank correlation."""
    long = estimates_long(frame)
    error = F.col("estimate") - F.col("generator_ctr")
    weight = F.when(error.isNotNull(), F.col("batch_impressions"))
    errors = long.groupBy("estimator").agg(
        (F.lit(100.0) * F.avg(error)).alias("mean_bias_pp"),
        (F.lit(100.0) * F.avg(F.abs(error))).alias("mae_pp"),
        (F.lit(100.0) * F.sqrt(F.avg(error * error))).alias("rmse_pp"),
        (F.lit(100.0) * F.sqrt(scalar.safe_ratio(F.sum(error * error * weight), F.sum(weight)))).alias(
            "weighted_rmse_pp"
        ),
    )
    ranks = rank_correlation(long, "estimator", "estimate", "generator_ctr")
    return errors.join(ranks, "estimator")


def uncertainty_summary(frame: DataFrame) -> DataFrame:
    """Evidence spread, interval contraction, coverage and trust, one row."""
    c = F.col
    median = quantiles(
        frame.select(F.lit("all").alias("_all"), "batch_impressions"),
        "_all",
        "batch_impressions",
        [0.5],
    ).select(c("edges")[0].cast("double").alias("m"))
    return frame.agg(
        F.min("batch_impressions").alias("min_new_impressions"),
        F.max("batch_impressions").alias("max_new_impressions"),
        F.avg("seed_ci_width").alias("mean_seed_ci_width"),
        F.avg("final_ci_width").alias("mean_final_ci_width"),
        F.avg(c("generator_covered").cast("int")).alias("generator_coverage"),
        F.count_if("seed_trusted").alias("trusted_before"),
        F.count_if("final_trusted").alias("trusted_after"),
    ).select(
        "min_new_impressions",
        median.scalar().alias("median_new_impressions"),
        "max_new_impressions",
        "mean_seed_ci_width",
        "mean_final_ci_width",
        (F.lit(1.0) - scalar.safe_ratio("mean_final_ci_width", "mean_seed_ci_width")).alias(
            "ci_width_reduction"
        ),
        "generator_coverage",
        "trusted_before",
        "trusted_after",
    )


def calibration_bands(frame: DataFrame, bands: int = 5) -> DataFrame:
    """Expected, observed and posterior CTR per quantile band of the known probability.

    Bands are right-closed with the lowest value included; equal edges collapse and ties share a
    band.
    """
    c = F.col
    edges = quantiles(
        frame.select(F.lit("all").alias("_all"), "generator_ctr"),
        "_all",
        "generator_ctr",
        [i / bands for i in range(bands + 1)],
    ).select(F.array_distinct("edges").alias("edges"))
    # The band is the number of inner edges below the value.
    inner = F.slice("_edges", 2, F.greatest(F.lit(0), F.size("_edges") - 2))
    banded = (
        frame.withColumn("_edges", edges.scalar())
        .withColumn("band", F.size(F.filter(inner, lambda e: e < c("generator_ctr"))).cast("bigint"))
    )
    p, n = c("generator_ctr"), c("batch_impressions")
    return (
        banded.groupBy("band")
        .agg(
            F.count("*").alias("buckets"),
            F.min("generator_ctr").alias("lowest_ctr"),
            F.max("generator_ctr").alias("highest_ctr"),
            scalar.safe_ratio(F.sum(p * n), F.sum(n)).alias("expected_ctr"),
            scalar.safe_ratio(F.sum("batch_clicks"), F.sum(n)).alias("observed_ctr"),
            scalar.safe_ratio(
                F.sum(c("final_posterior_ctr") * c("final_impressions")), F.sum("final_impressions")
            ).alias("posterior_ctr"),
        )
        .orderBy("band")
    )


def family_validation(frame: DataFrame) -> DataFrame:
    """Expected against observed CTR per feature value, the families in one pass."""
    c = F.col
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("family"), c(k).alias("feature"))
            for f, k in K.FAMILY_COLUMNS.items()
        ]
    )
    n, p = c("batch_impressions"), c("generator_ctr")
    return (
        frame.select(F.explode(pairs).alias("_p"), "batch_impressions", "batch_clicks", "generator_ctr")
        .groupBy(c("_p.family").alias("family"), c("_p.feature").alias("feature"))
        .agg(
            F.sum(n).alias("impressions"),
            F.sum("batch_clicks").alias("clicks"),
            scalar.safe_ratio(F.sum(p * n), F.sum(n)).alias("expected_ctr"),
            scalar.safe_ratio(F.sum("batch_clicks"), F.sum(n)).alias("observed_ctr"),
        )
        .withColumn("error_pp", F.lit(100.0) * (c("observed_ctr") - c("expected_ctr")))
        .orderBy("family", c("expected_ctr").desc(), "feature")
    )


def largest_errors(frame: DataFrame, top: int = 10) -> DataFrame:
    """The buckets with the largest absolute error of the final posterior."""
    error = F.lit(100.0) * (F.col("final_posterior_ctr") - F.col("generator_ctr"))
    return (
        frame.withColumn("posterior_error_pp", error)
        .withColumn("absolute_error_pp", F.abs(error))
        .orderBy(F.col("absolute_error_pp").desc(), *K.BUCKET_KEYS)
        .limit(top)
        .select(
            "bucket",
            "batch_impressions",
            "batch_clicks",
            "generator_ctr",
            "batch_raw_ctr",
            "final_posterior_ctr",
            "final_ci_low",
            "final_ci_high",
            "posterior_error_pp",
            "generator_covered",
        )
    )


def reconstructed_measurements(frame: DataFrame) -> DataFrame:
    """The measurements a recorded run is checked against, as (measurement, value)."""
    total = lambda name: F.sum(name).cast("double")
    row = frame.agg(
        total("seed_impressions").alias("before impressions"),
        total("seed_clicks").alias("before clicks"),
        total("batch_impressions").alias("batch impressions"),
        total("batch_clicks").alias("batch clicks"),
        total("final_impressions").alias("after impressions"),
        total("final_clicks").alias("after clicks"),
        F.avg("seed_ci_width").alias("average CI width before"),
        F.avg("final_ci_width").alias("average CI width after"),
        F.max("final_ci_width").alias("maximum CI width after"),
    )
    return row.unpivot([], row.columns, "measurement", "value")


def reconcile(recorded: DataFrame, reconstructed: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Recorded against reconstructed measurements."""
    both = recorded.select("measurement", F.col("value").alias("recorded")).join(
        reconstructed.select("measurement", F.col("value").alias("reconstructed")),
        "measurement",
        "full",
    )
    difference = F.col("reconstructed") - F.col("recorded")
    return both.withColumn("difference", difference).withColumn(
        "matches",
        F.coalesce(
            F.abs("difference") <= F.lit(tolerance) * (F.lit(1.0) + F.abs("recorded")), F.lit(False)
        ),
    )
