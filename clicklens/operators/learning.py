"""Re-learning of the prior model from bucket evidence.

Everything is one long table ``(family, feature)``; the families are never separate jobs. Only one
row of scalars, which decides whether the pass is accepted, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklens import constants as K
from clicklens.functions import checks, scalar
from clicklens.functions.plan import local_rows
from clicklens.operators.model import Head, Model
from clicklens.operators.posterior import Trust, bucket_rows
from clicklens.operators.model import with_priors
from clicklens.schemas import RUN_METRICS
from clicklens.sources.tables import staged

NO_EVIDENCE, INSUFFICIENT, WIDE_CI, UPDATED = "no_evidence", "insufficient", "wide_ci", "updated"


@dataclass(frozen=True)
class Learning:
    """Controls of one pass. The baseline guard has no default: callers differ in it."""

    baseline_max_ci_width: float
    learning_rate: float = 0.25
    evidence_smoothing: float = 1000.0
    ridge: float = 0.01
    max_delta: float = 0.25
    min_feature_impressions: int = 500
    max_feature_ci_width: float = 0.02
    baseline_update: bool = True
    dry_run: bool = False

    def __post_init__(self) -> None:
        positive = [
            self.baseline_max_ci_width,
            self.learning_rate,
            self.max_delta,
            self.max_feature_ci_width,
        ]
        if any(v <= 0 for v in positive) or self.min_feature_impressions < 1:
            raise ValueError("learning controls must be positive")
        if self.evidence_smoothing < 0 or self.ridge < 0:
            raise ValueError("smoothing and ridge must not be negative")


def evidence_snapshot(
    counts: DataFrame, model: Model, trust: Trust = Trust()
) -> DataFrame:
    """Bucket rows of the learnable triplets with priors of the current model."""
    learnable = counts.filter(checks.learnable())
    return bucket_rows(with_priors(learnable, model), trust)


def evidence_counts(counts: DataFrame, invalid_events: int | Column = 0) -> DataFrame:
    """Scanned, valid and invalid counts; invalid events add to the unlearnable triplets."""
    extra = invalid_events if isinstance(invalid_events, Column) else F.lit(invalid_events)
    return counts.agg(
        F.count("*").alias("scanned"),
        F.count_if(checks.learnable()).alias("valid"),
        F.count_if(~checks.learnable()).alias("_unlearnable"),
    ).select(
        "scanned", "valid", (F.col("_unlearnable") + extra.cast("bigint")).alias("invalid")
    )


def feature_marginals(buckets: DataFrame) -> DataFrame:
    """Evidence per single feature value, all families in one pass over the buckets."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.col(c).alias("feature"))
            for f, c in K.FAMILY_COLUMNS.items()
        ]
    )
    return (
        buckets.filter(checks.learnable())
        .select(F.explode(pairs).alias("_p"), "impressions", "clicks")
        .groupBy(F.col("_p.family").alias("family"), F.col("_p.feature").alias("feature"))
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    )


def global_totals(buckets: DataFrame) -> DataFrame:
    """Totals over learnable buckets, the observed CTR and how many buckets are not learnable."""
    ok = checks.learnable()
    zero = F.lit(0).cast("bigint")
    return buckets.agg(
        F.coalesce(F.sum(F.when(ok, F.col("impressions"))), zero).alias("impressions"),
        F.coalesce(F.sum(F.when(ok, F.col("clicks"))), zero).alias("clicks"),
        F.count_if(ok).alias("valid_buckets"),
        F.count_if(~ok).alias("invalid_buckets"),
    ).withColumn("observed_ctr", scalar.safe_ratio("clicks", "impressions"))


def baseline_proposal(totals: DataFrame, head: Head, config: Learning) -> DataFrame:
    """One row: posterior of the global evidence and what it proposes for the intercept."""
    old = F.lit(float(head.w0))
    strength = F.lit(float(head.global_strength))
    low, high = scalar.clipped_interval("posterior_baseline_ctr", "_variance", K.LEARNING_Z)
    enabled = F.lit(config.baseline_update)
    posterior = (
        totals.withColumn("_p", scalar.sigmoid(old))
        .withColumn("_a", F.col("_p") * strength + F.col("clicks"))
        .withColumn(
            "_b", (F.lit(1.0) - F.col("_p")) * strength + F.col("impressions") - F.col("clicks")
        )
        .withColumn("posterior_baseline_ctr", F.col("_a") / (F.col("_a") + F.col("_b")))
        .withColumn("_variance", scalar.beta_variance("_a", "_b"))
        .withColumn("ci_low", low)
        .withColumn("ci_high", high)
        .withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))
    )
    applied = enabled & (F.col("ci_width") <= config.baseline_max_ci_width)
    return (
        posterior.withColumn("update_applied", applied)
        .withColumn(
            "new_w0",
            F.when(F.col("update_applied"), scalar.safe_logit("posterior_baseline_ctr")).otherwise(old),
        )
        .select(
            old.alias("old_w0"),
            "new_w0",
            (F.col("new_w0") - old).alias("baseline_delta"),
            enabled.alias("update_enabled"),
            "update_applied",
            F.col("impressions").alias("aggregate_impressions"),
            F.col("clicks").alias("aggregate_clicks"),
            F.col("observed_ctr").alias("aggregate_observed_ctr"),
            "posterior_baseline_ctr",
            "ci_low",
            "ci_high",
            "ci_width",
            scalar.sigmoid("new_w0").alias("new_baseline_ctr"),
            F.when(~enabled, F.lit("baseline_update_disabled"))
            .when(F.col("update_applied"), F.lit("baseline_guards_passed"))
            .otherwise(F.lit("baseline_ci_width_too_wide"))
            .alias("guard_reason"),
            F.col("valid_buckets").alias("valid_bucket_count"),
            F.col("invalid_buckets").alias("invalid_bucket_count"),
        )
    )


def family_steps(marginals: DataFrame, model: Model, config: Learning) -> DataFrame:
    """One row per feature of model or evidence: posterior, guard status and step.

    Steps use the model's old intercept. Features without evidence keep their weight.
    """
    head = model.head
    strength = F.lit(None).cast("double")
    for family, value in head.family_strengths.items():
        strength = F.when(F.col("family") == family, F.lit(float(value))).otherwise(strength)
    w0 = F.lit(float(head.w0))
    c = F.col
    low, high = scalar.clipped_interval("posterior_ctr", "_variance", K.LEARNING_Z)
    rows = (
        model.weights.join(marginals, ["family", "feature"], "full")
        .select(
            "family",
            "feature",
            c("impressions"),
            c("clicks"),
            F.coalesce("weight", F.lit(0.0)).alias("old_weight"),
            c("weight").isNull().alias("unknown"),
        )
        .withColumn("_p", scalar.sigmoid(w0 + c("old_weight")))
        .withColumn("_k", strength)
        .withColumn("_a", c("_p") * c("_k") + c("clicks"))
        .withColumn("_b", (F.lit(1.0) - c("_p")) * c("_k") + c("impressions") - c("clicks"))
        .withColumn("posterior_ctr", c("_a") / (c("_a") + c("_b")))
        .withColumn("_variance", scalar.beta_variance("_a", "_b"))
        .withColumn("ci_width", F.when(c("impressions").isNotNull(), high - low))
        .withColumn(
            "status",
            F.when(c("impressions").isNull(), NO_EVIDENCE)
            .when(c("impressions") < config.min_feature_impressions, INSUFFICIENT)
            .when(c("ci_width") > config.max_feature_ci_width, WIDE_CI)
            .otherwise(UPDATED),
        )
    )
    rate = F.lit(config.learning_rate) * c("impressions") / (
        c("impressions") + F.lit(float(config.evidence_smoothing))
    )
    target = scalar.safe_logit("posterior_ctr") - w0
    step = scalar.clip(
        rate * (target - c("old_weight")) - F.lit(config.ridge) * c("old_weight"),
        -config.max_delta,
        config.max_delta,
    )
    return (
        rows.withColumn("delta", F.when(c("status") == UPDATED, step).otherwise(F.lit(0.0)))
        .withColumn("stepped_weight", c("old_weight") + c("delta"))
        .select(
            "family",
            "feature",
            "impressions",
            "clicks",
            "old_weight",
            "unknown",
            "posterior_ctr",
            "ci_width",
            "status",
            "delta",
            "stepped_weight",
        )
    )


def center_families(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Subtract each family's mean. The means are at most one row per family; no window group
    has to hold a whole family."""
    means = rows.groupBy("family").agg(F.avg(column).alias("_mean"))
    return (
        rows.join(means, "family")
        .withColumn(into, F.col(column) - F.col("_mean"))
        .drop("_mean")
    )


def family_updates(marginals: DataFrame, model: Model, config: Learning) -> DataFrame:
    """Steps with the re-centred weight of every feature, also of those not updated."""
    steps = family_steps(marginals, model, config)
    return center_families(steps, "stepped_weight", "new_weight")


@dataclass(frozen=True)
class Recalibration:
    """Outcome of one pass: stored features, the metrics row, and the weights to use afterwards.

    ``metrics`` is one row of scalars; it decides what to write and is the only thing collected.
    """

    features: DataFrame
    metrics: dict
    weights: DataFrame

    def metrics_frame(self) -> DataFrame:
        row = tuple(self.metrics[f] for f in RUN_METRICS.fieldNames())
        return local_rows(self.features.sparkSession, [row], RUN_METRICS)


def recalibrate(
    buckets: DataFrame,
    model: Model,
    config: Learning,
    scan_counts: DataFrame | None = None,
) -> Recalibration:
    """One full pass over valid bucket rows.

    ``scan_counts`` has one row (scanned, valid, invalid) of the scan that produced the buckets;
    without it the buckets themselves are the scan. Runs three small jobs over the buckets; the
    feature table is written once and everything else is read from it.
    """
    if scan_counts is None:
        scan_counts = buckets.agg(
            F.count("*").alias("scanned"),
            F.count("*").alias("valid"),
            F.lit(0).cast("bigint").alias("invalid"),
        )
    base = baseline_proposal(global_totals(buckets), model.head, config).collect()[0]
    scan = scan_counts.select("scanned", "valid", "invalid").collect()[0]
    features = staged(family_updates(feature_marginals(buckets), model, config), "features")
    rolled = _roll_up(features)
    if any(rolled[f"{f}_features"] == 0 for f in K.FAMILY_COLUMNS) and not (
        config.baseline_update and not base["update_applied"]
    ):
        raise ValueError("cannot center an empty weight family")

    guard_failed = config.baseline_update and not base["update_applied"]
    # Without a baseline update something must have been learnt from the features.
    accepted = not guard_failed and (base["update_applied"] or rolled["updated"] > 0)
    reason = None
    if guard_failed:
        reason = f"baseline_guard_failed:{base['guard_reason']}"
    elif not accepted:
        reason = "no_feature_buckets_passed_guards"
    buckets_per_family = {f: rolled[f"{f}_buckets"] for f in K.FAMILY_COLUMNS}
    learned = {} if guard_failed else rolled
    skipped = (
        sum(buckets_per_family.values())
        if guard_failed
        else rolled["insufficient"] + rolled["wide"]
    )
    invalid = scan["invalid"] + base["invalid_bucket_count"]
    metrics = {
        "accepted": accepted,
        "skipped_reason": reason,
        "input_bucket_count": scan["scanned"],
        "valid_bucket_count": scan["valid"],
        "invalid_bucket_count": invalid,
        **{f"{f}_feature_bucket_count": n for f, n in buckets_per_family.items()},
        "updated_feature_bucket_count": learned.get("updated", 0),
        "skipped_feature_bucket_count": skipped,
        "insufficient_impression_feature_count": learned.get("insufficient", 0),
        "wide_ci_feature_count": learned.get("wide", 0),
        "unknown_feature_count": learned.get("unknown", 0),
        "max_absolute_weight_delta": rolled["max_delta"] if accepted else 0.0,
        "learning_rate": float(config.learning_rate),
        "evidence_smoothing": float(config.evidence_smoothing),
        "ridge": float(config.ridge),
        "max_delta": float(config.max_delta),
        "min_feature_impressions": config.min_feature_impressions,
        "max_feature_ci_width": float(config.max_feature_ci_width),
        "dry_run": config.dry_run,
        "w0_unchanged": base["new_w0"] == base["old_w0"],
        "old_w0": base["old_w0"],
        "new_w0": base["new_w0"],
        "baseline_delta": base["baseline_delta"],
        "baseline_update_enabled": base["update_enabled"],
        "baseline_update_applied": base["update_applied"],
        "aggregate_impressions": base["aggregate_impressions"],
        "aggregate_clicks": base["aggregate_clicks"],
        "aggregate_observed_ctr": base["aggregate_observed_ctr"],
        "posterior_baseline_ctr": base["posterior_baseline_ctr"],
        "baseline_ci_low": base["ci_low"],
        "baseline_ci_high": base["ci_high"],
        "baseline_ci_width": base["ci_width"],
        "baseline_guard_reason": base["guard_reason"],
        "valid_baseline_bucket_count": base["valid_bucket_count"],
        "invalid_baseline_bucket_count": invalid,
        # The baseline follows the new intercept only when baseline updates are enabled.
        "new_baseline_ctr": (
            base["new_baseline_ctr"]
            if accepted and config.baseline_update
            else float(model.head.baseline_ctr)
        ),
    }
    # A skipped pass leaves the model as it is, without the features it did not know.
    weights = (
        features.select("family", "feature", F.col("new_weight").alias("weight"))
        if accepted
        else features.filter("NOT unknown").select(
            "family", "feature", F.col("old_weight").alias("weight")
        )
    )
    return Recalibration(features, metrics, weights)


def _roll_up(features: DataFrame) -> dict:
    """Counts by status over the features, one row."""
    c = F.col
    per_family = []
    for f in K.FAMILY_COLUMNS:
        mine = c("family") == f
        per_family.append(F.count_if(mine).alias(f"{f}_features"))
        per_family.append(F.count_if(mine & c("impressions").isNotNull()).alias(f"{f}_buckets"))
    return (
        features.agg(
            *per_family,
            F.count_if(c("status") == UPDATED).alias("updated"),
            F.count_if(c("status") == INSUFFICIENT).alias("insufficient"),
            F.count_if(c("status") == WIDE_CI).alias("wide"),
            F.count_if(c("unknown")).alias("unknown"),
            F.coalesce(F.max(F.abs("delta")), F.lit(0.0)).alias("max_delta"),
        )
        .collect()[0]
        .asDict()
    )
