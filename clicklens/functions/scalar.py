"""CTR formulas as ``Column -> Column`` functions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicklens import constants as K


def _col(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def sigmoid(x: Column | str | float) -> Column:
    """Logistic transform."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def logit(p: Column | str | float, strict: bool = False) -> Column:
    """Log-odds. Outside (0, 1): an error when ``strict``, otherwise NULL."""
    p = _col(p)
    bad = F.raise_error(F.lit("probability must be between 0 and 1")).cast("double") if strict else F.lit(None)
    # The inner guard keeps the division defined even where a branch is evaluated eagerly.
    odds = p / F.when(p < 1.0, F.lit(1.0) - p)
    return F.when((p > 0.0) & (p < 1.0), F.ln(odds)).otherwise(bad)


def clip(value: Column | str | float, low: Column | float, high: Column | float) -> Column:
    """Clip into an inclusive range."""
    if not isinstance(low, Column) and not isinstance(high, Column) and low > high:
        raise ValueError("minimum cannot exceed maximum")
    value = _col(value)
    # greatest/least skip NULLs; an unknown value must stay unknown.
    return F.when(value.isNotNull(), F.greatest(_col(low), F.least(value, _col(high))))


def clip_probability(p: Column | str | float) -> Column:
    return clip(p, K.MIN_PROBABILITY, K.MAX_PROBABILITY)


def safe_logit(p: Column | str | float) -> Column:
    """Log-odds of the clipped probability."""
    p = clip_probability(p)
    return F.ln(p / (F.lit(1.0) - p))


def beta_variance(alpha: Column | str, beta: Column | str) -> Column:
    alpha, beta = _col(alpha), _col(beta)
    total = alpha + beta
    return (alpha * beta) / ((total * total) * (total + F.lit(1.0)))


def clipped_interval(
    mean: Column | str, variance: Column | str, z: float
) -> tuple[Column, Column]:
    """Normal-approximation interval clipped to [0, 1]."""
    mean = _col(mean)
    margin = F.lit(float(z)) * F.sqrt(_col(variance))
    return F.greatest(F.lit(0.0), mean - margin), F.least(F.lit(1.0), mean + margin)


def trust_flag(
    impressions: Column | str,
    variance: Column | str,
    ci_width: Column | str,
    min_impressions: int = K.TRUST_MIN_IMPRESSIONS,
    max_variance: float = K.TRUST_MAX_VARIANCE,
    max_ci_width: float = K.TRUST_MAX_CI_WIDTH,
) -> Column:
    return (
        (_col(impressions) >= F.lit(min_impressions))
        & (_col(variance) <= F.lit(max_variance))
        & (_col(ci_width) <= F.lit(max_ci_width))
    )


def round_half_even(value: Column | str) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(_col(value))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; 0 where the denominator is not positive."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(d > 0, n / F.when(d > 0, d)).otherwise(F.lit(0.0))


def snapshot_name(prefix: str, at: Column | str) -> Column:
    """``prefix_yyyyMMdd_HHmmss`` of a timestamp in the session zone (UTC)."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(_col(at), "yyyyMMdd_HHmmss"))
