import math

import pytest
from pyspark.sql import functions as F

from clicklens.functions import scalar


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def test_logistic_functions(spark):
    assert value(spark, scalar.sigmoid(0.3)) == pytest.approx(1 / (1 + math.exp(-0.3)), abs=1e-15)
    assert value(spark, scalar.logit(0.2)) == pytest.approx(math.log(0.25), abs=1e-15)
    assert value(spark, scalar.logit(1.0)) is None
    assert value(spark, scalar.logit(0.0)) is None
    assert value(spark, scalar.safe_logit(0.0)) == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    with pytest.raises(Exception, match="between 0 and 1"):
        value(spark, scalar.logit(F.col("id").cast("double"), strict=True))


def test_clip(spark):
    assert value(spark, scalar.clip(5.0, 0.0, 1.0)) == 1.0
    assert value(spark, scalar.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    with pytest.raises(ValueError):
        scalar.clip(1.0, 2.0, 1.0)


def test_beta_and_interval(spark):
    a, b = 5.0, 95.0
    assert value(spark, scalar.beta_variance(F.lit(a), F.lit(b))) == pytest.approx(a * b / (100**2 * 101))
    low, high = scalar.clipped_interval(F.lit(0.01), F.lit(0.01), 1.96)
    assert value(spark, low) == 0.0
    assert value(spark, high) == pytest.approx(0.01 + 1.96 * 0.1)


def test_half_even_and_ratio(spark):
    assert [value(spark, scalar.round_half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    assert value(spark, scalar.safe_ratio(F.lit(1), F.lit(0))) == 0.0


def test_snapshot_name(spark):
    at = F.timestamp_seconds(F.lit(1767225600))
    assert value(spark, scalar.snapshot_name("weights", at)) == "weights_20260101_000000"
