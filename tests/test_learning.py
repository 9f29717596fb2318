import math
from dataclasses import replace

import pytest

from clicklens.operators import learning as L
from clicklens.operators.model import Model

COUNTS = "ad_category string, publisher_domain string, conversation_category string, impressions bigint, clicks bigint"
OPEN = L.Learning(baseline_max_ci_width=1.0, max_feature_ci_width=1.0, baseline_update=False)
THREE = [
    ("finance", "news.example", "personal_finance", 600, 60),
    ("finance", "tech.example", "gaming", 500, 50),
    ("travel", "news.example", "gaming", 500, 25),
]


def buckets(spark, rows):
    return spark.createDataFrame(rows, COUNTS)


def run(spark, model, rows, **changes):
    return L.recalibrate(buckets(spark, rows), model, replace(OPEN, **changes))


def weights(done):
    return {(r["family"], r["feature"]): r["weight"] for r in done.weights.collect()}


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def expected_step(w0, weight, strength, n, c, config=OPEN):
    p = sigmoid(w0 + weight)
    a, b = p * strength + c, (1 - p) * strength + n - c
    target = math.log(a / b) - w0
    rate = config.learning_rate * n / (n + config.evidence_smoothing)
    step = rate * (target - weight) - config.ridge * weight
    return max(-config.max_delta, min(step, config.max_delta))


def test_marginals(spark):
    rows = L.feature_marginals(buckets(spark, THREE)).collect()
    assert {(r["family"], r["feature"]): (r["impressions"], r["clicks"]) for r in rows} == {
        ("ad", "finance"): (1100, 110),
        ("ad", "travel"): (500, 25),
        ("domain", "news.example"): (1100, 85),
        ("domain", "tech.example"): (500, 50),
        ("context", "personal_finance"): (600, 60),
        ("context", "gaming"): (1000, 75),
    }


def test_steps_follow_the_formula_and_are_centred(spark, model):
    done = run(spark, model, THREE)
    m = done.metrics
    assert m["accepted"] and m["updated_feature_bucket_count"] == 6
    assert m["skipped_feature_bucket_count"] == 0 and not m["baseline_update_enabled"]
    assert m["w0_unchanged"] and m["new_baseline_ctr"] == 0.02
    assert m["baseline_guard_reason"] == "baseline_update_disabled"
    w0 = model.head.w0
    finance = 0.1 + expected_step(w0, 0.1, 200, 1100, 110)
    travel = -0.1 + expected_step(w0, -0.1, 200, 500, 25)
    mean = (finance + travel) / 2
    new = weights(done)
    assert new["ad", "finance"] == pytest.approx(finance - mean, abs=1e-12)
    assert new["ad", "travel"] == pytest.approx(travel - mean, abs=1e-12)
    for family in ("ad", "domain", "context"):
        assert abs(sum(w for (f, _), w in new.items() if f == family)) < 1e-12


def test_too_few_impressions(spark, model):
    m = run(spark, model, [("finance", "news.example", "gaming", 499, 50)]).metrics
    assert not m["accepted"] and m["insufficient_impression_feature_count"] == 3
    assert m["skipped_reason"] == "no_feature_buckets_passed_guards"
    assert m["max_absolute_weight_delta"] == 0.0


def test_wide_interval(spark, model):
    done = run(spark, model, [("finance", "news.example", "gaming", 500, 250)], max_feature_ci_width=0.001)
    assert done.metrics["wide_ci_feature_count"] == 3 and not done.metrics["accepted"]
    assert weights(done) == {(r["family"], r["feature"]): r["weight"] for r in model.weights.collect()}


def test_baseline_guard_skips_the_run(spark, model):
    row = [("finance", "news.example", "gaming", 1000, 80)]
    m = run(spark, model, row, baseline_update=True, baseline_max_ci_width=0.0001).metrics
    assert not m["accepted"]
    assert m["skipped_reason"] == "baseline_guard_failed:baseline_ci_width_too_wide"
    assert m["updated_feature_bucket_count"] == 0 and m["skipped_feature_bucket_count"] == 3


def test_baseline_update(spark, model):
    row = [("finance", "news.example", "gaming", 1000, 80)]
    m = run(spark, model, row, baseline_update=True).metrics
    p = (sigmoid(model.head.w0) * 500 + 80) / (500 + 1000)
    assert m["accepted"] and m["new_w0"] == pytest.approx(math.log(p / (1 - p)), abs=1e-12)
    assert m["new_baseline_ctr"] == pytest.approx(p) and not m["w0_unchanged"]


def test_baseline_alone_is_accepted(spark, model):
    row = [("finance", "news.example", "gaming", 400, 8)]
    m = run(spark, model, row, baseline_update=True).metrics
    assert m["accepted"] and m["updated_feature_bucket_count"] == 0


def test_clipping_is_reported_before_centring(spark, model):
    m = run(spark, model, [("finance", "news.example", "gaming", 1000, 900)], max_delta=0.01).metrics
    assert m["max_absolute_weight_delta"] == pytest.approx(0.01)


def test_unknown_features_are_added(spark, model):
    done = run(spark, model, [("education", "blog.example", "wellness", 1000, 60)])
    assert done.metrics["unknown_feature_count"] == 3
    assert {("ad", "education"), ("domain", "blog.example"), ("context", "wellness")} <= set(weights(done))


def test_unlearnable_buckets_are_counted(spark, model):
    rows = [("finance", "news.example", "gaming", 1000, 120), ("travel", "tech.example", "gaming", 0, 0)]
    m = run(spark, model, rows).metrics
    assert (m["invalid_bucket_count"], m["ad_feature_bucket_count"], m["updated_feature_bucket_count"]) == (1, 1, 3)


def test_ridge_shrinks(spark, model):
    rows = [("finance", "news.example", "personal_finance", 5000, 105), ("travel", "tech.example", "gaming", 5000, 95)]
    plain = weights(run(spark, model, rows, ridge=0.0))
    shrunk = weights(run(spark, model, rows, ridge=0.5))
    assert abs(shrunk["ad", "finance"]) < abs(plain["ad", "finance"])


def test_empty_family_is_an_error(spark, model):
    bare = Model(model.head, model.weights.filter("family <> 'ad'"))
    with pytest.raises(ValueError, match="empty weight family"):
        run(spark, bare, [])


def test_evidence_snapshot_counts(spark, model):
    counts = buckets(spark, [("finance", "news.example", "gaming", 0, 1)])
    row = L.evidence_counts(counts, 1).collect()[0]
    assert (row["scanned"], row["valid"], row["invalid"]) == (1, 0, 2)
    assert L.evidence_snapshot(counts, model).count() == 0
