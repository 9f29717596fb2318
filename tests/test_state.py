import pytest
from pyspark.sql import functions as F

from clicklens.functions import checks
from clicklens.functions.payload import model_json
from clicklens.operators import state as S
from clicklens.operators.model import load_model, seed_model, seed_weights, weights_from_maps
from clicklens.schemas import BUCKET, RUNTIME_SNAPSHOT


@pytest.fixture(scope="module")
def seeds(spark):
    return S.seed_buckets(S.fixed_seed_weights(spark), seed_model(spark).head).persist()


def test_seed_totals(seeds):
    row = S.bucket_summary(seeds).collect()[0]
    assert (row["bucket_count"], row["trusted_bucket_count"]) == (100, 100)
    assert (row["total_impressions"], row["total_clicks"]) == (29_750, 577)
    width = seeds.select(F.avg(F.col("ci_high") - F.col("ci_low")).alias("a"), F.max(F.col("ci_high") - F.col("ci_low")).alias("m")).collect()[0]
    assert width["a"] == pytest.approx(0.028036064337364833, abs=1e-12)
    assert width["m"] == pytest.approx(0.04269055025614267, abs=1e-12)


def test_first_seed_bucket(seeds):
    row = S.lookup_bucket(seeds, "finance", "news.example", "personal_finance").collect()[0]
    assert (row["impressions"], row["clicks"]) == (120, 3)
    assert row["ctr"] == pytest.approx(0.026936582780842547, abs=1e-14)
    assert row["variance"] == pytest.approx(0.00011860182483680255, abs=1e-16)
    assert row["ci_low"] == pytest.approx(0.005591307652771212, abs=1e-14)
    assert row["ci_high"] == pytest.approx(0.048281857908913886, abs=1e-14)


def test_seed_weights_are_centred_and_keys_unique(spark, seeds):
    assert all(r["centered"] for r in checks.family_centering(seed_weights(spark)).collect())
    assert checks.duplicates(seeds, S.K.BUCKET_KEYS).count() == 0
    assert checks.duplicates(seeds.unionByName(seeds.limit(1)), S.K.BUCKET_KEYS).count() == 1


def test_scan_skips_damaged_payloads(spark, seeds):
    store = S.as_key_values(seeds)
    more = spark.createDataFrame(
        [("ctr:a:b:c", "not json"), ("ctr:a:b:d", None), ("weights:current", "{}")], "key string, value string"
    )
    excess = S.as_key_values(seeds.limit(1).withColumn("clicks", F.col("impressions") + 1))
    valid, counts = S.scan_buckets(store.unionByName(more).unionByName(excess))
    assert counts.collect()[0].asDict() == {"scanned": 103, "valid": 100, "invalid": 3}
    assert valid.exceptAll(seeds).count() == 0
    dry = S.persist_result(counts, dry_run=True).collect()[0]
    assert dry["persisted_bucket_count"] == 0 and not dry["postgres_write_applied"]
    wet = S.persist_result(counts, dry_run=False).collect()[0]
    assert wet["persisted_bucket_count"] == 100 and wet["postgres_write_applied"]
    _, none = S.scan_buckets(more)
    assert not S.persist_result(none, dry_run=False).collect()[0]["postgres_write_applied"]


def test_undecodable_row_is_an_error_on_read(spark):
    decoded = S.decode_buckets(spark.createDataFrame([("ctr:a:b:c", "x")], "key string, value string"))
    with pytest.raises(Exception, match="invalid bucket payload"):
        S.require_valid(decoded).collect()


def test_lookup_needs_all_parts(seeds):
    with pytest.raises(ValueError):
        S.lookup_bucket(seeds, "finance", None, "gaming")
    assert S.lookup_bucket(seeds, "finance", "x", "gaming").count() == 0


def test_key_scan_sorts_before_the_limit(seeds):
    keys = [r["key"] for r in S.inspect_keys(S.as_key_values(seeds), "ctr:gaming:*", 3).collect()]
    assert keys == [
        "ctr:gaming:lifestyle.example:gaming",
        "ctr:gaming:lifestyle.example:online_learning",
        "ctr:gaming:lifestyle.example:personal_finance",
    ]


def test_inspect_one_bucket(seeds):
    store = S.as_key_values(seeds)
    values, entry = S.inspect_snapshot(store, bucket=("finance", "news.example", "gaming"), only_bucket=True)
    assert values.count() == 0 and [r["key"] for r in entry.collect()] == ["ctr:finance:news.example:gaming"]
    values, entry = S.inspect_snapshot(store, "ctr:health:*", 5)
    assert values.count() == 5 and entry is None
    with pytest.raises(ValueError):
        S.inspect_snapshot(store, bucket=("finance", None, "gaming"))


def test_upsert_is_idempotent(seeds):
    newer = seeds.filter("ad_category = 'travel'").withColumn("clicks", F.col("clicks") + 1)
    once = S.upsert(seeds, newer)
    assert once.count() == 100
    assert S.upsert(once, newer).exceptAll(once).count() == 0
    assert once.agg(F.sum("clicks")).collect()[0][0] == 577 + 20


def test_model_row_round_trip(spark):
    model = seed_model(spark)
    row = model.snapshot_row()
    assert weights_from_maps(row).exceptAll(model.weights).count() == 0
    assert load_model(row).head == model.head
    assert '"snapshot_name":"seed_values_v1"' in row.select(model_json().alias("j")).collect()[0]["j"]
    with pytest.raises(ValueError, match="missing"):
        load_model(row.limit(0))


def test_strengths(spark):
    ok = spark.sql("SELECT map('ad', 1D, 'domain', 2D, 'context', 3D) AS s")
    few = spark.sql("SELECT map('ad', 1D, 'domain', 2D) AS s")
    zero = spark.sql("SELECT map('ad', 1D, 'domain', 0D, 'context', 3D) AS s")
    got = [f.select(checks.valid_strengths(F.col("s")).alias("v")).collect()[0]["v"] for f in (ok, few, zero)]
    assert got == [True, False, False]


def snapshot(spark, impressions, clicks, models, invalid=0):
    row = (100, 100, invalid, impressions, clicks, 100, 0.1, 0.2, "m", 0.02, models, 0)
    return spark.createDataFrame([row], RUNTIME_SNAPSHOT)


def test_success_gates(spark):
    before, after = snapshot(spark, 100, 2, 1), snapshot(spark, 101, 2, 1)
    produced = spark.createDataFrame([(5, 0)], "impressions bigint, clicks bigint")
    row = S.success_gates(
        before, after, produced, match_impressions=True, match_clicks=True, model_created=True
    ).collect()[0]
    assert row["failures"] == ["redis_impression_delta_mismatch", "model_snapshot_not_created"]
    assert not row["passed"] and row["redis_impression_delta"] == 1
    bad = S.success_gates(
        before, snapshot(spark, 105, 2, 2, invalid=1), produced, match_impressions=True,
        model_created=True, processor_health=True, exited_early=1,
    ).collect()[0]
    assert bad["failures"] == ["invalid_redis_bucket_count_too_high", "processor_exited_early"]
    assert S.success_gates(before, after, produced).collect()[0]["passed"]
    delta = {r["metric"]: r["delta"] for r in S.snapshot_delta(before, after).collect()}
    assert delta["redis_total_impressions"] == 1 and delta["redis_total_clicks"] == 0


def test_runtime_snapshot_of_nothing(spark):
    empty = spark.createDataFrame([], BUCKET).withColumn("valid", F.lit(True))
    row = S.runtime_snapshot(empty, None).collect()[0]
    assert row["redis_average_ci_width"] == 0.0 and row["current_model_snapshot_name"] is None
    assert row["redis_total_impressions"] == 0


def test_upsert_keeps_one_row_of_a_key(spark):
    target = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, updated_at int, v int")
    source = spark.createDataFrame([("a", 2, 5), ("a", 3, 4), ("c", 1, 1), ("c", 1, 1)], "k string, updated_at int, v int")
    for rows in (source, source.orderBy("v")):
        assert sorted(map(tuple, S.upsert(target, rows, ["k"]).collect())) == [("a", 3, 4), ("b", 1, 1), ("c", 1, 1)]


def test_caret_outside_brackets_is_a_character(spark):
    store = spark.createDataFrame([("a^b",), ("axb",), ("ayb",)], "key string")
    assert [r[0] for r in S.inspect_keys(store, "a^b").collect()] == ["a^b"]
    assert [r[0] for r in S.inspect_keys(store, "a[^x]b").collect()] == ["a^b", "ayb"]


def test_the_seed_grid_is_spread_over_tasks(spark):
    weights = S.fixed_seed_weights(spark)
    plan = S.seed_buckets(weights, seed_model(spark).head)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Range (0, 100" in plan
    one = weights.filter("family <> 'domain' OR position = 3")  # places are those of the values that are there
    assert S.seed_buckets(one, seed_model(spark).head).count() == 25
    assert S.seed_buckets(weights.filter("family <> 'ad'"), seed_model(spark).head).count() == 0
