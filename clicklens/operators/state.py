"""Stored bucket state: scans, lookups, upserts, seeds and run snapshots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens import constants as K
from clicklens.functions import checks, scalar
from clicklens.functions.plan import evaluated_once, local_rows
from clicklens.functions.payload import bucket_json, store_key
from clicklens.operators.model import Head, prior_mean
from clicklens.operators.posterior import Trust, bucket_rows
from clicklens.schemas import BUCKET, WEIGHTS
from clicklens.sources.events import one_json_object
from clicklens.sources.tables import SnapshotTable, staged


def as_key_values(buckets: DataFrame) -> DataFrame:
    """Buckets as the key/value rows of a keyed store."""
    return buckets.select(store_key().alias("key"), bucket_json().alias("value"))


def decode_buckets(store: DataFrame) -> DataFrame:
    """Bucket rows of all keys with the bucket prefix, with ``valid``."""
    rows = store.filter(F.col("key").startswith(f"{K.STORE_PREFIX}:"))
    parsed = F.when(one_json_object(F.col("value")).isNotNull(), F.from_json("value", BUCKET))
    decoded = rows.select("key", parsed.alias("_b")).select("key", "_b.*")
    return evaluated_once(decoded.withColumn("valid", checks.valid_bucket()))


def scan_buckets(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid bucket rows, and one row of scanned, valid and invalid counts."""
    decoded = decode_buckets(store)
    counts = decoded.agg(
        F.count("*").alias("scanned"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )
    return decoded.filter("valid").select(*BUCKET.fieldNames()), counts


def lookup_bucket(
    buckets: DataFrame,
    ad_category: str | None,
    publisher_domain: str | None,
    conversation_category: str | None,
) -> DataFrame:
    """The row of one bucket, or none. All three key parts are needed."""
    parts = [ad_category, publisher_domain, conversation_category]
    if any(p is None for p in parts):
        raise ValueError("a bucket lookup needs all three key parts")
    condition = F.lit(True)
    for name, part in zip(K.BUCKET_KEYS, parts):
        condition = condition & (F.col(name) == part)
    return buckets.filter(condition)


def require_valid(rows: DataFrame) -> DataFrame:
    """Decoded rows; an undecodable one is an error when it is read."""
    failed = F.raise_error(F.concat(F.lit("invalid bucket payload: "), F.col("key"))).cast("boolean")
    return rows.filter(F.when(F.col("valid"), F.lit(True)).otherwise(failed))


def _glob_to_regex(pattern: str) -> str:
    out, inside = "", False
    for ch in pattern:
        plain = ch.isalnum() or ch in "[]-_" or (ch == "^" and inside)
        out += ch if plain else {"*": ".*", "?": "."}.get(ch, f"\\{ch}")
        inside = ch == "[" or (inside and ch != "]")
    return f"(?s)^{out}$"


def inspect_keys(store: DataFrame, pattern: str = "*", limit: int = 100) -> DataFrame:
    """The first ``limit`` keys matching a glob pattern, in key order.

    Sorting precedes the limit, so the answer does not depend on the scan order.
    """
    hits = store.filter(F.col("key").rlike(_glob_to_regex(pattern)))
    return hits.orderBy("key").limit(limit)


def inspect_snapshot(
    store: DataFrame,
    pattern: str = "*",
    limit: int = 100,
    bucket: tuple[str, str, str] | None = None,
    only_bucket: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """The keys matching a pattern (none if only the bucket is wanted), and the bucket's entry."""
    values = store.limit(0) if only_bucket else inspect_keys(store, pattern, limit)
    if bucket is None:
        return values, None
    if len(bucket) != 3 or any(part is None for part in bucket):
        raise ValueError("a bucket lookup needs all three key parts")
    key = ":".join((K.STORE_PREFIX, *bucket))
    return values, store.filter(F.col("key") == key)


def upsert(target: DataFrame, source: DataFrame, keys: list[str] = K.BUCKET_KEYS) -> DataFrame:
    """Source rows replace target rows of the same key; all others stay.

    Of several source rows of a key the greatest counts, by ``updated_at`` where the rows have it and then by all
    columns in order, so that a key is there once whatever the order of the rows.
    """
    order = [c for c in ("updated_at",) if c in source.columns]
    rest = [c for c in source.columns if c not in (*keys, *order)]
    newest = source.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row")).select(*keys, "_row.*")
    newest = newest.select(*source.columns)
    return target.join(newest, keys, "left_anti").unionByName(newest)


def persist_buckets(store: DataFrame, table: SnapshotTable, dry_run: bool = False) -> DataFrame:
    """Upsert the valid buckets of a store into a table and return the outcome row.

    Nothing is written in a dry run or without valid rows. Written rows get the time of the write as
    ``updated_at`` where the table has that column; stored buckets that the scan lacks stay as they are.
    """
    valid, counts = scan_buckets(store)
    result = staged(persist_result(counts, dry_run), "persist-result")
    if result.first()["postgres_write_applied"]:
        if "updated_at" in table.schema.fieldNames():
            valid = valid.withColumn("updated_at", F.lit(datetime.now(timezone.utc)))
        before = table.read()
        table.write(valid if before is None else upsert(before, valid))
    return result


def persist_result(counts: DataFrame, dry_run: bool) -> DataFrame:
    """Outcome row of persisting a scan: nothing is written in a dry run or without valid rows."""
    applied = (~F.lit(dry_run)) & (F.col("valid") > 0)
    return counts.select(
        F.lit(dry_run).alias("dry_run"),
        F.col("scanned").alias("scanned_key_count"),
        F.col("valid").alias("valid_bucket_count"),
        F.col("invalid").alias("invalid_bucket_count"),
        F.when(applied, F.col("valid")).otherwise(F.lit(0).cast("bigint")).alias(
            "persisted_bucket_count"
        ),
        applied.alias("postgres_write_applied"),
    )


def seed_buckets(weights: DataFrame, head: Head, trust: Trust = Trust()) -> DataFrame:
    """Deterministic starting buckets for every combination of the feature values.

    ``weights`` has (family, position, feature, weight). Every combination has a number, whose digits in the mixed
    radix of the family sizes are the places of its three values: the numbers are a range, spread over all tasks,
    and meet the values by three equal joins. Only the three sizes reach the driver.
    """
    sizes = {r["family"]: r["count"] for r in weights.groupBy("family").count().collect()}
    n = {f: sizes.get(f, 0) for f in K.FAMILY_COLUMNS}
    number = F.col("id")
    digits = {
        "ad": F.call_function("div", number, F.lit(max(1, n["domain"] * n["context"]))),
        "domain": F.call_function("div", number, F.lit(max(1, n["context"]))) % max(1, n["domain"]),
        "context": number % max(1, n["context"]),
    }
    grid = weights.sparkSession.range(n["ad"] * n["domain"] * n["context"]).select(
        *[digit.alias(f"_{f}") for f, digit in digits.items()]
    )
    # A family's values are numbered within the family: a few rows of configuration.
    place = F.row_number().over(W.partitionBy("family").orderBy("position", "feature")) - 1
    placed = weights.withColumn("_place", place.cast("bigint"))
    for f, name in (("ad", "a"), ("domain", "d"), ("context", "x")):
        value = F.struct("position", "feature", "weight").alias(name)
        values = placed.filter(F.col("family") == f).select(F.col("_place").alias(f"_{f}"), value)
        grid = grid.join(values, f"_{f}")
    i, j, k = (F.col(f"{n}.position").cast("bigint") for n in ("a", "d", "x"))
    strength = F.lit(float(head.triplet_strength))
    # Fixed values of the seed formula: base and steps of the impressions, cycle of the clicks.
    impressions = F.lit(120) + i * 37 + j * 29 + k * 19 + ((i + j + k) % 5) * 11
    adjustment = (i * 2 + j + k) % 3 - 1
    counted = grid.select(
        F.col("a.feature").alias("ad_category"),
        F.col("d.feature").alias("publisher_domain"),
        F.col("x.feature").alias("conversation_category"),
        impressions.cast("bigint").alias("impressions"),
        prior_mean(head.w0, F.col("a.weight"), F.col("d.weight"), F.col("x.weight")).alias("_p"),
        adjustment.alias("_adjust"),
    )
    expected = scalar.round_half_even(F.col("impressions") * F.col("_p")).cast("bigint")
    primed = counted.select(
        *K.BUCKET_KEYS,
        "impressions",
        F.greatest(
            F.lit(0).cast("bigint"), F.least(F.col("impressions"), expected + F.col("_adjust"))
        ).alias("clicks"),
        (F.col("_p") * strength).alias("alpha_prior"),
        ((F.lit(1.0) - F.col("_p")) * strength).alias("beta_prior"),
    )
    return bucket_rows(primed, trust)


def fixed_seed_weights(spark: SparkSession) -> DataFrame:
    """The seed values with their positions."""
    rows = [
        (f, i, v, w)
        for f, pairs in K.SEED_WEIGHTS.items()
        for i, (v, w) in enumerate(pairs)
    ]
    schema = T.StructType([T.StructField("position", T.LongType()), *WEIGHTS.fields])
    return local_rows(spark, [(i, f, v, w) for f, i, v, w in rows], schema)


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """Counts and totals over a set of buckets."""
    zero = F.lit(0).cast("bigint")
    return buckets.agg(
        F.count("*").alias("bucket_count"),
        F.count_if("trusted").alias("trusted_bucket_count"),
        F.coalesce(F.sum("impressions"), zero).alias("total_impressions"),
        F.coalesce(F.sum("clicks"), zero).alias("total_clicks"),
    ).withColumn("observed_ctr", scalar.safe_ratio("total_clicks", "total_impressions"))


def seed_run(buckets: DataFrame, head: Head, name: str) -> DataFrame:
    """The summary of a seed run as the one row that its table takes: settings, totals, no artifact."""
    strengths = [F.lit(x) for f, v in sorted(head.family_strengths.items()) for x in (f, float(v))]
    config = F.struct(
        F.lit(float(head.baseline_ctr)).alias("baseline_prior_mean"),
        F.lit(float(head.triplet_strength)).alias("triplet_prior_strength"),
        F.lit(float(head.global_strength)).alias("global_prior_strength"),
        F.create_map(*strengths).alias("family_prior_strengths"),
    )
    return bucket_summary(buckets).select(
        F.lit(name).alias("experiment_name"),
        config.alias("config"),
        F.struct("*").alias("metrics"),
        F.lit(None).cast("string").alias("artifact_uri"),
    )


def runtime_snapshot(
    decoded: DataFrame,
    model_snapshot: DataFrame | None,
    model_count: int | Column = 0,
    experiment_count: int | Column = 0,
) -> DataFrame:
    """Totals of the stored state, its interval widths and the current model, one row.

    A missing model leaves its two columns NULL.
    """
    valid = F.col("valid")
    width = F.when(valid, F.col("ci_high") - F.col("ci_low"))
    zero = F.lit(0).cast("bigint")

    def as_count(value: int | Column) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")

    name, ctr = F.lit(None).cast("string"), F.lit(None).cast("double")
    if model_snapshot is not None:
        name = model_snapshot.select("snapshot_name").scalar()
        ctr = model_snapshot.select("metrics.baseline_ctr").scalar()
    return decoded.agg(
        F.count("*").alias("redis_bucket_keys_scanned"),
        F.count_if(valid).alias("redis_valid_bucket_count"),
        F.count_if(~valid).alias("redis_invalid_bucket_count"),
        F.coalesce(F.sum(F.when(valid, F.col("impressions"))), zero).alias("redis_total_impressions"),
        F.coalesce(F.sum(F.when(valid, F.col("clicks"))), zero).alias("redis_total_clicks"),
        F.count_if(valid & F.col("trusted")).alias("redis_trusted_bucket_count"),
        F.coalesce(F.avg(width), F.lit(0.0)).alias("redis_average_ci_width"),
        F.coalesce(F.max(width), F.lit(0.0)).alias("redis_max_ci_width"),
    ).select(
        "*",
        name.alias("current_model_snapshot_name"),
        ctr.alias("current_model_baseline_ctr"),
        as_count(model_count).alias("postgres_model_snapshot_count"),
        as_count(experiment_count).alias("postgres_experiment_result_count"),
    )


DELTA_METRICS = [
    "redis_total_impressions",
    "redis_total_clicks",
    "redis_valid_bucket_count",
    "redis_trusted_bucket_count",
    "postgres_model_snapshot_count",
    "postgres_experiment_result_count",
]


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of the count metrics of two runtime snapshots."""

    def long(snapshot: DataFrame, name: str) -> DataFrame:
        return snapshot.select(*DELTA_METRICS).unpivot([], DELTA_METRICS, "metric", name)

    return long(before, "before").join(long(after, "after"), "metric").withColumn(
        "delta", F.col("after") - F.col("before")
    )


def success_gates(
    before: DataFrame,
    after: DataFrame,
    produced: DataFrame,
    *,
    match_impressions: bool = False,
    match_clicks: bool = False,
    model_created: bool = False,
    max_invalid_buckets: int = 0,
    processor_health: bool = False,
    exited_early: int | Column = 0,
) -> DataFrame:
    """``passed`` and the failures of the configured gates, in fixed order.

    ``produced`` has one row (impressions, clicks) of what was published.
    """

    def pick(frame: DataFrame, *names: str) -> Column:
        return frame.select(F.struct(*names).alias("s")).scalar()

    counted = ["redis_total_impressions", "redis_total_clicks", "postgres_model_snapshot_count"]
    row = after.select("*").withColumns(
        {"_before": pick(before, *counted), "_made": pick(produced, "impressions", "clicks")}
    )
    row = row.select(
        F.col("_made.impressions").alias("produced_impressions"),
        F.col("_made.clicks").alias("produced_clicks"),
        *[
            (F.col(n) - F.col(f"_before.{n}")).alias(label)
            for n, label in zip(
                counted, ["redis_impression_delta", "redis_click_delta", "model_snapshot_delta"]
            )
        ],
        F.lit(max_invalid_buckets).cast("bigint").alias("max_invalid_redis_buckets"),
        F.col("redis_invalid_bucket_count").alias("_invalid"),
    )
    early = exited_early if isinstance(exited_early, Column) else F.lit(exited_early)
    c = F.col
    gates = [
        (match_impressions, c("redis_impression_delta") != c("produced_impressions"), "redis_impression_delta_mismatch"),
        (match_clicks, c("redis_click_delta") != c("produced_clicks"), "redis_click_delta_mismatch"),
        (model_created, c("model_snapshot_delta") < 1, "model_snapshot_not_created"),
        (True, c("_invalid") > c("max_invalid_redis_buckets"), "invalid_redis_bucket_count_too_high"),
        (processor_health, early > 0, "processor_exited_early"),
    ]
    failures = F.filter(
        F.array(*[F.when(F.lit(on) & bad, F.lit(name)) for on, bad, name in gates]),
        lambda x: x.isNotNull(),
    )
    return (
        row.withColumn("failures", failures)
        .withColumn("passed", F.size("failures") == 0)
        .drop("_invalid")
    )
