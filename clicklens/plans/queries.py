"""Registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens import constants as K
from clicklens.functions import checks, payload, scalar
from clicklens.operators import admission as A
from clicklens.operators import counts as C
from clicklens.operators import learning as L
from clicklens.operators import state as S
from clicklens.operators import throughput as P
from clicklens.operators import validity as V
from clicklens.operators.model import (
    current_snapshot,
    seed_model,
    unknown_features,
    with_priors,
)
from clicklens.operators.posterior import bucket_rows
from clicklens.operators.ranks import average_ranks, rank_correlation
from clicklens.plans import frames as B
from clicklens.plans.frames import rounded
from clicklens.schemas import BUCKET, EXPERIMENT_RESULT, SEED_RUN
from clicklens.session import configure, shared_folder
from clicklens.sources import adapters as X
from clicklens.sources import events as E
from clicklens.sources import logs
from clicklens.sources.tables import AppendTable, ModelStore, SnapshotTable, staged
from clicklens.streaming.evidence import EvidenceStream, Recalibrator
from clicklens.streaming.realtime import PER_EVENT, TIMED, RealtimeCtr

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return X.table(spark, folder, "lineitem")


def _line_value(spark: SparkSession, folder: str, **columns) -> DataFrame:
    return rounded(_lines(spark, folder).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in columns.items()]))


# Scalar functions -------------------------------------------------------------------------------


@query
def fn_sigmoid(spark, folder):
    return _line_value(spark, folder, p=scalar.sigmoid(F.col("l_discount") * 10 - 0.5))


@query
def fn_logit(spark, folder):
    return _line_value(spark, folder, log_odds=scalar.logit("l_discount"))


@query
def fn_clip(spark, folder):
    return _line_value(spark, folder, clipped=scalar.clip("l_quantity", 10.0, 40.0))


@query
def fn_safe_logit(spark, folder):
    return _line_value(spark, folder, log_odds=scalar.safe_logit("l_tax"))


@query
def fn_beta_variance(spark, folder):
    v = scalar.beta_variance(F.col("l_quantity") + 1.0, F.col("l_linenumber").cast("double"))
    return _line_value(spark, folder, variance=v)


@query
def fn_clipped_ci(spark, folder):
    low, high = scalar.clipped_interval("l_discount", F.col("l_tax") * 0.01, K.TRUST_Z)
    return _line_value(spark, folder, ci_low=low, ci_high=high)


@query
def fn_snapshot_name(spark, folder):
    orders = X.table(spark, folder, "orders")
    return orders.select(
        "o_orderkey", scalar.snapshot_name("weights", F.col("o_orderdate").cast("timestamp")).alias("name")
    )


@query
def trust_flag(spark, folder):
    return B.star_buckets(spark, folder).select(*K.BUCKET_KEYS, "impressions", "trusted")


# Events: parsing, keys, counts, routing ---------------------------------------------------------


@query
def event_validate(spark, folder):
    parsed = E.parse_events(B.mixed_text(spark, folder))
    shown = {n: F.when(F.col("valid"), F.col(n)) for n in ["event_id", "event_type", *K.BUCKET_KEYS]}
    return parsed.select(
        "valid",
        *[c.alias(n) for n, c in shown.items()],
        F.when(F.col("valid"), F.unix_micros("occurred_at")).alias("occurred_micros"),
    )


@query
def raw_key_extract(spark, folder):
    return B.mixed_text(spark, folder).select(
        F.col("_n").alias("event_number"), E.raw_bucket_key().alias("bucket_key")
    )


@query
def bucket_key(spark, folder):
    return X.star_evidence(spark, folder).select(
        payload.bucket_key().alias("bucket_key"), payload.store_key().alias("store_key"), "impressions"
    )


@query
def event_to_json(spark, folder):
    return X.valid_event_log(spark, folder).select("event_id", payload.event_json().alias("value"))


@query
def event_counts(spark, folder):
    return C.event_counts(X.valid_event_log(spark, folder))


@query
def triplet_counts(spark, folder):
    return C.triplet_counts(X.valid_event_log(spark, folder))


@query
def event_route(spark, folder):
    return C.route_events(X.valid_event_log(spark, folder), also_unified=True)


@query
def event_union(spark, folder):
    log = X.valid_event_log(spark, folder)
    both = C.union_topics(log.filter(C.is_impression()), log.filter(C.is_click()))
    return both.groupBy("event_type", *K.BUCKET_KEYS).agg(
        F.count("*").alias("events"), F.max(F.unix_micros("occurred_at")).alias("last_micros")
    )


@query
def src_event_stream(spark, folder):
    """The event stream read to the end: how many messages of each kind arrived."""
    out = shared_folder(spark, "events")
    running = (
        E.parse_events(X.event_text_stream(spark, X.event_log(spark, folder)))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{out}/rows")
    )
    running.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("valid", F.when(F.col("valid"), F.col("event_type")).alias("event_type")).agg(
        F.count("*").alias("events")
    )


# Admission and dead letters ---------------------------------------------------------------------


def _admission(spark, folder, **options) -> A.Admission:
    return A.admit_clicks(X.valid_event_log(spark, folder), **options)


@query
def click_admission(spark, folder):
    return _admission(spark, folder).runs.select(
        "event_id",
        "event_type",
        *K.BUCKET_KEYS,
        "copies",
        "accepted",
        "rejected",
        "impressions_after",
        "clicks_after",
    )


def _dead_letters(spark, folder) -> DataFrame:
    parsed = E.parse_events(X.event_text(X.event_log(spark, folder)))
    return A.invalid_dead_letters(E.invalid_events(parsed)).unionByName(
        A.rejected_clicks(A.admit_clicks(E.valid_events(parsed)))
    )


@query
def dead_letters(spark, folder):
    return _dead_letters(spark, folder)


@query
def dead_letter_sink(spark, folder):
    out = shared_folder(spark, "dead-letters")
    A.expand_copies(_dead_letters(spark, folder)).select(
        payload.dead_letter_json().alias("value")
    ).write.text(out)
    return spark.read.text(out)


@query
def flush_accounting(spark, folder):
    return A.flush_accounting(_admission(spark, folder), interval_ms=86_400_000, max_updates=3)


@query
def state_bootstrap(spark, folder):
    """The first half of the log becomes stored state, the second half continues from it."""
    log = X.valid_event_log(spark, folder)
    model = seed_model(spark)
    cut = F.lit(B.EVENT_SPLIT).cast("timestamp")
    first = A.admit_clicks(log.filter(F.col("occurred_at") < cut))
    stored = staged(A.new_buckets(first, None, model), "stored")
    later = A.admit_clicks(log.filter(F.col("occurred_at") >= cut), stored)
    return rounded(S.upsert(stored, A.new_buckets(later, stored, model)))


# Priors and posteriors --------------------------------------------------------------------------


@query
def prior_lookup(spark, folder):
    return rounded(with_priors(X.star_evidence(spark, folder), B.partial_model(spark, folder)))


@query
def bucket_posterior(spark, folder):
    return rounded(B.star_buckets(spark, folder))


@query
def evidence_snapshot(spark, folder):
    return rounded(L.evidence_snapshot(C.triplet_counts(X.valid_event_log(spark, folder)), seed_model(spark)))


@query
def evidence_scan_counts(spark, folder):
    log = X.event_log(spark, folder)
    counts = C.triplet_counts(log.filter(F.col("event_type").isin(K.IMPRESSION, K.CLICK)))
    bad = log.agg(F.count_if(~F.col("event_type").isin(K.IMPRESSION, K.CLICK)))
    return L.evidence_counts(counts, bad.scalar())


# Learning ---------------------------------------------------------------------------------------


@query
def feature_marginals(spark, folder):
    return L.feature_marginals(X.star_evidence(spark, folder))


@query
def global_ctr(spark, folder):
    return rounded(L.global_totals(X.star_evidence(spark, folder)))


@query
def baseline_proposal(spark, folder):
    totals = L.global_totals(B.staged_evidence(spark, folder))
    rows = [L.baseline_proposal(totals, B.star_head(), c) for c in (B.ACCEPT, B.REFUSE, B.FEATURES_ONLY)]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query
def unknown_feature_values(spark, folder):
    return unknown_features(
        L.feature_marginals(X.star_evidence(spark, folder)), B.partial_model(spark, folder).weights
    )


REGISTRY["unknown_features"] = REGISTRY.pop("unknown_feature_values")


@query
def family_update(spark, folder):
    marginals = L.feature_marginals(X.star_evidence(spark, folder))
    return rounded(L.family_updates(marginals, B.partial_model(spark, folder), B.ACCEPT))


@query
def family_centering(spark, folder):
    weights = B.star_weights(spark, folder).withColumn("weight", F.col("weight") + F.col("position"))
    return rounded(L.center_families(weights, "weight", "centered_weight"))


def _recalibration(spark, folder, config, evidence=None) -> L.Recalibration:
    evidence = B.staged_evidence(spark, folder) if evidence is None else evidence
    return L.recalibrate(evidence, B.partial_model(spark, folder), config)


@query
def update_metrics(spark, folder):
    evidence = B.staged_evidence(spark, folder)
    rows = [
        _recalibration(spark, folder, c, evidence).metrics_frame()
        for c in (B.ACCEPT, B.REFUSE, B.FEATURES_ONLY)
    ]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query
def recalibrate(spark, folder):
    done = _recalibration(spark, folder, B.ACCEPT)
    head = {n: F.lit(done.metrics[n]) for n in ("accepted", "new_w0", "new_baseline_ctr")}
    return rounded(done.weights.withColumns(head))


@query
def recalibrate_refused(spark, folder):
    return rounded(_recalibration(spark, folder, B.REFUSE).weights)


# Stored state -----------------------------------------------------------------------------------


@query
def seed_buckets(spark, folder):
    return rounded(S.seed_buckets(B.star_weights(spark, folder), B.star_head()))


@query
def seed_summary(spark, folder):
    return rounded(S.bucket_summary(S.seed_buckets(B.star_weights(spark, folder), B.star_head())))


@query
def seed_write(spark, folder):
    out = SnapshotTable(spark, shared_folder(spark, "seed"), BUCKET)
    out.write(S.seed_buckets(B.star_weights(spark, folder), B.star_head()))
    return rounded(out.read())


@query
def bucket_validate(spark, folder):
    decoded = S.decode_buckets(B.key_value_store(spark, folder))
    return decoded.select("key", "valid")


@query
def bucket_scan(spark, folder):
    valid, _ = S.scan_buckets(B.key_value_store(spark, folder))
    return rounded(valid)


@query
def bucket_lookup(spark, folder):
    return rounded(S.lookup_bucket(B.star_buckets(spark, folder), "ECONOMY", "HOUSEHOLD", "5-LOW"))


@query
def bucket_to_json(spark, folder):
    """Bucket payloads: their field names in order, and their values read back."""
    rows = S.as_key_values(B.star_buckets(spark, folder))
    fields = F.array_join(F.json_object_keys("value"), ",").alias("fields")
    return rounded(rows.select("key", fields, F.from_json("value", BUCKET).alias("_b")).select("key", "fields", "_b.*"))


@query
def bucket_persist(spark, folder):
    """A dry run and a real one, into a table that already holds another bucket."""
    store = staged(B.key_value_store(spark, folder), "store")
    schema = T.StructType([*BUCKET.fields, T.StructField("updated_at", T.TimestampType())])
    table = SnapshotTable(spark, shared_folder(spark, "persist"), schema)
    other = S.scan_buckets(store)[0].orderBy(*K.BUCKET_KEYS).limit(1)
    other = other.withColumns({k: F.lit("other") for k in K.BUCKET_KEYS} | {"updated_at": F.lit(None).cast("timestamp")})
    table.write(other)
    outcomes = []
    for dry_run in (True, False):
        result = S.persist_buckets(store, table, dry_run)
        # Rows that carry the time of this write, and all rows there are.
        stored = table.read().agg(F.count("*").alias("all"), F.count("updated_at").alias("new")).first()
        outcomes.append(result.withColumns({"stored_rows": F.lit(stored["all"]), "fresh_rows": F.lit(stored["new"])}))
    return outcomes[0].unionByName(outcomes[1])


@query
def bucket_upsert(spark, folder):
    seed, batch = B.star_split(spark, folder)
    newer = bucket_rows(with_priors(batch, B.star_model(spark, folder)))
    return rounded(S.upsert(seed, newer.filter("impressions > 2 * clicks")))


@query
def state_key_scan(spark, folder):
    return S.inspect_keys(B.key_value_store(spark, folder), "ctr:S*:?-*", 20).select("key")


def _model_history(spark, folder) -> DataFrame:
    per_year = (
        X.table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").cast("bigint").alias("id"))
        .agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("_share"))
    )
    return per_year.select(
        "id",
        F.concat(F.lit("orders_"), F.col("id").cast("string")).alias("snapshot_name"),
        scalar.safe_logit("_share").alias("w0"),
    )


@query
def model_current(spark, folder):
    return rounded(current_snapshot(_model_history(spark, folder)))


@query
def history_counts(spark, folder):
    models = _model_history(spark, folder).agg(F.count("*").alias("model_snapshots"))
    results = B.run_results(spark, folder).agg(F.count("*"))
    return models.withColumn("experiment_results", results.scalar())


@query
def model_snapshot_append(spark, folder):
    """A seeded model and the re-learned one after it; the second is current."""
    store = ModelStore(spark, shared_folder(spark, "models"))
    first = B.partial_model(spark, folder)
    store.append(first)
    done = _recalibration(spark, folder, B.ACCEPT)
    store.append(type(first)(first.head, done.weights).renamed("relearned"), done.metrics_frame())
    model = store.current()
    return rounded(model.weights.withColumn("snapshot_name", F.lit(model.head.snapshot_name)))


@query
def experiment_append(spark, folder):
    table = AppendTable(spark, shared_folder(spark, "experiments"), EXPERIMENT_RESULT)
    results = staged(B.run_results(spark, folder), "results")
    for run_id, *_ in B.RUNS:
        table.append(results.filter(F.col("config.run_id") == run_id))
    rows = table.read()
    return rows.select(
        "id",
        "experiment_name",
        F.col("config.parallelism").alias("parallelism"),
        F.size("metrics.processor_metrics.realtime_ctr.records").cast("bigint").alias("records"),
    )


@query
def seed_run_append(spark, folder):
    """Summaries of seed runs in their table: all seeded buckets, then those of the first ad category."""
    weights, head = B.star_weights(spark, folder), B.star_head()
    buckets = staged(S.seed_buckets(weights, head), "seed-run")
    table = AppendTable(spark, shared_folder(spark, "seed-runs"), SEED_RUN)
    table.append(S.seed_run(buckets, head, "all"))
    first = buckets.agg(F.min("ad_category")).scalar()
    table.append(S.seed_run(buckets.filter(F.col("ad_category") == first), head, "first"))
    return rounded(table.read().select("id", "experiment_name", "config.baseline_prior_mean", "metrics.*"))


@query
def duplicate_keys(spark, folder):
    orders = X.table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    return checks.duplicates(orders, ["o_custkey", "o_orderpriority"])


@query
def model_centered_check(spark, folder):
    weights = B.star_weights(spark, folder).withColumn(
        "weight", F.col("weight") + F.when(F.col("family") == "domain", 0.5).otherwise(0.0)
    )
    return rounded(checks.family_centering(weights))


@query
def strengths_check(spark, folder):
    per_nation = (
        X.table(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.min("c_acctbal").alias("low"), F.count("*").cast("double").alias("n"))
    )
    names = F.array(F.lit("ad"), F.lit("domain"), F.when(F.col("c_nationkey") % 4 == 0, "other").otherwise("context"))
    strengths = F.map_from_arrays(names, F.array("n", "n", F.col("low") + 900.0))
    return per_nation.select("c_nationkey", checks.valid_strengths(strengths).alias("valid"))


# Validity analytics -----------------------------------------------------------------------------


@query
def bucket_merge(spark, folder):
    return rounded(B.analysis(spark, folder))


@query
def sampling_z(spark, folder):
    return rounded(V.sampling_plausibility(B.analysis(spark, folder)), B.COARSE_DIGITS)


@query
def estimator_quality(spark, folder):
    return rounded(V.estimator_quality(B.analysis(spark, folder)))


@query
def uncertainty_summary(spark, folder):
    return rounded(V.uncertainty_summary(B.analysis(spark, folder)))


@query
def calibration_bands(spark, folder):
    return rounded(V.calibration_bands(B.analysis(spark, folder)))


@query
def family_validation(spark, folder):
    return rounded(V.family_validation(B.analysis(spark, folder)))


@query
def largest_errors(spark, folder):
    return rounded(V.largest_errors(B.analysis(spark, folder)))


@query
def spearman(spark, folder):
    """Rank correlation of quantity and price per return flag, over all line items."""
    return rounded(rank_correlation(_lines(spark, folder), "l_returnflag", "l_quantity", "l_extendedprice"))


@query
def average_rank(spark, folder):
    ranks = average_ranks(_lines(spark, folder), "l_returnflag", "l_quantity")
    return rounded(ranks)


def _merged(seed: DataFrame, batch: DataFrame) -> DataFrame:
    """Bucket rows after the new evidence; the priors stay."""
    both = V.merge_counts(seed, batch)
    return bucket_rows(
        both.withColumns(
            {
                "impressions": F.col("impressions") + F.col("batch_impressions"),
                "clicks": F.col("clicks") + F.col("batch_clicks"),
            }
        )
    )


@query
def reconciliation(spark, folder):
    early = F.col("shown_at") < F.lit(B.SPLIT).cast("timestamp")
    one = lambda c: F.sum(c.cast("double"))
    clicked = F.col("clicked")
    row = X.star_opportunities(spark, folder).agg(
        one(early).alias("before impressions"),
        one(early & clicked).alias("before clicks"),
        one(~early).alias("batch impressions"),
        one(~early & clicked).alias("batch clicks"),
        F.count("*").cast("double").alias("after impressions"),
        one(clicked).alias("after clicks"),
    )
    seed, batch = B.star_split(spark, folder)
    final = _merged(seed, batch)
    width = F.col("ci_high") - F.col("ci_low")
    before = seed.agg(F.avg(width).alias("average CI width before"))
    after = final.agg(F.avg(width).alias("average CI width after"), F.max(width).alias("maximum CI width after"))
    recorded = row.unpivot([], row.columns, "measurement", "value")
    for frame in (before, after):
        recorded = recorded.unionByName(frame.unpivot([], frame.columns, "measurement", "value"))
    rebuilt = V.reconstructed_measurements(V.analysis_frame(seed, batch))
    return rounded(V.reconcile(recorded, rebuilt))


def _snapshots(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    seed, batch = B.star_split(spark, folder)
    model = current_snapshot(_model_history(spark, folder)).select(
        "snapshot_name", F.struct(scalar.sigmoid("w0").alias("baseline_ctr")).alias("metrics")
    )
    models = _model_history(spark, folder).agg(F.count("*")).scalar()
    valid = lambda b: b.withColumn("valid", checks.valid_bucket())
    before = S.runtime_snapshot(valid(seed), model, models)
    after = S.runtime_snapshot(valid(_merged(seed, batch)), model, models)
    produced = batch.agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return before, after, produced


@query
def runtime_snapshot(spark, folder):
    before, after, _ = _snapshots(spark, folder)
    return rounded(before.withColumn("phase", F.lit("before")).unionByName(after.withColumn("phase", F.lit("after"))))


@query
def snapshot_delta(spark, folder):
    before, after, _ = _snapshots(spark, folder)
    return S.snapshot_delta(before, after)


@query
def success_gates(spark, folder):
    before, after, produced = _snapshots(spark, folder)
    wrong = produced.withColumn("clicks", F.col("clicks") + 1)
    strict = S.success_gates(
        before, after, wrong, match_impressions=True, match_clicks=True, model_created=True
    )
    loose = S.success_gates(before, after, produced, match_impressions=True, match_clicks=True)
    return strict.unionByName(loose).withColumn("failures", F.array_join("failures", ","))


# Throughput analytics ---------------------------------------------------------------------------


def _records(spark, folder) -> DataFrame:
    return P.with_record_index(B.run_records(spark, folder), ["run_id"])


@query
def record_index(spark, folder):
    return rounded(_records(spark, folder).drop("redis_flush_mode"), B.COARSE_DIGITS)


@query
def metrics_log_parse(spark, folder):
    """Records printed as log lines among others, written, read and parsed again."""
    records = B.run_records(spark, folder)
    fields = [c for c in records.columns if c not in ("run_id", "seq")]
    line = logs.log_line(F.struct(*fields))
    lines = records.select(
        F.explode(
            F.array(
                line,
                F.lit("INFO jobs.realtime: running"),
                F.lit(f"INFO jobs.realtime: {K.METRICS_MARKER}{{broken}}"),
            )
        ).alias("value")
    )
    out = shared_folder(spark, "log")
    lines.write.text(out)
    parsed = logs.parse_metrics_lines(logs.read_log(spark, out)).drop("file", "place")
    return rounded(parsed, B.COARSE_DIGITS)


@query
def experiment_records(spark, folder):
    out = shared_folder(spark, "results")
    B.run_results(spark, folder).write.json(out)
    records = logs.result_records(logs.read_result_lines(spark, out))
    return rounded(records.drop("seq", "redis_flush_mode"), B.COARSE_DIGITS)


@query
def metrics_average(spark, folder):
    return rounded(P.average_metrics(B.run_records(spark, folder), ["run_id"]), B.COARSE_DIGITS)


@query
def metrics_aggregate(spark, folder):
    return rounded(P.aggregate_metrics(B.run_records(spark, folder), ["run_id"]), B.COARSE_DIGITS)


@query
def full_window_rate(spark, folder):
    return rounded(P.full_window_rates(B.run_records(spark, folder), ["run_id"]), B.COARSE_DIGITS)


@query
def phase_totals(spark, folder):
    return rounded(P.phase_totals(B.run_results(spark, folder)), B.COARSE_DIGITS)


def _summary(spark, folder) -> DataFrame:
    records = B.run_records(spark, folder)
    return P.performance_summary(B.run_results(spark, folder, records), records)


@query
def perf_summary(spark, folder):
    return rounded(_summary(spark, folder), B.COARSE_DIGITS)


@query
def completeness(spark, folder):
    return P.completeness(_summary(spark, folder))


@query
def speedup_vs_reference(spark, folder):
    return rounded(P.speedup(_summary(spark, folder), reference_run=2), B.COARSE_DIGITS)


@query
def subtask_pivot(spark, folder):
    return P.subtask_distribution(B.run_records(spark, folder))


@query
def subtask_share(spark, folder):
    return rounded(P.subtask_shares(B.run_records(spark, folder)), B.COARSE_DIGITS)


# Streaming --------------------------------------------------------------------------------------


def _realtime(spark, folder, **options) -> RealtimeCtr:
    """The event log through the stream, four micro-batches in order of time."""
    job = RealtimeCtr(spark, shared_folder(spark, "realtime"), seed_model(spark), **options)
    job.start(X.event_text_stream(spark, X.event_log(spark, folder))).awaitTermination()
    return job


@query
def stream_ctr_update(spark, folder):
    return rounded(_realtime(spark, folder).buckets())


@query
def stream_restart(spark, folder):
    """Half of the log through one checkpoint, the rest through a fresh one on the same state."""
    log, at = X.event_log(spark, folder), F.col("occurred_at")
    cut = F.lit(B.EVENT_SPLIT).cast("timestamp")
    base = shared_folder(spark, "restart")
    for name, part in (("first", log.filter(at < cut)), ("second", log.filter(at.isNull() | (at >= cut)))):
        job = RealtimeCtr(spark, f"{base}/job", seed_model(spark))
        job.start(X.event_text_stream(spark, part, 2), checkpoint=f"{base}/{name}").awaitTermination()
    return rounded(job.buckets())


@query
def stream_star_update(spark, folder):
    """Line items as a stream of impressions and clicks; ends at the batch posterior."""
    job = RealtimeCtr(
        spark,
        shared_folder(spark, "star-stream"),
        B.star_model(spark, folder),
        slot_seconds=86_400,
    )
    job.start(X.event_text_stream(spark, X.star_event_log(spark, folder))).awaitTermination()
    return rounded(job.buckets())


@query
def state_sink_per_event(spark, folder):
    """Every accepted event's bucket row, reduced to the number of writes and the last of each."""
    writes = _realtime(spark, folder, flush_mode=PER_EVENT).writes()
    return rounded(
        writes.groupBy(*K.BUCKET_KEYS).agg(
            F.sum("updates").alias("writes"),
            F.max("impressions").alias("impressions"),
            F.max("clicks").alias("clicks"),
            F.max_by("ctr", F.col("impressions") + F.col("clicks")).alias("ctr"),
        )
    )


@query
def state_sink_coalesced(spark, folder):
    writes = _realtime(spark, folder).writes()
    return rounded(
        writes.groupBy(*K.BUCKET_KEYS).agg(
            F.max("impressions").alias("impressions"),
            F.max("clicks").alias("clicks"),
            F.max_by("ctr", F.col("impressions") + F.col("clicks")).alias("ctr"),
        )
    )


@query
def stream_timed_writes(spark, folder):
    """The stream's own writes, cut by interval and number of updates over four micro-batches."""
    job = _realtime(spark, folder, flush_mode=TIMED, interval_ms=86_400_000, max_updates=3)
    job.flush()
    carried = F.sum("updates")
    return job.writes().groupBy(*K.BUCKET_KEYS).agg(
        F.sum("flushes").alias("flushes"),
        carried.alias("updates_flushed"),
        (carried - F.sum("flushes")).alias("updates_coalesced"),
    )


@query
def stream_metrics(spark, folder):
    progress = _realtime(spark, folder).progress()
    counters = ["processed_events", "valid_events", "impressions", "clicks", "dead_letters"]
    return P.last_records(progress, []).select(*counters, "redis_updates_flushed")


@query
def stream_triplet_counts(spark, folder):
    job = EvidenceStream(spark, shared_folder(spark, "evidence"))
    job.start(X.event_text_stream(spark, X.event_log(spark, folder))).awaitTermination()
    counts, invalid = job.counts()
    return counts.withColumn("invalid_events", invalid.scalar())


@query
def stream_latest(spark, folder):
    """The first half of the log lies there when the stream starts at the latest event; the second arrives after."""
    log, at = X.event_log(spark, folder), F.col("occurred_at")
    cut = F.lit(B.EVENT_SPLIT).cast("timestamp")
    topic, job = shared_folder(spark, "topic"), EvidenceStream(spark, shared_folder(spark, "latest"))
    for part in (log.filter(at < cut), log.filter(at >= cut)):
        files = X.write_topic(spark, part, topic, 2)
        job.start(E.text_event_stream(spark, topic, files), starting="latest").awaitTermination()
    counts, invalid = job.counts()
    return counts.withColumn("invalid_events", invalid.scalar())


@query
def stream_recalibrate(spark, folder):
    """Two clock ticks on the evidence of the stream: the second learns from the first."""
    base = shared_folder(spark, "relearn")
    job = EvidenceStream(spark, f"{base}/evidence")
    job.start(X.event_text_stream(spark, X.event_log(spark, folder))).awaitTermination()
    models = ModelStore(spark, f"{base}/models")
    models.append(seed_model(spark))
    clock = Recalibrator(
        job,
        models,
        L.Learning(
            baseline_max_ci_width=1.0,
            max_feature_ci_width=1.0,
            min_feature_impressions=1,
        ),
    )
    for second in (1, 2):
        clock.tick(datetime(2024, 2, 1, 0, 0, second, tzinfo=timezone.utc))
    model = models.current()
    return rounded(
        model.weights.withColumns(
            {
                "snapshot_name": F.lit(model.head.snapshot_name),
                "w0": F.lit(model.head.w0),
                "baseline_ctr": F.lit(model.head.baseline_ctr),
            }
        )
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior CTR of every triplet of the star tables."""
    return REGISTRY["bucket_posterior"](spark, folder)
