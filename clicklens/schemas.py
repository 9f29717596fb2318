"""Record schemas. Readers always pass one of these; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


EVENT = _struct(
    ("event_id", _S),
    ("event_type", _S),
    ("ad_category", _S),
    ("publisher_domain", _S),
    ("conversation_category", _S),
    ("occurred_at", T.TimestampType()),
    ("impression_event_id", _S),
)

BUCKET = _struct(
    ("ad_category", _S),
    ("publisher_domain", _S),
    ("conversation_category", _S),
    ("impressions", _L),
    ("clicks", _L),
    ("alpha_prior", _D),
    ("beta_prior", _D),
    ("alpha_posterior", _D),
    ("beta_posterior", _D),
    ("ctr", _D),
    ("variance", _D),
    ("ci_low", _D),
    ("ci_high", _D),
    ("trusted", _B),
)

WEIGHTS = _struct(("family", _S), ("feature", _S), ("weight", _D))

_WEIGHT_MAP = T.MapType(_S, _D)
MODEL = _struct(
    ("snapshot_name", _S),
    ("w0", _D),
    ("weights", _struct(("w_ad", _WEIGHT_MAP), ("w_dom", _WEIGHT_MAP), ("w_ctx", _WEIGHT_MAP))),
    (
        "metrics",
        _struct(
            ("baseline_ctr", _D),
            ("global_prior_strength", _D),
            ("triplet_prior_strength", _D),
            ("family_prior_strengths", _WEIGHT_MAP),
        ),
    ),
)

DEAD_LETTER = _struct(("reason", _S), ("event", _S), ("copies", _L))

# One progress record of a stream processor. Numbers are read as doubles where a record may carry
# either form; a value of another JSON type becomes NULL.
PROCESSOR_RECORD = _struct(
    ("subtask_index", _L),
    ("processed_events", _L),
    ("valid_events", _L),
    ("impressions", _L),
    ("clicks", _L),
    ("dead_letters", _L),
    ("redis_flush_mode", _S),
    ("redis_flushes", _L),
    ("redis_updates_flushed", _L),
    ("redis_updates_coalesced", _L),
    ("elapsed_seconds", _D),
    ("events_per_second", _D),
    ("window_events", _L),
    ("window_seconds", _D),
    ("window_events_per_second", _D),
)

RUNTIME_SNAPSHOT = _struct(
    ("redis_bucket_keys_scanned", _L),
    ("redis_valid_bucket_count", _L),
    ("redis_invalid_bucket_count", _L),
    ("redis_total_impressions", _L),
    ("redis_total_clicks", _L),
    ("redis_trusted_bucket_count", _L),
    ("redis_average_ci_width", _D),
    ("redis_max_ci_width", _D),
    ("current_model_snapshot_name", _S),
    ("current_model_baseline_ctr", _D),
    ("postgres_model_snapshot_count", _L),
    ("postgres_experiment_result_count", _L),
)

# Fixed names: the metrics of one learning pass.
RUN_METRICS = _struct(
    ("accepted", _B),
    ("skipped_reason", _S),
    ("input_bucket_count", _L),
    ("valid_bucket_count", _L),
    ("invalid_bucket_count", _L),
    ("ad_feature_bucket_count", _L),
    ("domain_feature_bucket_count", _L),
    ("context_feature_bucket_count", _L),
    ("updated_feature_bucket_count", _L),
    ("skipped_feature_bucket_count", _L),
    ("insufficient_impression_feature_count", _L),
    ("wide_ci_feature_count", _L),
    ("unknown_feature_count", _L),
    ("max_absolute_weight_delta", _D),
    ("learning_rate", _D),
    ("evidence_smoothing", _D),
    ("ridge", _D),
    ("max_delta", _D),
    ("min_feature_impressions", _L),
    ("max_feature_ci_width", _D),
    ("dry_run", _B),
    ("w0_unchanged", _B),
    ("old_w0", _D),
    ("new_w0", _D),
    ("baseline_delta", _D),
    ("baseline_update_enabled", _B),
    ("baseline_update_applied", _B),
    ("aggregate_impressions", _L),
    ("aggregate_clicks", _L),
    ("aggregate_observed_ctr", _D),
    ("posterior_baseline_ctr", _D),
    ("baseline_ci_low", _D),
    ("baseline_ci_high", _D),
    ("baseline_ci_width", _D),
    ("baseline_guard_reason", _S),
    ("valid_baseline_bucket_count", _L),
    ("invalid_baseline_bucket_count", _L),
    ("new_baseline_ctr", _D),
)

_PHASE = _struct(
    ("phase_name", _S),
    ("producer", _struct(("impressions", _L), ("clicks", _L), ("total_events", _L))),
    ("timing", _struct(("produce_seconds", _D))),
)

EXPERIMENT_RESULT = _struct(
    ("experiment_name", _S),
    (
        "config",
        _struct(
            ("run_id", _L),
            ("short_label", _S),
            ("parallelism", _L),
            ("redis_strategy", _S),
        ),
    ),
    (
        "metrics",
        _struct(
            (
                "processor_metrics",
                _struct(("realtime_ctr", _struct(("records", T.ArrayType(PROCESSOR_RECORD))))),
            ),
            ("traffic", _struct(("phases", T.ArrayType(_PHASE)), ("total_events", _L))),
            ("producer", _struct(("impressions", _L), ("clicks", _L), ("total_events", _L))),
            (
                "statistics",
                _struct(
                    ("before", RUNTIME_SNAPSHOT),
                    ("after", RUNTIME_SNAPSHOT),
                    ("delta", _struct(("redis_total_impressions", _L), ("redis_total_clicks", _L))),
                ),
            ),
            ("success_gates", _struct(("passed", _B), ("failures", T.ArrayType(_S)))),
        ),
    ),
)

# Summary of a seed run, as one appended row.
SEED_RUN = _struct(
    ("experiment_name", _S),
    (
        "config",
        _struct(
            ("baseline_prior_mean", _D),
            ("triplet_prior_strength", _D),
            ("global_prior_strength", _D),
            ("family_prior_strengths", T.MapType(_S, _D)),
        ),
    ),
    (
        "metrics",
        _struct(
            ("bucket_count", _L),
            ("trusted_bucket_count", _L),
            ("total_impressions", _L),
            ("total_clicks", _L),
            ("observed_ctr", _D),
        ),
    ),
    ("artifact_uri", _S),
)
