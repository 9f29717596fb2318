"""Text forms of keys, events, buckets and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicklens import constants as K


def bucket_key() -> Column:
    """``a:d:c``. A label only: values may contain ``:``, so grouping uses the three columns."""
    return F.concat_ws(":", *K.BUCKET_KEYS)


def store_key() -> Column:
    return F.concat_ws(":", F.lit(K.STORE_PREFIX), *K.BUCKET_KEYS)


def iso_timestamp(at: Column | str) -> Column:
    """ISO-8601 with UTC offset; the fraction is left out when it is zero."""
    at = F.col(at) if isinstance(at, str) else at
    fraction = F.when(F.unix_micros(at) % 1_000_000 == 0, F.lit("")).otherwise(
        F.date_format(at, ".SSSSSS")
    )
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def event_json() -> Column:
    """Event as JSON text; a missing impression id is written as null."""
    return F.to_json(
        F.struct(
            "event_id",
            "event_type",
            *K.BUCKET_KEYS,
            iso_timestamp("occurred_at").alias("occurred_at"),
            "impression_event_id",
        ),
        {"ignoreNullFields": "false"},
    )


def bucket_json() -> Column:
    """Bucket as JSON text with keys in sorted order."""
    from clicklens.schemas import BUCKET

    return F.to_json(F.struct(*sorted(BUCKET.fieldNames())), {"ignoreNullFields": "false"})


def model_json() -> Column:
    """Model snapshot row as JSON text with keys in sorted order."""
    return F.to_json(
        F.struct(
            F.struct(
                F.col("metrics.baseline_ctr").alias("baseline_ctr"),
                F.col("metrics.family_prior_strengths").alias("family_prior_strengths"),
                F.col("metrics.global_prior_strength").alias("global_prior_strength"),
                F.col("metrics.triplet_prior_strength").alias("triplet_prior_strength"),
            ).alias("metrics"),
            "snapshot_name",
            "w0",
            F.struct(
                F.col("weights.w_ad").alias("w_ad"),
                F.col("weights.w_ctx").alias("w_ctx"),
                F.col("weights.w_dom").alias("w_dom"),
            ).alias("weights"),
        )
    )


def dead_letter_json() -> Column:
    """``{"reason": .., "event": {..}}``; ``event`` holds JSON text, reasons are fixed words."""
    return F.concat(
        F.lit('{"reason":"'), F.col("reason"), F.lit('","event":'), F.col("event"), F.lit("}")
    )
