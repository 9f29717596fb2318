"""Frames that several registered queries start from. All grow with the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens import constants as K
from clicklens.operators import state as S
from clicklens.operators import throughput as P
from clicklens.operators import validity as V
from clicklens.operators.learning import Learning
from clicklens.operators.model import Head, Model, with_priors
from clicklens.operators.posterior import bucket_rows
from clicklens.sources import adapters as X
from clicklens.sources.tables import staged

# Known click rate of the star tables and weight step per family. The steps differ, so that no two
# triplets share a prior by accident of rounding.
STAR_BASELINE = 1.0 / 3.0
STAR_STEPS = {"ad": 0.053, "domain": 0.031, "context": 0.0171}
SPLIT = "1998-05-01"
EVENT_SPLIT = "2024-01-16"
DIGITS = 12
COARSE_DIGITS = 6

# Learning controls of the registered queries: one that is accepted with some features too wide,
# and one that fails the baseline guard.
ACCEPT = Learning(baseline_max_ci_width=0.02, max_feature_ci_width=0.0145)
REFUSE = Learning(baseline_max_ci_width=0.0005)
FEATURES_ONLY = Learning(baseline_max_ci_width=0.02, baseline_update=False)


def rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for output (variances finer): engines differ in the last bits."""
    out = []
    for f in rows.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            column = F.round(column, 12 if "variance" in f.name else digits)
        out.append(column.alias(f.name))
    return rows.select(*out)


def star_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """(family, feature, position, features): the attribute values of the star tables."""
    sources = {
        "ad": ("part", "p_type"),
        "domain": ("customer", "c_mktsegment"),
        "context": ("orders", "o_orderpriority"),
    }
    parts = [
        X.table(spark, folder, name).select(F.lit(f).alias("family"), F.col(c).alias("feature"))
        for f, (name, c) in sources.items()
    ]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    # Windows over attribute values, not over rows.
    family = W.partitionBy("family")
    return values.select(
        "family",
        "feature",
        (F.row_number().over(family.orderBy("feature")) - 1).cast("bigint").alias("position"),
        F.count("*").over(family).alias("features"),
    )


def star_weights(spark: SparkSession, folder: str) -> DataFrame:
    """(family, position, feature, weight): evenly spaced, centred weights."""
    step = F.lit(None).cast("double")
    for family, value in STAR_STEPS.items():
        step = F.when(F.col("family") == family, F.lit(value)).otherwise(step)
    offset = F.col("position").cast("double") - (F.col("features") - 1).cast("double") / F.lit(2.0)
    weights = star_dimensions(spark, folder).select(
        "family", "position", "feature", (step * offset).alias("weight")
    )
    return staged(weights, "star-weights")


def star_head() -> Head:
    return Head("star_v1", math.log(STAR_BASELINE / (1.0 - STAR_BASELINE)), STAR_BASELINE)


def star_model(spark: SparkSession, folder: str) -> Model:
    return Model(star_head(), star_weights(spark, folder).select("family", "feature", "weight"))


def partial_model(spark: SparkSession, folder: str) -> Model:
    """The star model without the first value of every family and with one value never seen."""
    weights = star_weights(spark, folder)
    known = weights.filter("position > 0").select("family", "feature", "weight")
    unseen = (
        weights.groupBy("family")
        .agg(F.max("position").alias("_p"))
        .select("family", F.lit("UNSEEN").alias("feature"), (F.col("_p") * F.lit(0.01)).alias("weight"))
    )
    return Model(star_head(), known.unionByName(unseen))


def staged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The star evidence for queries that read it several times."""
    return staged(X.star_evidence(spark, folder), "evidence")


def star_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket rows of the whole star evidence."""
    counts = X.star_evidence(spark, folder)
    return bucket_rows(with_priors(counts, star_model(spark, folder)))


def star_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Evidence shipped before the split date as seed, and the rest as new batch."""
    early = F.col("shown_at") < F.lit(SPLIT).cast("timestamp")
    counts = staged(
        X.star_opportunities(spark, folder)
        .groupBy(*K.BUCKET_KEYS)
        .agg(
            F.count_if(early).alias("_i0"),
            F.count_if(early & F.col("clicked")).alias("_c0"),
            F.count_if(~early).alias("_i1"),
            F.count_if(~early & F.col("clicked")).alias("_c1"),
        ),
        "star-split",
    )
    pick = lambda i, c: counts.select(
        *K.BUCKET_KEYS, F.col(i).alias("impressions"), F.col(c).alias("clicks")
    )
    seed = bucket_rows(with_priors(pick("_i0", "_c0"), star_model(spark, folder)))
    return seed, pick("_i1", "_c1")


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    seed, batch = star_split(spark, folder)
    return staged(V.analysis_frame(seed, batch, digits=DIGITS), "analysis")


def key_value_store(spark: SparkSession, folder: str) -> DataFrame:
    """Star buckets as a keyed store in which some payloads are damaged, plus a foreign key."""
    buckets = staged(star_buckets(spark, folder), "store")
    excess = buckets.filter("impressions % 11 = 3").withColumn("clicks", F.col("impressions") + 1)
    clicks = F.get_json_object("value", "$.clicks").cast("bigint")
    sound = S.as_key_values(buckets.filter("impressions % 11 <> 3")).withColumn(
        "value",
        F.when(clicks % 7 == 0, F.lit("not json"))
        .when(clicks % 7 == 1, F.concat("value", F.lit(" {}")))
        .when(clicks % 7 == 2, F.regexp_replace("value", r'"variance":[^,}]*', '"variance":"NaN"'))
        .otherwise(F.col("value")),
    )
    foreign = X.table(spark, folder, "region").select(
        F.concat(F.lit("weights:"), "r_name").alias("key"), F.lit("{}").alias("value")
    )
    return sound.unionByName(S.as_key_values(excess)).unionByName(foreign)


def mixed_text(spark: SparkSession, folder: str) -> DataFrame:
    """Event text of which some is cut off, has a number as id, text or a second object behind it, or single quotes."""
    text = X.event_log(spark, folder).select(
        F.col("event_id").cast("bigint").alias("_n"), X.event_json().alias("value")
    )
    return text.select(
        "_n",
        F.when(F.col("_n") % 7 == 0, F.substring("value", 1, 40))
        .when(F.col("_n") % 11 == 0, F.regexp_replace("value", r'"event_id":"(\d+)"', '"event_id":$1'))
        .when(F.col("_n") % 13 == 0, F.concat("value", F.lit(" trailing")))
        .when(F.col("_n") % 17 == 0, F.concat("value", F.lit(","), "value"))
        .when(F.col("_n") % 19 == 0, F.translate("value", '"', "'"))
        .otherwise(F.col("value"))
        .alias("value"),
    )


RUNS = [
    (1, "P1 / per-event", 1, "per_event"),
    (2, "P2 / periodic", 2, "periodic"),
    (3, "P4 / periodic", 4, "periodic"),
]


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """The progress records, reduced from the events once."""
    return staged(_run_records(spark, folder), "records")


def _run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Progress records of three runs over the event log that differ in parallelism and mode."""
    runs = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(p).alias("parallelism"), F.lit(m).alias("mode"))
            for i, _, p, m in RUNS
        ]
    )
    events = X.event_log(spark, folder).select(
        "event_id", "event_type", "occurred_at", F.explode(runs).alias("_run")
    )
    return P.progress_records(
        events.withColumn("run_id", F.col("_run.id")),
        F.col("event_type"),
        F.col("event_id").cast("bigint") % F.col("_run.parallelism"),
        86_400,
        F.col("_run.mode"),
        ["run_id"],
    )


def run_results(spark: SparkSession, folder: str, records: DataFrame | None = None) -> DataFrame:
    """The three runs as experiment results: one nested row per run."""
    records = run_records(spark, folder) if records is None else records
    fields = [c for c in records.columns if c not in ("run_id", "seq")]
    # A result document holds the records of its run: one per subtask and day.
    per_run = records.groupBy("run_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "subtask_index", F.struct(*fields).alias("r")))),
            lambda x: x["r"],
        ).alias("records")
    )
    log = X.event_log(spark, folder)
    halves = (
        log.groupBy((F.col("occurred_at") >= F.lit(EVENT_SPLIT).cast("timestamp")).alias("late"))
        .agg(
            F.count_if(F.col("event_type") == K.IMPRESSION).alias("impressions"),
            F.count_if(F.col("event_type") == K.CLICK).alias("clicks"),
            F.count("*").alias("total_events"),
            ((F.max(F.unix_micros("occurred_at")) - F.min(F.unix_micros("occurred_at"))) / F.lit(1e6)).alias(
                "produce_seconds"
            ),
        )
    )
    traffic = halves.agg(
        F.struct(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.when(F.col("late"), "late").otherwise("early").alias("phase_name"),
                        F.struct("impressions", "clicks", "total_events").alias("producer"),
                        F.struct("produce_seconds").alias("timing"),
                    )
                )
            ).alias("phases"),
            F.sum("total_events").alias("total_events"),
            F.sum("impressions").alias("impressions"),
            F.sum("clicks").alias("clicks"),
        ).alias("t")
    ).scalar()
    labels = F.create_map(*[x for i, label, _, _ in RUNS for x in (F.lit(i).cast("bigint"), F.lit(label))])
    width = F.create_map(*[x for i, _, p, _ in RUNS for x in (F.lit(i).cast("bigint"), F.lit(p).cast("bigint"))])
    modes = F.create_map(*[x for i, _, _, m in RUNS for x in (F.lit(i).cast("bigint"), F.lit(m))])
    c = F.col
    row = per_run.withColumn("_t", traffic)
    return row.select(
        F.concat(F.lit("run_"), c("run_id").cast("string")).alias("experiment_name"),
        F.struct(
            "run_id",
            labels[c("run_id")].alias("short_label"),
            width[c("run_id")].alias("parallelism"),
            modes[c("run_id")].alias("redis_strategy"),
        ).alias("config"),
        F.struct(
            F.struct(F.struct("records").alias("realtime_ctr")).alias("processor_metrics"),
            F.struct(c("_t.phases").alias("phases"), c("_t.total_events").alias("total_events")).alias("traffic"),
            F.struct(
                c("_t.impressions").alias("impressions"),
                c("_t.clicks").alias("clicks"),
                c("_t.total_events").alias("total_events"),
            ).alias("producer"),
            F.struct(
                F.struct(
                    c("_t.impressions").alias("redis_total_impressions"),
                    c("_t.clicks").alias("redis_total_clicks"),
                ).alias("delta")
            ).alias("statistics"),
            F.struct(
                (c("run_id") != 3).alias("passed"), F.array().cast("array<string>").alias("failures")
            ).alias("success_gates"),
        ).alias("metrics"),
    )
