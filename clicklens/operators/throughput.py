"""Throughput analytics over processor progress records.

A record is one line per subtask and progress window, with counters that are cumulative per
subtask. ``seq`` gives the order of records within a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklens.functions import scalar
from clicklens.schemas import PROCESSOR_RECORD

COUNTERS = [
    "processed_events",
    "valid_events",
    "impressions",
    "clicks",
    "dead_letters",
    "redis_flushes",
    "redis_updates_flushed",
    "redis_updates_coalesced",
]
NUMERIC = [
    f.name
    for f in PROCESSOR_RECORD.fields
    if f.name not in ("subtask_index", "redis_flush_mode")
]


def progress_records(
    events: DataFrame,
    outcome: Column,
    subtask: Column,
    window_seconds: int,
    flush_mode: Column | str = "periodic",
    run: list[str] | None = None,
) -> DataFrame:
    """Cumulative progress per subtask and time window of timed events.

    ``outcome`` is 'impression', 'click' or anything else for a dead letter. Events are reduced to
    windows first; only the windows are then scanned in order. The flush counters follow the
    chosen mode: a write per event, or one write per window in which something was accepted.
    ``run`` names columns that keep several runs apart.
    """
    run = run or []
    mode = flush_mode if isinstance(flush_mode, Column) else F.lit(flush_mode)
    width = int(window_seconds * 1_000_000)
    c = F.col
    windows = (
        events.select(
            *run,
            mode.alias("redis_flush_mode"),
            subtask.cast("bigint").alias("subtask_index"),
            F.unix_micros("occurred_at").alias("_at"),
            outcome.alias("_outcome"),
        )
        .groupBy(*run, "redis_flush_mode", "subtask_index", F.expr(f"_at div {width}").alias("_w"))
        .agg(
            F.count("*").alias("window_events"),
            F.count_if(c("_outcome") == "impression").alias("_i"),
            F.count_if(c("_outcome") == "click").alias("_c"),
            F.min("_at").alias("_first"),
            F.max("_at").alias("_last"),
        )
    )
    order = W.partitionBy(*run, "subtask_index").orderBy("_w")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    valid = c("_i") + c("_c")
    flushes = F.when(c("redis_flush_mode") == "per_event", valid).otherwise(
        (valid > 0).cast("bigint")
    )
    running = windows.select(
        *run,
        "redis_flush_mode",
        "subtask_index",
        "window_events",
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.sum("window_events").over(so_far).alias("processed_events"),
        F.sum("_i").over(so_far).alias("impressions"),
        F.sum("_c").over(so_far).alias("clicks"),
        F.sum(flushes).over(so_far).alias("redis_flushes"),
        (c("_last") - F.min("_first").over(so_far)).alias("_elapsed"),
        (c("_last") - F.coalesce(F.lag("_last").over(order), c("_first"))).alias("_window"),
    )
    seconds = lambda micros: c(micros) / F.lit(1_000_000.0)
    return running.withColumns(
        {
            "valid_events": c("impressions") + c("clicks"),
            "elapsed_seconds": seconds("_elapsed"),
            "window_seconds": seconds("_window"),
        }
    ).select(
        *run,
        "seq",
        "subtask_index",
        "processed_events",
        "valid_events",
        "impressions",
        "clicks",
        (c("processed_events") - c("valid_events")).alias("dead_letters"),
        "redis_flush_mode",
        "redis_flushes",
        c("valid_events").alias("redis_updates_flushed"),
        (c("valid_events") - c("redis_flushes")).alias("redis_updates_coalesced"),
        "elapsed_seconds",
        scalar.safe_ratio("processed_events", "elapsed_seconds").alias("events_per_second"),
        "window_events",
        "window_seconds",
        scalar.safe_ratio("window_events", "window_seconds").alias("window_events_per_second"),
    )


def with_record_index(records: DataFrame, run: list[str]) -> DataFrame:
    """Ordinal of a record within its subtask, from 1."""
    order = W.partitionBy(*run, "subtask_index").orderBy("seq")
    return records.withColumn("record_index", F.row_number().over(order).cast("bigint"))


def average_metrics(records: DataFrame, run: list[str]) -> DataFrame:
    """Mean of each numeric metric over the records that carry it, as (run, metric, average)."""
    long = records.select(*run, *[F.col(n).cast("double").alias(n) for n in NUMERIC]).unpivot(
        run, NUMERIC, "metric", "value"
    )
    return (
        long.filter("value IS NOT NULL").groupBy(*run, "metric").agg(F.avg("value").alias("average"))
    )


def last_records(records: DataFrame, run: list[str]) -> DataFrame:
    """The last record of each subtask."""
    fields = [c for c in records.columns if c not in (*run, "subtask_index")]
    return (
        records.groupBy(*run, "subtask_index")
        .agg(F.max_by(F.struct(*fields), F.col("seq")).alias("_r"))
        .select(*run, "subtask_index", "_r.*")
    )


def full_windows(records: DataFrame, run: list[str]) -> DataFrame:
    """Records whose window is as large as the largest of their subtask, with their ordinal."""
    largest = records.groupBy(*run, "subtask_index").agg(
        F.max(F.coalesce("window_events", F.lit(0))).alias("_largest")
    )
    full = records.join(largest, [*run, "subtask_index"]).filter(
        F.coalesce("window_events", F.lit(0)) == F.col("_largest")
    )
    order = W.partitionBy(*run, "subtask_index").orderBy("seq")
    return full.drop("_largest").withColumn("full_index", F.row_number().over(order).cast("bigint"))


def full_window_rates(records: DataFrame, run: list[str]) -> DataFrame:
    """Per subtask: full windows, their mean rate, and the mean without the first of several."""
    rate = F.coalesce("window_events_per_second", F.lit(0.0))
    return (
        full_windows(records, run)
        .groupBy(*run, "subtask_index")
        .agg(
            F.count("*").alias("full_windows"),
            F.avg(rate).alias("full_window_eps"),
            F.avg(F.when(F.col("full_index") > 1, rate)).alias("_later"),
        )
        .withColumn("post_warmup_eps", F.coalesce("_later", "full_window_eps"))
        .drop("_later")
    )


def aggregate_metrics(records: DataFrame, run: list[str]) -> DataFrame:
    """Totals of a run over its subtasks: counters are summed from the last records, the elapsed
    time is the longest, the rate is total over longest, window rates add up."""
    last = last_records(records, run)
    totals = last.groupBy(*run).agg(
        F.count("*").alias("subtask_count"),
        *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in COUNTERS],
        F.max(F.coalesce("elapsed_seconds", F.lit(0.0))).alias("elapsed_seconds"),
    )
    rates = full_window_rates(records, run).groupBy(*run).agg(
        F.sum("full_window_eps").alias("window_events_per_second"),
        F.sum("post_warmup_eps").alias("post_warmup_eps"),
        F.sum("full_windows").alias("full_window_records"),
    )
    return totals.withColumn(
        "events_per_second", scalar.safe_ratio("processed_events", "elapsed_seconds")
    ).join(rates, run)


def phase_totals(results: DataFrame) -> DataFrame:
    """Produced totals over the traffic phases of each result and the observed rate."""
    phases = results.select(
        F.col("config.run_id").alias("run_id"), F.explode("metrics.traffic.phases").alias("p")
    )
    zero = F.lit(0).cast("bigint")
    return (
        phases.groupBy("run_id")
        .agg(
            F.sum(F.coalesce("p.producer.impressions", zero)).alias("total_impressions"),
            F.sum(F.coalesce("p.producer.clicks", zero)).alias("total_clicks"),
            F.sum(F.coalesce("p.producer.total_events", zero)).alias("total_events"),
            F.sum(F.coalesce("p.timing.produce_seconds", F.lit(0.0))).alias("produce_seconds"),
        )
        .withColumn(
            "observed_events_per_second", scalar.safe_ratio("total_events", "produce_seconds")
        )
    )


def performance_summary(results: DataFrame, records: DataFrame) -> DataFrame:
    """One row per run: three throughput views and the write efficiency.

    A run whose records have no flush counters counts one write per valid event.
    """
    c = F.col
    has_flush = records.groupBy("run_id").agg(
        (F.count("redis_flushes") > 0).alias("_has_flush")
    )
    totals = aggregate_metrics(records, ["run_id"]).join(has_flush, "run_id")
    heads = results.select(
        c("config.run_id").alias("run_id"),
        c("config.short_label").alias("short_label"),
        c("config.parallelism").alias("parallelism"),
        c("config.redis_strategy").alias("redis_strategy"),
        c("metrics.producer.total_events").alias("produced_events"),
        c("metrics.statistics.delta.redis_total_impressions").alias("redis_impression_delta"),
        c("metrics.statistics.delta.redis_total_clicks").alias("redis_click_delta"),
        F.coalesce("metrics.success_gates.passed", F.lit(False)).alias("gates_passed"),
    )

    def flush(name: str, without: Column) -> Column:
        return F.when(c("_has_flush"), c(name)).otherwise(without).alias(name)

    zero = F.lit(0).cast("bigint")
    return (
        heads.join(totals, "run_id")
        .select(
            *heads.columns,
            "processed_events",
            "valid_events",
            "dead_letters",
            "elapsed_seconds",
            c("events_per_second").alias("end_to_end_eps"),
            c("window_events_per_second").alias("full_window_eps"),
            "post_warmup_eps",
            "full_window_records",
            flush("redis_flushes", c("valid_events")),
            flush("redis_updates_flushed", c("valid_events")),
            flush("redis_updates_coalesced", zero),
            F.when(c("_has_flush"), "Recorded").otherwise("Unavailable").alias("flush_metrics_source"),
        )
        .withColumn("updates_per_redis_write", scalar.safe_ratio("valid_events", "redis_flushes"))
        .withColumn(
            "redis_write_reduction_pct",
            F.lit(100.0) * (F.lit(1.0) - scalar.safe_ratio("redis_flushes", "valid_events")),
        )
    )


def completeness(summary: DataFrame) -> DataFrame:
    """Whether all produced events arrived and all updates were written."""
    c = F.col
    processed = c("produced_events") == c("processed_events")
    flushed = c("processed_events") == c("redis_updates_flushed")
    return summary.select(
        "run_id",
        "short_label",
        "produced_events",
        "processed_events",
        "dead_letters",
        "redis_impression_delta",
        "redis_click_delta",
        "redis_updates_flushed",
        "gates_passed",
        processed.alias("all_events_processed"),
        flushed.alias("all_updates_flushed"),
        F.when(
            processed & flushed & c("gates_passed") & (c("dead_letters") == 0), "PASS"
        )
        .otherwise("CHECK")
        .alias("status"),
    )


def speedup(summary: DataFrame, reference_run: int) -> DataFrame:
    """Rates of every run relative to one run, and efficiency per degree of parallelism."""
    rates = ["end_to_end_eps", "full_window_eps", "post_warmup_eps"]
    reference = (
        summary.filter(F.col("run_id") == reference_run).select(F.struct(*rates).alias("r")).scalar()
    )
    return (
        summary.withColumn("_ref", reference)
        .select(
            "run_id",
            "short_label",
            "parallelism",
            *[
                scalar.safe_ratio(F.col(r), F.col(f"_ref.{r}")).alias(f"{r}_speedup")
                for r in rates
            ],
        )
        .withColumn(
            "full_window_efficiency_pct",
            F.lit(100.0) * F.col("full_window_eps_speedup") / F.col("parallelism"),
        )
        .orderBy("parallelism", "run_id")
    )


def subtask_distribution(records: DataFrame) -> DataFrame:
    """Final processed events per run, one column per subtask that any run has, 0 where a run has none.

    The subtasks are those of the records: their number is the parallelism of the runs.
    """
    last = last_records(records, ["run_id"])
    found = sorted(r[0] for r in last.select("subtask_index").distinct().collect() if r[0] is not None)
    columns = [
        F.coalesce(
            F.sum(F.when(F.col("subtask_index") == s, F.col("processed_events"))),
            F.lit(0).cast("bigint"),
        ).alias(f"subtask_{s}")
        for s in found
    ]
    runs = last.groupBy("run_id")
    return runs.agg(*columns) if columns else last.select("run_id").distinct()


def subtask_shares(records: DataFrame) -> DataFrame:
    """Each subtask's share of the processed events of its run."""
    last = last_records(records, ["run_id"]).select("run_id", "subtask_index", "processed_events")
    # One row per subtask, so the window group is as small as the parallelism.
    total = F.sum("processed_events").over(W.partitionBy("run_id"))
    return last.withColumn("share", scalar.safe_ratio("processed_events", total))
