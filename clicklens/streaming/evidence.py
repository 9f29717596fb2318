"""Cumulative evidence for the learner and the clock that re-learns from it."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicklens import constants as K
from clicklens.functions import checks
from clicklens.operators import learning as L
from clicklens.operators.counts import is_click, is_impression
from clicklens.operators.model import Head, Model
from clicklens.sources.events import parse_events
from clicklens.sources.keyed import Commits, KeyedLog
from clicklens.sources.tables import ModelStore
from clicklens.streaming.begin import EARLIEST, begin_at
from clicklens.streaming.realtime import run_of

COUNTS = T.StructType(
    [T.StructField(k, T.StringType()) for k in K.BUCKET_KEYS]
    + [T.StructField(n, T.LongType()) for n in ("impressions", "clicks", "invalid_events")]
)


def evidence_counts(parsed: DataFrame) -> DataFrame:
    """Counts per triplet; all invalid events share one row with NULL keys.

    Works on batches and streams. The counts combine before the shuffle, so neither a hot triplet
    nor a flood of invalid events reaches one task row by row. Clicks are not rejected here.
    """
    keys = [F.when(F.col("valid"), F.col(k)).alias(k) for k in K.BUCKET_KEYS]
    return parsed.groupBy("valid", *keys).agg(
        F.count_if(F.col("valid") & is_impression()).alias("impressions"),
        F.count_if(F.col("valid") & is_click()).alias("clicks"),
        F.count_if(~F.col("valid")).alias("invalid_events"),
    ).select(*COUNTS.fieldNames())


class EvidenceStream:
    """Keeps the counts of all events so far as a log of count deltas.

    Each micro-batch appends the counts of its own triplets, so what is written follows the triplets that a batch
    names; readers add up, and old deltas are folded into the base partitions they touch. A batch is counted once,
    a run with a fresh checkpoint goes on from what is stored. The time of the first valid event arms the clock.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 16) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        counts = ["impressions", "clicks", "invalid_events"]
        self.table = KeyedLog(spark, f"{self.folder}/counts", COUNTS, K.BUCKET_KEYS, sums=counts, parts=parts)

    def start(
        self,
        text: DataFrame,
        processing_time: str | None = None,
        checkpoint: str | None = None,
        starting: str = EARLIEST,
    ) -> StreamingQuery:
        trigger = {"availableNow": True} if processing_time is None else {"processingTime": processing_time}
        checkpoint, run = checkpoint or f"{self.folder}/checkpoint", None
        begin_at(text, checkpoint, starting)

        def process(batch: DataFrame, batch_id: int) -> None:
            nonlocal run
            run = run or run_of(self.spark, checkpoint)
            self.process(batch, run, batch_id)

        return (
            text.select("value")
            .writeStream.queryName("weight_evidence")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(process)
            .trigger(**trigger)
            .start()
        )

    def process(self, batch: DataFrame, run: str, batch_id: int) -> None:
        """Count one micro-batch, unless it is counted already."""
        if self.table.committed(run, batch_id):
            return
        version, seen = self.table.next_version(), Observation()
        path = self.table.delta_path(version, run)
        counts = evidence_counts(parse_events(batch)).withColumn("_v", F.lit(version))
        observed = counts.observe(
            seen,
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.col("impressions") + F.col("clicks")), F.lit(0)).alias("valid"),
        )
        observed.write.mode("overwrite").parquet(path)
        facts = dict((self.table.head or {}).get("facts") or {})
        if seen.get["valid"] and "armed_at" not in facts:
            facts["armed_at"] = time.time()
        self.table.commit(version, run, batch_id, path, seen.get["rows"], facts)

    def armed_at(self) -> float | None:
        """When the first valid event was counted, in seconds since the epoch; None before."""
        self.table.refresh()
        return ((self.table.head or {}).get("facts") or {}).get("armed_at")

    def counts(self) -> tuple[DataFrame, DataFrame] | None:
        """Triplet counts and the one-row number of invalid events; None before any event."""
        rows = self.table.read()
        if rows is None:
            return None
        first = F.col(K.BUCKET_KEYS[0])
        invalid = rows.agg(F.coalesce(F.sum("invalid_events"), F.lit(0)).alias("invalid_events"))
        return (
            rows.filter(first.isNotNull()).select(*K.BUCKET_KEYS, "impressions", "clicks"),
            invalid,
        )


class Recalibrator:
    """Re-learns the current model from the evidence at every tick of a clock.

    Evidence is cumulative, so ticks without new events keep moving the weights towards their
    targets, as intended. The tick reads one decision row; features and weights stay distributed.
    """

    def __init__(
        self,
        evidence: EvidenceStream,
        models: ModelStore,
        config: L.Learning,
        prefix: str = "streaming_weights",
    ) -> None:
        self.evidence, self.models, self.config, self.prefix = evidence, models, config, prefix

    def tick(self, at: datetime | None = None, number: int | None = None) -> dict | None:
        """One pass; returns its metrics row, or None while there is no valid event yet."""
        found = self.evidence.counts()
        if found is None:
            return None
        counts, invalid = found
        if counts.isEmpty():
            return None
        # Unlearnable triplets are already in the invalid count.
        return recalibrate_once(
            counts.filter(checks.learnable()),
            self.models,
            self.config,
            L.evidence_counts(counts, invalid.scalar()),
            self.prefix,
            at,
            number,
        )

    def poll(self, interval: float, now: float | None = None) -> dict | None:
        """The pass that is due at ``now``, if one is; None otherwise.

        The first valid event arms the clock: the first pass is due ``interval`` seconds after it, the next one as
        long after the time that one fired. A pass that was made is recorded once. The model carries the number of
        its pass, so one that stopped between its model and its record is recorded, not made again.
        """
        armed, now = self.evidence.armed_at(), time.time() if now is None else now
        if armed is None:
            return None
        ticks = Commits(self.evidence.spark, f"{self.models.path}/ticks")
        done = ticks.all()
        number, last = (done[-1][0] + 1, done[-1][1]["fired_at"]) if done else (1, armed)
        if now < last + interval:
            return None
        at = datetime.fromtimestamp(now, timezone.utc)
        if self.models.has_tick(number):
            row = {"accepted": True, "snapshot_id": self.models.last_id()}
        else:
            row = self.tick(at, number) or {"accepted": False, "snapshot_id": None}
        ticks.put(number, {"fired_at": now, "accepted": row["accepted"], "snapshot_id": row["snapshot_id"]})
        return row

    def start(self, interval: float, checkpoint: str, poll: str = "1 second") -> StreamingQuery:
        """Make a pass every ``interval`` seconds from the first valid event on, also when no event arrives."""
        clock = self.evidence.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return (
            clock.writeStream.queryName("weight_clock")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda _rows, _id: self.poll(interval) and None)
            .trigger(processingTime=poll)
            .start()
        )


def recalibrate_once(
    buckets: DataFrame,
    models: ModelStore,
    config: L.Learning,
    scan_counts: DataFrame | None = None,
    prefix: str = "weight_update",
    at: datetime | None = None,
    tick: int | None = None,
) -> dict:
    """Recalibrate from buckets and append the new model unless skipped or a dry run.

    Returns the metrics row with the outcome: name and id of the snapshot and what was written.
    """
    model = models.current()
    outcome = L.recalibrate(buckets, model, config, scan_counts)
    row = outcome.metrics | {"snapshot_name": None, "snapshot_id": None, "write_applied": False}
    if not row["accepted"]:
        return row
    name = f"{prefix}_{(at or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"
    row["snapshot_name"] = name
    if not config.dry_run:
        old = model.head
        head = Head(
            name,
            row["new_w0"],
            row["new_baseline_ctr"],
            old.global_strength,
            old.triplet_strength,
            old.family_strengths,
        )
        row["snapshot_id"] = models.append(Model(head, outcome.weights), outcome.metrics_frame(), tick)
        row["write_applied"] = True
    return row
