"""Realtime CTR: bucket state, dead letters and writes from a stream of event text.

Every micro-batch is one declarative pass: parse, admit clicks on top of the stored state, write
dead letters, writes and the new state. A bucket that receives a third of all events is split into
time slots like in a batch query (see ``operators.admission``), which a per-key stateful operator
could not do. All outputs of a batch are keyed by the version of the state that it makes, which belongs
to the run (the checkpoint) and the batch: a batch that was committed is not repeated, one that failed replaces its
own outputs, and a run with a fresh checkpoint goes on from the newest state.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clicklens import constants as K
from clicklens.functions.plan import local_rows
from clicklens.operators import admission as A
from clicklens.operators.counts import is_click, is_impression
from clicklens.operators.model import Model
from clicklens.operators.posterior import Trust
from clicklens.schemas import BUCKET, DEAD_LETTER, EVENT, PROCESSOR_RECORD
from clicklens.session import exists, remove
from clicklens.sources.events import invalid_events, parse_events, valid_events
from clicklens.sources.keyed import Commits, KeyedLog
from clicklens.sources.tables import read_or_none
from clicklens.streaming.begin import EARLIEST, begin_at

# A write per event; per changed bucket and micro-batch; per bucket and interval or number of updates.
PER_EVENT, COALESCED, TIMED = "per_event", "periodic", "timed"

# What a micro-batch writes, told apart by ``kind``: dead letters, bucket rows that changed, a row per event.
LETTER, STATE, WRITE = "letter", "state", "write"
_OPEN = [T.StructField("flush_window", T.LongType()), T.StructField("flush_since", T.LongType())]
_EVENT_COLUMNS = ["event_id", "event_type", "occurred_at", "updates"]
_OUTPUT = T.StructType(
    [
        *DEAD_LETTER.fields,
        *BUCKET.fields,
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("updates", T.LongType()),
        T.StructField("flushes", T.LongType()),
        *_OPEN,
        T.StructField("_v", T.IntegerType()),
    ]
)
_WHERE = T.StructType([T.StructField("batch", T.LongType()), T.StructField("kind", T.StringType())])
_PROGRESS = T.StructType([T.StructField("seq", T.LongType()), *PROCESSOR_RECORD.fields])


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: one run for as long as that is used."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


class RealtimeCtr:
    """Outputs below one folder: ``state`` (a log of changes), ``batches`` and ``metrics``.

    A micro-batch parses its texts into files that go with it and counts them; then it admits the clicks and writes
    dead letters, writes and changed buckets together. Its commit names the changed buckets as a delta of the state,
    so what is written follows the batch, not the table. The job holds the newest commit and reads it only at start.

    The model is fixed when the stream starts: new weights reach only buckets created after a
    restart. ``initial`` holds stored buckets to continue from; it is read once, when there is no state yet.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        model: Model,
        initial: DataFrame | None = None,
        trust: Trust = Trust(),
        flush_mode: str = COALESCED,
        slot_seconds: float = A.DEFAULT_SLOT_SECONDS,
        forward_dead_letters: Callable[[DataFrame], None] | None = None,
        parts: int = 16,
        interval_ms: int = K.FLUSH_INTERVAL_MS,
        max_updates: int = K.FLUSH_MAX_UPDATES,
    ) -> None:
        if flush_mode not in (PER_EVENT, COALESCED, TIMED):
            raise ValueError("flush mode must be per_event, periodic or timed")
        self.spark, self.folder, self.model, self.trust = spark, folder.rstrip("/"), model, trust
        self.flush_mode, self.slot_seconds = flush_mode, slot_seconds
        self.forward_dead_letters = forward_dead_letters
        self.interval_ms, self.max_updates = interval_ms, max_updates
        # With timed writes a bucket also keeps the interval that is open, and the count at which that began.
        kept = T.StructType([*BUCKET.fields, *(_OPEN if flush_mode == TIMED else [])])
        self.state = KeyedLog(spark, f"{self.folder}/state", kept, K.BUCKET_KEYS, parts=parts)
        self._metrics = Commits(spark, f"{self.folder}/metrics")
        self._last = time.monotonic()
        if initial is not None and not self.state.versions():  # a restart has newer state
            none = {f.name: F.lit(None).cast(f.dataType) for f in _OPEN}
            self.state.load(initial.withColumns(none), run="initial")
        self._run = "direct"

    def start(
        self,
        text: DataFrame,
        processing_time: str | None = None,
        checkpoint: str | None = None,
        starting: str = EARLIEST,
    ) -> StreamingQuery:
        """Start on a stream with a ``value`` column. Without a processing time the available
        backlog is drained and the query ends. ``starting`` is ``earliest`` or ``latest``, see ``begin_at``."""
        checkpoint, run = checkpoint or f"{self.folder}/checkpoint", None
        begin_at(text, checkpoint, starting)

        def process(batch: DataFrame, batch_id: int) -> None:
            nonlocal run
            run = self._run = run or run_of(self.spark, checkpoint)
            self.process(batch, batch_id)

        writer = (
            text.select("value")
            .writeStream.queryName("realtime_ctr")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(process)
        )
        trigger = {"availableNow": True} if processing_time is None else {"processingTime": processing_time}
        self._last = time.monotonic()
        return writer.trigger(**trigger).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. One that is committed changes nothing; one that failed replaces its own outputs."""
        if self.state.committed(self._run, batch_id):
            return
        version = self.state.next_version()
        aside, kept = f"{self.folder}/aside/{version}", []
        try:
            # Parsing is the costly part and feeds several outputs; files cost far less than cached blocks. The text
            # is kept where it is invalid.
            text = F.when(~F.col("valid"), F.col("raw")).alias("raw")
            parsed = self._aside(parse_events(batch).select(text, *EVENT.fieldNames(), "valid"), f"{aside}/parsed")
            valid = F.col("valid")
            counts = parsed.agg(
                F.count("*").alias("processed"),
                F.count_if(valid & is_impression()).alias("impressions"),
                F.count_if(valid & is_click()).alias("clicks"),
                # A few numbers: the partitions of the state that the batch may change.
                F.collect_set(F.when(valid, self.state.part())).alias("parts"),
            ).first()
            events, before = valid_events(parsed), self.state.read(parts=counts["parts"])
            if before is not None:
                # The stored rows of the batch's own buckets, which three steps look up.
                before = before.join(events.select(*K.BUCKET_KEYS).distinct(), K.BUCKET_KEYS, "left_semi").persist()
                kept.append(before)
            # No slot of a small batch can be too large for a piece.
            pieces = None if counts["processed"] <= A.PIECE_ROWS else A.PIECE_ROWS
            quiet = None
            if pieces is not None and self.flush_mode == COALESCED:
                # Only changed buckets and rejected clicks are written, so only slots where a click may be rejected
                # need their rows in order. Their few rows are met by slots whose size is known from their files.
                slots = A.screened_slots(events, before, self.slot_seconds)
                quiet, busy = self._aside_by(slots, "quiet", f"{aside}/slots")
                events = A.in_slots(events, busy, self.slot_seconds)
            admission = A.admit_clicks(events, before, self.slot_seconds, piece_rows=pieces, quiet=quiet)
            # One admission pass serves the dead letters, the writes and the new state.
            if pieces is None:
                runs = admission.runs.persist()
                kept.append(runs)
                totals = A.totals_of(runs, before, quiet)
            else:
                # The steps that follow read a few columns each, and look the totals of a bucket up several times.
                runs = self._aside(admission.runs, f"{aside}/runs")
                totals = self._aside(A.totals_of(runs, before, quiet), f"{aside}/totals")
            admission = replace(admission, runs=runs, totals=totals)
            seen = self._write(self._outputs(parsed, admission, before, version), version)
            if self.forward_dead_letters is not None:
                self.forward_dead_letters(self._read(LETTER, DEAD_LETTER, version))
            facts = self._progress(counts, seen)
            path = f"{self._batch(version)}/kind={STATE}"
            self.state.commit(version, self._run, batch_id, path, seen["changed"], facts)
            self._metrics.put(version, facts)
        finally:
            for rows in kept:
                rows.unpersist()
            remove(self.spark, aside)

    def _aside(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows of a batch as files that go with it."""
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _aside_by(self, rows: DataFrame, flag: str, path: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose flag is true and the others, each as files of their own."""
        rows.write.mode("overwrite").partitionBy(flag).parquet(path)
        schema = T.StructType([f for f in rows.schema.fields if f.name != flag])
        halves = [f"{path}/{flag}={value}" for value in ("true", "false")]
        return tuple(
            self.spark.read.schema(schema).parquet(half) if exists(self.spark, half) else local_rows(self.spark, [], schema)
            for half in halves
        )

    def flush(self, until: datetime | None = None) -> int:
        """Write the intervals that timed writes left open, all or those that ended by a time; returns their number.

        As a timer would do for buckets without further events. It reads every bucket, and runs between micro-batches.
        """
        if self.flush_mode != TIMED or self.state.head is None:
            return 0
        version, total = self.state.next_version(), F.col("impressions") + F.col("clicks")
        rows = self.state.read().withColumn("updates", (total - F.col("flush_since")) % self.max_updates)
        rows = rows.filter("updates > 0")
        if until is not None:
            over = F.timestamp_millis((F.col("flush_window") + 1) * self.interval_ms)
            rows = rows.filter(over <= F.lit(until))
        writes = rows.withColumns({"kind": F.lit(WRITE), "flushes": F.lit(1)})
        settled = rows.drop("updates").withColumns(
            {"kind": F.lit(STATE), "flush_since": total, "_v": F.lit(version)}
        )
        both = writes.drop("flush_window", "flush_since").unionByName(settled, allowMissingColumns=True)
        seen = self._write(self._as_output(both), version)
        facts = self._progress({"processed": 0, "impressions": 0, "clicks": 0}, seen)
        path = f"{self._batch(version)}/kind={STATE}"
        self.state.commit(version, "flush", version, path, seen["changed"], facts)
        self._metrics.put(version, facts)
        return seen["flushes"]

    def _outputs(self, parsed: DataFrame, admission: A.Admission, before: DataFrame | None, version: int) -> DataFrame:
        """All rows that the batch writes, in the columns of ``_OUTPUT`` with their kind."""
        letters = A.invalid_dead_letters(invalid_events(parsed)).unionByName(A.rejected_clicks(admission))
        changed = A.new_buckets(admission, before, self.model, self.trust)
        if self.flush_mode == TIMED:
            timed = self.model, self.trust, self.interval_ms, self.max_updates
            writes, left_open = A.timed_writes(admission, before, *timed)
            letters = letters.withColumn("kind", F.lit(LETTER)).unionByName(
                writes.withColumn("kind", F.lit(WRITE)), allowMissingColumns=True
            )
            changed = changed.join(left_open, K.BUCKET_KEYS, "left")
        else:
            letters = letters.withColumn("kind", F.lit(LETTER))
        rows = letters.unionByName(
            changed.withColumns({"kind": F.lit(STATE), "_v": F.lit(version)}), allowMissingColumns=True
        )
        if self.flush_mode == PER_EVENT:
            writes = A.running_buckets(admission, before, self.model, self.trust)
            rows = rows.unionByName(
                writes.select(*BUCKET.fieldNames(), *_EVENT_COLUMNS, F.lit(WRITE).alias("kind")),
                allowMissingColumns=True,
            )
        return self._as_output(rows)

    @staticmethod
    def _as_output(rows: DataFrame) -> DataFrame:
        there = set(rows.columns)
        columns = [F.col(f.name) if f.name in there else F.lit(None) for f in _OUTPUT.fields]
        typed = [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, _OUTPUT.fields)]
        return rows.select("kind", *typed)

    def _write(self, rows: DataFrame, version: int) -> dict:
        """Write the rows of a batch in one job; their numbers are observed on the way."""
        zero, seen = F.lit(0).cast("bigint"), Observation()
        rejected = F.when(F.col("reason") == K.REASON_EXCESS_CLICK, F.col("copies"))
        observed = rows.observe(
            seen,
            F.count_if(F.col("kind") == STATE).alias("changed"),
            F.coalesce(F.sum("copies"), zero).alias("letters"),
            F.coalesce(F.sum(rejected), zero).alias("rejected"),
            F.coalesce(F.sum("flushes"), zero).alias("flushes"),
            F.coalesce(F.sum(F.when(F.col("flushes") > 0, F.col("updates"))), zero).alias("flushed"),
        )
        observed.write.mode("overwrite").partitionBy("kind").parquet(self._batch(version))
        return seen.get

    def _progress(self, counts: Row | dict, seen: dict) -> dict:
        """The cumulative record after a batch: that of the batch before it, and what this one adds."""
        now = time.monotonic()
        seconds, self._last = now - self._last, now
        before = (self.state.head or {}).get("facts") or {}
        accepted = counts["impressions"] + counts["clicks"] - seen["rejected"]
        flushed = accepted
        if self.flush_mode == TIMED:
            flushes, flushed = seen["flushes"], seen["flushed"]
        else:
            flushes = accepted if self.flush_mode == PER_EVENT else seen["changed"]
        added = {
            "seq": 1,
            "processed_events": counts["processed"],
            "valid_events": accepted,
            "impressions": counts["impressions"],
            "clicks": counts["clicks"] - seen["rejected"],
            "dead_letters": seen["letters"],
            "redis_flushes": flushes,
            "redis_updates_flushed": flushed,
            "redis_updates_coalesced": flushed - flushes,
            "elapsed_seconds": seconds,
        }
        total = {name: before.get(name, 0) + value for name, value in added.items()}
        rate = total["processed_events"] / total["elapsed_seconds"] if total["elapsed_seconds"] > 0 else 0.0
        return total | {
            "subtask_index": 0,
            "redis_flush_mode": self.flush_mode,
            "events_per_second": rate,
            "window_events": counts["processed"],
            "window_seconds": seconds,
            "window_events_per_second": counts["processed"] / seconds if seconds > 0 else 0.0,
        }

    def _batch(self, version: int) -> str:
        return f"{self.folder}/batches/batch={version}"

    def _read(self, kind: str, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a kind that committed batches wrote, or one batch."""
        chosen = F.col("batch") == version if version is not None else F.col("batch") < self.state.next_version()
        rows = read_or_none(self.spark, f"{self.folder}/batches", T.StructType([*_OUTPUT.fields, *_WHERE.fields]))
        if rows is None:
            return local_rows(self.spark, [], schema)
        return rows.filter((F.col("kind") == kind) & chosen).select(*schema.fieldNames())

    def dead_letters(self) -> DataFrame:
        return self._read(LETTER, DEAD_LETTER)

    def writes(self) -> DataFrame:
        """Bucket rows in the order of batches: per accepted event with its columns, per bucket and batch, or per
        interval and number of updates with the updates they carry and the writes they stand for."""
        if self.flush_mode == COALESCED:
            return self._read(STATE, BUCKET)
        if self.flush_mode == TIMED:
            carried = [f for f in _OUTPUT.fields if f.name in ("updates", "flushes")]
            return self._read(WRITE, T.StructType([*BUCKET.fields, *carried]))
        events = [f for f in _OUTPUT.fields if f.name in _EVENT_COLUMNS]
        return self._read(WRITE, T.StructType([*events, *BUCKET.fields]))

    def buckets(self) -> DataFrame:
        """The current bucket rows."""
        rows = self.state.read()
        return local_rows(self.spark, [], BUCKET) if rows is None else rows.select(*BUCKET.fieldNames())

    def progress(self) -> DataFrame:
        """Cumulative progress records, one per micro-batch."""
        records = [r for _, r in self._metrics.all()]
        return local_rows(self.spark, [tuple(r[f] for f in _PROGRESS.fieldNames()) for r in records], _PROGRESS)
