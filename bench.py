"""Time the headline queries and print one JSON line.

Every query runs once to warm the JVM and once timed; the result is written to a no-op sink, so the
whole result is computed. The drain rates are those of a stream over a backlog that is already there as
text, in four micro-batches with carried state, start-up of the query included; once by all events and
once by the valid ones among them.
"""

from __future__ import annotations

import json
import os
import time

from clicklens.plans.queries import REGISTRY
from clicklens.operators.model import seed_model
from clicklens.session import local_session, shared_folder
from clicklens.sources import adapters as X
from clicklens.sources.events import text_event_stream
from clicklens.streaming.evidence import EvidenceStream
from clicklens.streaming.realtime import PER_EVENT, RealtimeCtr

HEADLINE = [
    "bucket_posterior",
    "triplet_counts",
    "event_validate",
    "click_admission",
    "dead_letters",
    "recalibrate",
    "estimator_quality",
    "calibration_bands",
    "metrics_aggregate",
    "stream_triplet_counts",
    "stream_ctr_update",
    "stream_star_update",
    "state_sink_per_event",
]
BATCHES = 4


def run(spark, name: str, folder: str) -> float:
    begin = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def drains(spark, folder: str) -> dict:
    """Events per second of the streams over the event log."""
    log = X.event_log(spark, folder)
    topic = shared_folder(spark, "bench-topic")
    files = X.write_topic(spark, log, topic, BATCHES)
    total, valid = log.count(), X.valid_event_log(spark, folder).count()
    rates = {}
    for name, job in (
        ("coalesced", RealtimeCtr(spark, shared_folder(spark, "bench"), seed_model(spark))),
        ("per_event", RealtimeCtr(spark, shared_folder(spark, "bench"), seed_model(spark), flush_mode=PER_EVENT)),
        ("evidence", EvidenceStream(spark, shared_folder(spark, "bench"))),
    ):
        begin = time.perf_counter()
        job.start(text_event_stream(spark, topic, files)).awaitTermination()
        seconds = time.perf_counter() - begin
        rates[name] = {"all": round(total / seconds), "valid": round(valid / seconds), "seconds": round(seconds, 3)}
    return rates


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "events_per_second": drains(spark, folder),
            }
        )
    )


if __name__ == "__main__":
    main()
